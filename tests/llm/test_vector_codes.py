from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from pregao.llm import vector_codes
from pregao.llm.queries import op12_slice_intersect_codes, oracle_sql

SCHEMA = "vec_id long, embedding array<float>, label int, ints string"


def plain(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and codebooks by looking at every entry."""
    usable = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = sorted(
        ((r[0] is None, r[0] or 0, [math.floor(4096 * float(np.float32(x))) for x in r[1]], r[2]) for r in usable),
        key=lambda r: r[:3],
    )
    if not whole:
        return [], []
    width = len(whole[0][2]) // parts
    cut = [[v[2][p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        members = [[[] for _ in b] for b in books]
        for c in cut:
            for p in range(parts):
                members[p][near(p, c[p])[1]].append(c[p])
        for p in range(parts):
            for e, m in enumerate(members[p]):
                if m:
                    books[p][e] = [sum(x) // len(m) for x in zip(*m, strict=True)]
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for v, e in zip(whole, errors, strict=True):
        by_label[v[3]] = by_label.get(v[3], 0) + e
    text = ",".join(str(x) for b in books for e in b for x in e)
    sha = hashlib.sha256(text.encode()).hexdigest()
    rows = [
        (None if v[0] else v[1], "".join(f"{i:02x}" for _, i in f), e, by_label[v[3]], sha)
        for v, f, e in zip(whole, found, errors, strict=True)
    ]
    return rows, books


def run(spark, tmp_path, rows, name="t"):
    folder = tmp_path / name
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(folder / "embeddings.parquet"))
    found = op12_slice_intersect_codes(spark, str(folder))
    return sorted(map(tuple, found.collect()), key=str), folder


def vectors(seed, n, spread=1.0, dims=16):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(dims)], rng.choice([None, 0, 1, 2]), "x") for i in range(n)]


def test_equals_plain_loops_and_sql(spark, tmp_path):
    rows = vectors(3, 200)
    found, folder = run(spark, tmp_path, rows)
    assert found == sorted(plain(rows)[0], key=str)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    sql = db.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({oracle_sql()['op12_slice_intersect_codes']}) q").fetchall()
    assert sorted(sql, key=str) == found


def test_ties_repeats_and_negative_means(spark, tmp_path):
    """Few distinct values, so that distances tie and most rows are alike."""
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0]) for _ in range(8)], 1, "x") for i in range(120)]
    rows += rows[:40] + [(None, rows[0][1], None, "x")] * 3
    assert run(spark, tmp_path, rows)[0] == sorted(plain(rows)[0], key=str)


def test_rows_that_take_no_part(spark, tmp_path):
    good = vectors(4, 9)
    bad = [(90, None, 0, "x"), (91, [], 0, "x"), (92, [1.0] * 15 + [None], 0, "x"), (93, [math.nan] * 16, 1, "x"), (94, [math.inf] + [0.0] * 15, 1, "x")]
    found, _ = run(spark, tmp_path, good + bad)
    assert found == sorted(plain(good)[0], key=str)  # fewer rows than entries as well
    assert run(spark, tmp_path, bad, "none")[0] == []


def test_a_third_of_the_rows_under_one_label_is_spread(spark, tmp_path):
    rows = [(i, v, 7 if i % 3 else label, "x") for i, v, label, _ in vectors(6, 90)]
    assert run(spark, tmp_path, rows)[0] == sorted(plain(rows)[0], key=str)
    dealt = vector_codes.with_label_error(spark.createDataFrame([(i, 7, [i], 1) for i in range(200)], "vec_id long, label int, entries array<long>, error long"))
    assert {r["label_error"] for r in dealt.collect()} == {200}


@pytest.mark.parametrize("entries", [1, 16, 64, 65, 130])
@pytest.mark.parametrize("spread", [2, 50, 100_000])
def test_intersected_masks_keep_the_nearest_entry(entries, spread):
    rng = np.random.default_rng(entries)
    book, values = rng.integers(-spread, spread, (entries, 5)), rng.integers(-spread, spread, (400, 5))
    slices = vector_codes.Slices(book)
    every = ((values[:, None] - book[None]) ** 2).sum(axis=2)
    best, least = slices.nearest(values)
    assert (best == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
    # The masks hold exactly the entries inside the radius.
    masks = slices.candidates(values, np.full(400, spread // 2))
    inside = (np.abs(values[:, None] - book[None]) <= spread // 2).all(axis=2)
    bits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :entries].astype(bool)
    assert (bits == inside).all()


def test_unequal_lengths_and_huge_components_stop_the_job(spark, tmp_path):
    for name, vector in (("length", [0.0] * 8), ("size", [1e9] * 16)):
        with pytest.raises(Exception, match="components" if name == "length" else "whole numbers"):
            run(spark, tmp_path, [*vectors(1, 20), (99, vector, 0, "x")], name)
