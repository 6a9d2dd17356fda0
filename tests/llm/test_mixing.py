from __future__ import annotations

import collections
import random
import re

import pytest

from pregao.llm import mixing, queries

from .test_hilbert import save


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Share out by weight; cap; share the excess among those below, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, rest, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while rest > 1e-9 and open_:
        each = rest / sum(weight[s] for s in open_)
        rest = 0.0
        for s in list(open_):
            target[s] += each * weight[s]
            if target[s] >= 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def check(rows, out, slack):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    target = brute_targets(sizes)
    assert collections.Counter((r["doc_id"], r["size"], r["source"]) for r in out) == collections.Counter(
        (r[0], words(r[1]), r[3]) for r in rows
    )
    taken = collections.Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]], rel=1e-9, abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= slack, (s, taken[s], target[s])


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"], None, r["source"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    first = queries.op7_entropy_mixing(spark, folder).collect()
    check(rows, first, 60)
    assert sorted(first) == sorted(queries.op7_entropy_mixing(spark, folder).collect())


def test_odd_sources(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), "en", rng.choice(["hot", "hot", "hot", "É", "z", "", None, "😀", "a"]), 1) for i in range(400)]
    rows += [(900, None, "en", "void", 0), (None, "x y", "en", None, 1), (3, rows[3][1], "en", rows[3][3], 1)]
    rows += [(1000 + i, "one two three", "en", "copies", 1) for i in range(700)] + [(2000, "w " * 5000, "en", "long", 1)]
    out = queries.op7_entropy_mixing(spark, save(spark, tmp_path / "a", rows)).collect()
    sized = [r for r in out if r["source"] != "long"]
    check([r for r in rows], out, 5000)
    taken = collections.Counter()
    for r in sized:
        taken[r["source"]] += r["taken"]
    for r in sized:
        assert abs(taken[r["source"]] - r["target"]) <= 3
    assert queries.op7_entropy_mixing(spark, save(spark, tmp_path / "b", [])).collect() == []
    blank = [(1, None, "en", "a", 0), (2, " ", "en", None, 1)]
    assert {r["taken"] for r in queries.op7_entropy_mixing(spark, save(spark, tmp_path / "c", blank)).collect()} == {0}


def test_rates_are_the_tilted_ones(spark):
    """The solution meets the constraint, and log odds are linear in size: the optimality condition."""
    import math

    groups = spark.createDataFrame([(False, "a", n, 5 + n % 3, 0) for n in range(1, 60)], "_none boolean, _source string, size long, rows long, first long")
    total = sum(n * (5 + n % 3) for n in range(1, 60))
    for part in (0.02, 1.3, 1.999):
        sources = spark.createDataFrame([(False, "a", total, total * part)], "_none boolean, _source string, source_size long, target double")
        r = mixing.tilts(groups, sources).first()
        rate = [2 / (1 + math.exp(-r["tilt"] * n / r["mean"])) for n in range(1, 60)]
        assert sum(x * n * (5 + n % 3) for x, n in zip(rate, range(1, 60), strict=True)) == pytest.approx(total * part, rel=1e-8)


def test_copied_rows(spark):
    rows = [(i, f"t{i} b c", "s1" if i % 4 else None, "x") for i in range(40)] + [(5, "t5 b c", "s1", "x"), (5, "other b c", "s1", "y"), (None, "n n", "s1", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mixing.copied(df)
    assert out.columns == df.columns
    got = collections.Counter(tuple(r) for r in out.collect())
    assert set(got) <= set(rows) and max(got.values()) <= 4
    expected = collections.Counter()
    for r in mixing.mix(df).collect():
        expected[(r["doc_id"], r["source"])] += r["copies"]
    by_key = collections.Counter()
    for r, n in got.items():
        by_key[(r[0], r[2])] += n
    assert by_key == +expected


def test_copies_go_to_the_texts_that_were_mixed(spark):
    """A third of the rows without id, of one source and size, but of unlike texts; each is found again."""
    rows = [(None, f"a{i} b c", "hot") for i in range(700)] + [(i, "w " * (1 + i % 9), "hot" if i % 2 else "z") for i in range(1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    assert mixed.columns == ["doc_id", "source", "size", "source_size", "target", "copies"]
    copies = [r["copies"] for r in mixed.filter("doc_id IS NULL").collect()]
    got = collections.Counter(r["text"] for r in mixing.copied(df).filter("doc_id IS NULL").collect())
    assert len(copies) == 700 and 0 < sum(copies) == sum(got.values()) and max(got.values()) <= 2
    assert collections.Counter(got.values()) == collections.Counter(c for c in copies if c)
