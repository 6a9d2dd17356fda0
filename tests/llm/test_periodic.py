from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from pregao.llm import periodic
from pregao.llm.queries import op11_periodic_runs


def plain_runs(words, exponent=4, shortest=6):
    """(start, length, period) by trying every period at every place."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            smaller = any(run[p:] == run[:-p] for p in range(1, q))
            if len(run) >= max(shortest, exponent * q) and not smaller:
                found.append((i, len(run), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(texts, **limits):
    codes = np.array([x for w in texts for x in w], np.int64)
    rows = periodic.find_runs(codes, np.array([len(w) for w in texts], np.int64), **limits).tolist()
    return [[tuple(r[1:]) for r in rows if r[0] == i] for i in range(len(texts))]


def with_repeats(rng, n, letters, stretches):
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(stretches if n > 8 else 0):
        first, period = rng.randrange(n), 1 + rng.randrange(max(1, n // 3))
        for i in range(first, min(n, first + period * rng.choice([3, 4, 5, 9]))):
            words[i] = words[first + (i - first) % period]
    return words


def test_runs_equal_those_of_a_plain_search():
    rng = random.Random(1)
    for _ in range(60):
        texts = [
            with_repeats(rng, rng.choice([0, 1, 5, 20, 60, 150, 400]), rng.choice([1, 2, 3, 5, 30]), rng.randrange(4))
            for _ in range(rng.randint(1, 6))
        ]
        assert runs_of(texts) == [plain_runs(w) for w in texts]


@settings(max_examples=150, deadline=None)
@given(hs.lists(hs.lists(hs.integers(0, 1), max_size=6), min_size=1, max_size=3), hs.lists(hs.integers(1, 9), min_size=3, max_size=3))
def test_powers_of_powers(roots, times):
    words = []
    for root, n in zip(roots, times, strict=False):
        words = (words + root) * n
    assert runs_of([words, words[1:]]) == [plain_runs(words), plain_runs(words[1:])]


def test_periodic_roots_are_found_at_scales_that_leave_their_inside_out():
    """Roots that are one letter but for a place: highly periodic, with a long period around."""
    for root in (7, 13, 21, 40, 64, 97):
        words = ([0] * (root - 1) + [1]) * 5 + [2]
        assert runs_of([words]) == [plain_runs(words)]
        assert (0, 5 * root, root) in runs_of([words])[0]


def test_cubes_on_request_and_no_fewer():
    words = [1, 2, 3, 4, 5, 6, 7] * 3
    assert runs_of([words]) == [[]]
    assert runs_of([words], min_exponent=3) == [[(0, 21, 7)]]
    with pytest.raises(ValueError, match="three"):
        runs_of([words], min_exponent=2)


def test_texts_of_all_kinds(spark):
    rows = [
        (1, None, "x"),
        (2, "", "x"),
        (3, " \t\n ", "x"),
        (4, "a  a\na a a\x0ba", "x"),
        (4, "a  a\na a a\x0ba", "x"),
        (None, "só um ponto", None),
        (5, "go " * 70_000, "long"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = periodic.periodic_runs(docs, carry=("doc_id",)).collect()
    seen = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found]
    assert sorted(seen, key=str) == sorted(
        [
            (1, 0, [], ""),
            (2, 0, [], ""),
            (3, 0, [], ""),
            (4, 6, [(0, 6, 1)], "a"),
            (4, 6, [(0, 6, 1)], "a"),
            (None, 3, [], "só um ponto"),
            (5, 70_000, [(0, 70_000, 1)], "go"),
        ],
        key=str,
    )
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_a_slice_of_text_ends_between_rows(spark, monkeypatch):
    docs = spark.range(50).selectExpr("id AS doc_id", "repeat(concat(id, ' b '), 5) AS text").coalesce(1)
    whole = sorted(map(str, periodic.periodic_runs(docs).collect()))
    monkeypatch.setattr(periodic, "SLICE_BYTES", 1)
    import pyarrow as pa

    slices = list(periodic._slices(pa.array(["abc", None, "", "de"]), 1))
    assert slices == [(0, 1), (1, 2), (3, 1)] or sum(n for _, n in slices) == 4
    assert sorted(map(str, periodic.periodic_runs(docs).collect())) == whole


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(kept).hexdigest(),
    )


def test_the_query_equals_plain_loops(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{x}" for x in with_repeats(rng, rng.randrange(1, 90), rng.choice([2, 9, 50]), 2))) for i in range(300)]
    rows += [(None, "a a a a a a"), (None, None), (7, ""), (40, " \n"), (40, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, period string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = op11_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert found.columns == names
    assert {k for _, k in found.dtypes[1:6]} == {"bigint"}
    assert sorted(map(tuple, found.collect()), key=str) == sorted((plain_row(i, t) for i, t in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
