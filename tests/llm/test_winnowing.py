from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from pregao.llm import queries, winnowing
from pregao.llm.neighbours import with_next

from .test_hilbert import save


def brute(spark, texts, gram=5, window=4):
    """Kept (hash, position) pairs by plain loops; only the word hash is Spark's."""
    words = sorted({w for t in texts for w in re.split(r"[\x20\x09-\x0D]+", t.lower().strip(" \t\n\x0b\x0c\r"))})
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(winnowing.PRIME)).alias("h"))
    code = {r["w"]: r["h"] for r in rows.collect()}
    out = []
    for t in texts:
        seq = [code[w] for w in re.split(r"[\x20\x09-\x0D]+", t.lower().strip(" \t\n\x0b\x0c\r"))]
        hashes = []
        for i in range(max(1, len(seq) - gram + 1)):
            h = 0
            for x in seq[i : i + gram]:
                h = (h * winnowing.BASE + x) % winnowing.PRIME
            hashes.append(h)
        kept = []
        for i in range(max(1, len(hashes) - window + 1)):
            part = hashes[i : i + window]
            at = max(j for j, h in enumerate(part) if h == min(part)) + i
            if (hashes[at], at) not in kept:
                kept.append((hashes[at], at))
        out.append(kept)
    return out


def test_kept_grams_match_loops(spark):
    rng = random.Random(3)
    texts = ["", "one", "a b c d", "a b c d e", " A\tb\nc  d e f g ", "x " * 40]
    texts += [" ".join(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(n)) for n in (6, 8, 9, 50, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", winnowing.positions(winnowing.winnow(F.col("t"))).alias("p")).orderBy("i").collect()
    assert [[(p["hash"], p["position"]) for p in r["p"]] for r in got] == brute(spark, texts)


def test_shared_run_shares_a_hash(spark):
    rng = random.Random(5)
    run = [f"r{i}" for i in range(winnowing.GRAM + winnowing.WINDOW - 1)]
    texts = [" ".join([f"{s}{rng.random()}" for _ in range(20)] + run + [f"{s}{rng.random()}" for _ in range(9)]) for s in "ab"]
    df = spark.createDataFrame([tuple(texts)], "a string, b string")
    kept = [winnowing.hashes(winnowing.winnow(F.col(c))) for c in "ab"]
    assert df.select(F.size(F.array_intersect(*kept))).first()[0] >= 1


def test_query_against_loops(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i * 3, " ".join(f"wört{rng.randint(0, 30)}" for _ in range(rng.randint(0, 60))), "en", "s", 1) for i in range(70)]
    rows += [(211, None, "en", "s", 0), (500, rows[4][1], "en", "s", 1), (-5, "last one", "en", "s", 1)]
    out = {r["doc_id"]: r for r in queries.op3_winnowing(spark, save(spark, tmp_path, rows)).collect()}
    ordered = sorted(((r[0], r[1] or "") for r in rows), reverse=True)
    texts = [t for _, t in ordered]
    edited = []
    for i, t in enumerate(texts):
        half = len(t) // 2
        edited.append(t[: len(t) - half] + texts[(i + 1) % len(texts)][:half])
    own = [{h for h, _ in k} for k in brute(spark, texts)]
    changed = [{h for h, _ in k} for k in brute(spark, edited)]
    assert len(out) == len(rows)
    for i, (doc, text) in enumerate(ordered):
        r, after = out[doc], own[(i + 1) % len(own)]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest()
        assert abs(r["near_edited"] - len(own[i] & changed[i]) / len(own[i] | changed[i])) < 1e-12
        assert abs(r["near_next"] - len(own[i] & after) / len(own[i] | after)) < 1e-12
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (texts[i] == edited[i])
    assert out[500]["fingerprint"] == out[12]["fingerprint"] != out[15]["fingerprint"]


def test_single_empty_and_tied_rows(spark, tmp_path):
    one = [(4, "a b c d e f g h", "en", "s", 1)]
    r = queries.op3_winnowing(spark, save(spark, tmp_path / "a", one)).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"a b c d a b c d"[:8] + b"a b c d").hexdigest()
    assert queries.op3_winnowing(spark, save(spark, tmp_path / "b", [])).collect() == []
    tied = [(1, "x", "en", "s", 1)] * 3 + [(None, "y", "en", "s", 1)]
    assert queries.op3_winnowing(spark, save(spark, tmp_path / "c", tied)).count() == 4


def test_next_row_for_any_chunk_count(spark):
    rng = random.Random(1)
    ids = sorted(rng.sample(range(-(10**12), 10**12), 200), reverse=True)
    df = spark.createDataFrame([(i,) for i in ids], "k long").repartition(7)
    for chunks in (1, 2, 37, 400):
        got = {r["k"]: r["next_v"] for r in with_next(df, "k", {"v": F.col("k")}, [], chunks).collect()}
        assert got == dict(zip(ids, ids[1:] + ids[:1], strict=True)), chunks
