"""The corpus pipeline against the plain-loop versions of its stages, and as a whole."""

from __future__ import annotations

import collections
import itertools
import random

import corpus_pipeline
from pyspark.sql import functions as F

from pregao.llm import queries

from .test_hilbert import SCHEMA, save
from .test_lines import brute as brute_lines
from .test_mixing import brute_targets
from .test_mixing import words as word_count
from .test_packing import check as check_packing
from .test_simhash import brute_components, brute_fingerprint


def corpus(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(400)]

    def prose():
        return "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 40))) + "." for _ in range(rng.randint(1, 5)))

    rows = [(i, prose(), "en", f"src{i % 4}", 0) for i in range(90)]
    rows += [(200 + i, "".join(rng.choice("!#%&*") for _ in range(rng.randint(40, 300))), "en", "src1", 0) for i in range(40)]
    rows += [(300 + i, rows[i][1] + "\n" + prose(), "en", "src2", 0) for i in range(10)]  # share lines
    rows += [(320 + i, rows[40 + i][1].replace("word1", "other1", 1), "en", "src0", 0) for i in range(10)]  # nearly alike
    rows += [(340, None, None, None, None), (341, "", "en", "src3", 0), (342, " ".join(rng.choice(vocabulary) for _ in range(9000)), "en", "src3", 0)]
    rows = [(*r[:4], None if r[1] is None else len(r[1])) for r in rows]
    labels = [(r[0], int(not 200 <= r[0] < 300), 0) for r in rows if r[0] < 300]
    save(spark, tmp_path, labels, "doc_id long, quality int, toxic int", "labels")
    return save(spark, tmp_path, rows), rows


def test_stages_follow_their_loops(spark, tmp_path):
    folder, rows = corpus(spark, tmp_path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "simhash_near_duplicates", "source_mixing", "best_fit_packing"]
    docs, after = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        after[name] = [tuple(r) for r in docs.collect()]
        assert name == names[-1] or docs.dtypes == [(f.split()[0], f.split()[1].replace("long", "bigint")) for f in SCHEMA.split(", ")]

    scores = {r["doc_id"]: r["score"] for r in queries.op4_byte_conv_quality(spark, folder).collect()}
    good = after["quality_classifier"]
    assert sorted(good) == sorted(r for r in rows if scores[r[0]] >= 0.3)
    assert sum(r[0] < 90 for r in good) >= 88 and sum(200 <= r[0] < 300 for r in good) <= 4

    lined = after["line_dedup"]
    assert sorted((r[0], r[1]) for r in lined) == sorted(brute_lines([r[:2] for r in good])[0])
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in lined)
    assert any(r[1] == "" or (r[1] and len(r[1]) < r0[4]) for r, r0 in zip(sorted(lined), sorted(good), strict=True))

    prints = {r[0]: brute_fingerprint(r[1]) for r in lined}
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    firsts = set(brute_components(prints, near).values())
    kept = after["simhash_near_duplicates"]
    assert sorted(kept) == sorted(r for r in lined if r[0] in firsts)

    mixed, sizes, taken = after["source_mixing"], collections.Counter(), collections.Counter()
    assert set(mixed) <= set(kept) and max(collections.Counter(mixed).values()) <= 2
    for r in kept:
        sizes[r[3]] += word_count(r[1])
    for r in mixed:
        taken[r[3]] += word_count(r[1])
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= (9000 if source == "src3" else 60)

    packed = [r.asDict() for r in docs.collect()]
    assert check_packing(mixed, packed) <= -(-sum(r["length"] for r in packed) // 4096) + 2
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect())) == sorted(
        tuple(r) for r in docs.drop("sequence_id", "offset").collect()
    )


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder = save(spark, tmp_path, [])
    save(spark, tmp_path, [], "doc_id long, quality int, toxic int", "labels")
    assert corpus_pipeline.run(spark, folder).filter(F.lit(True)).collect() == []
