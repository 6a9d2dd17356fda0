from __future__ import annotations

import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from pregao.llm import hilbert, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def save(spark, tmp_path, rows, schema=SCHEMA, name="documents"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbouring_cells(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    names = [f"x{i}" for i in range(dims)]
    df = spark.createDataFrame(cells, ",".join(f"{n} int" for n in names))
    rows = df.withColumn("at", hilbert.curve_index([F.col(n) for n in names], bits)).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(len(cells)))
    for a, b in itertools.pairwise(rows):
        assert sum(abs(a[n] - b[n]) for n in names) == 1


def test_level_cuts_weigh_rows():
    assert hilbert.level_cuts([(b, 1) for b in range(8)], 4) == [2, 4, 6]
    assert hilbert.level_cuts([(0, 1000), (1, 1)], 4) == [0, 1, 1]
    assert hilbert.level_cuts([(7, 5)], 4) == [7, 7]


def check(spark, folder, rows, shards=24):
    out = queries.op1_hilbert_shards(spark, folder).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out) == sorted(
        (r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    by_shard = {}
    for r in out:
        by_shard.setdefault(r["shard"], []).append(r)
    counts = [len(by_shard.get(s, [])) for s in range(shards)]
    assert set(by_shard) <= set(range(shards)) and max(counts) - min(counts) <= 1
    for members in by_shard.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    ordered = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in ordered] == sorted(r["hilbert"] for r in out)
    return out


def test_shards_of_odd_rows(spark, tmp_path):
    rows = [(i, "é" * (i % 5), f"l{i % 3}", f"src{i % 7}", i * 10) for i in range(60)]
    rows += [(60, None, None, None, None), (None, "", "", "", 0), (7, "same", "l0", "src0", 4), (7, "same", "l0", "src0", 4)]
    check(spark, save(spark, tmp_path, rows), rows)


def test_hot_cell_and_few_rows(spark, tmp_path):
    rows = [(i, "copy", "en", "hot", 4) for i in range(500)]
    check(spark, save(spark, tmp_path / "a", rows), rows)
    few = [(1, "a", "en", "x", 1), (2, "b", "en", "y", 1)]
    check(spark, save(spark, tmp_path / "b", few), few)
    assert check(spark, save(spark, tmp_path / "c", []), []) == []


def test_extra_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "a", 5, 9), (2, "b", 6, 9)], "doc_id long, lang string, position long, shard long")
    out = hilbert.hilbert_shards(df, ["lang"], 2, [F.col("doc_id")])
    assert {(r["doc_id"], r["position"], r["shard"], r["slot"]) for r in out.collect()} == {(1, 5, 0, 0), (2, 6, 1, 0)}


def test_written_shards_have_narrow_ranges(spark, tmp_path):
    rows = [(i, f"src{(i * 7) % 16}", (i * 31) % 1000) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long")
    path = str(tmp_path / "out")
    hilbert.write_shards(hilbert.hilbert_shards(df, ["source", "n_chars"], 16, [F.col("doc_id")]), path)
    back = spark.read.parquet(path)
    assert back.count() == 4000
    spans = back.groupBy("shard").agg(F.countDistinct("source").alias("s"), (F.max("n_chars") - F.min("n_chars")).alias("n")).collect()
    assert sum(r["s"] for r in spans) / 16 <= 8 and sum(r["n"] for r in spans) / 16 <= 600
