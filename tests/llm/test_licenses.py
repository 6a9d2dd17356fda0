from __future__ import annotations

import random
import re

import duckdb
import pytest

from pregao.llm import licenses
from pregao.llm.queries import op13_diagonal_licenses, oracle_sql

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
MIT = licenses.NOTICES["mit"][1]


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_base(doc_id, text):
    words = plain_words(text)
    places = [
        (i, label)
        for phrase, label in licenses.PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def run(spark, tmp_path, rows, name="t"):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, template string")
    docs.repartition(3).write.parquet(str(tmp_path / name / "documents.parquet"))
    found = op13_diagonal_licenses(spark, str(tmp_path / name))
    assert found.columns == COLUMNS
    rows = sorted(map(tuple, found.collect()), key=str)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
    sql = db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({oracle_sql()['op13_diagonal_licenses']}) q").fetchall()
    assert sorted(sql, key=str) == rows
    return rows


def test_places_equal_those_of_a_plain_search(spark, tmp_path):
    rng = random.Random(2)
    bag = ["cc", "by", "CC BY", "general", "public", "License", "all", "rights", "reserved", "é", "x9", "All Rights", "-"]
    rows = [(i, rng.choice([" ", ", ", "\n\0", "_"]).join(rng.choice(bag) for _ in range(rng.randrange(40)))) for i in range(300)]
    found = run(spark, tmp_path, rows)
    assert [r[:6] for r in found] == sorted((plain_base(i, t) for i, t in rows), key=str)
    assert sum(r[2] for r in found) > 50


def test_texts_of_all_kinds(spark, tmp_path):
    far = "word " * 40_000
    rows = [
        (1, None),
        (2, ""),
        (3, "..., --"),
        (4, "All rights reserved"),
        (4, "All rights reserved"),
        (4, "All rights are reserved"),
        (None, "CC-BY"),
        (None, "ÀCC BY"),
        (5, far + MIT + " " + far + "all rights reserved"),
        (6, "cc"),
    ]
    found = {(r[0], r[1]): r[2:] for r in run(spark, tmp_path, rows)}
    assert found[1, 0] == found[2, 0] == found[3, 0] == (0, None, None, "", "", 0.0)
    assert found[4, 3] == (1, 0, 0, "reserved", "reserved", 1.0)
    assert found[4, 4][:1] == (0,)
    assert found[None, 2] in ((1, 0, 0, "cc-by", "cc-by", 1.0), (0, None, None, "", "", 0.0))
    n = len(plain_words(MIT))
    assert found[5, 80_000 + n + 3] == (1, 80_000 + n, 80_000 + n, "reserved", "mit,reserved", 1.0)
    assert len(run(spark, tmp_path, [], "none")) == 0


def changed(words, edits, rng):
    words = list(words)
    for place in sorted(rng.sample(range(1, len(words) - 1), edits), reverse=True):
        kind = rng.randrange(3)
        if kind == 0:
            words[place] = "zzz"
        elif kind == 1:
            del words[place]
        else:
            words.insert(place, "zzz")
    return words


def test_every_span_with_few_changes_is_found(spark, tmp_path):
    """A fifth of a template's words replaced, missing or interrupted, wherever that is."""
    rng = random.Random(9)
    rows, want = [], {}
    for t in licenses.standard_templates():
        if t.phrase:
            continue
        for _ in range(8):
            edits = int(len(t.words) * 0.2)
            text = " ".join(["noise"] * rng.randrange(9) + changed(t.words, edits, rng) + ["noise"] * 5)
            want[len(rows)] = t.label
            rows.append((len(rows), text))
    found = {r[0]: r for r in run(spark, tmp_path, rows)}
    missed = [(i, rows[i][1]) for i, label in want.items() if label not in found[i][6].split(",")]
    assert not missed
    assert all(r[7] >= licenses.MIN_SHARE for r in found.values())


def test_half_a_template_is_not_one(spark, tmp_path):
    words = licenses.words_in(MIT)
    rows = [(0, " ".join(words[: len(words) // 2])), (1, " ".join(reversed(words))), (2, "this software is hereby granted")]
    assert {r[6] for r in run(spark, tmp_path, rows)} == {""}


def test_spans_and_own_templates(spark):
    docs = spark.createDataFrame([("a", "x the quick brown fox y the quick brown fox")], "name string, body string")
    own = [licenses.Template("fox", ("quick", "brown", "fox")), licenses.Template("the", ("the", "quick"), True)]
    found = licenses.found_spans(docs, own, "name", "body").first()
    assert [(s["start"], s["end"], s["label"], s["share"]) for s in found["spans"]] == [
        (1, 3, "the", 1.0), (2, 5, "fox", 1.0), (6, 8, "the", 1.0), (7, 10, "fox", 1.0)
    ]
    with pytest.raises(ValueError, match="two words"):
        licenses.found_spans(docs, [licenses.Template("a", ("a",))], "name", "body")
    with pytest.raises(ValueError, match="more than"):
        licenses.found_spans(docs, [licenses.Template("a", ("a",) * 60_000)], "name", "body")


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, "all rights reserved")], "doc_id long, text string")
    plan = licenses.summary(licenses.found_spans(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_spans_too_large_to_broadcast_are_shuffled(spark, monkeypatch):
    rows = [(i % 40, f"a {'x ' * (i % 7)}all rights reserved {MIT}") for i in range(120)] + [(None, None), (None, "cc by")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small = sorted(map(str, licenses.found_spans(docs).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = licenses.found_spans(docs)
        assert sorted(map(str, large.collect())) == small
        assert "SortMergeJoin" in large._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
