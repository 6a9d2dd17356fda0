"""License notices by diagonal voting.

Texts and templates are cut into words. A rolling hash of every two and of every three words
of a text is joined with the templates' places of such word grams; a hit at word i of the
text and word j of the template votes for the diagonal i - j, where the template would
start. Votes are counted per diagonal, neighbouring diagonals (at most ``SLACK`` words apart,
as inserted and missing words cause) are merged, and those with enough votes are candidate
spans. A span is verified by its words: a template word counts if the text has it at a diagonal
of the span or up to ``SLACK`` beside it, and ``MIN_SHARE`` of the template's words must count. A
phrase is a template without slack, all of whose words must count.

A template of L words of which m = floor(L / 5) are replaced or missing keeps at least L - 2 - 3 m of
its three-word grams, which is the number of votes asked for; where that would be none, its
two-word grams vote.

Everything is DataFrame code. Templates are a parameter of the program, refused beyond
``MAX_TEMPLATE_WORDS`` words, so their table is bounded whatever the corpus. Grams that hit nothing
end in the task that makes them; hits are few rows and combine before they are shuffled. Texts are
read twice. Candidate spans of up to ``BROADCAST_BYTES`` in all are broadcast to them; if there are
more, texts and spans are shuffled once to meet.

Defined results: a null or empty text has no words, no places, no labels and score 0; rows that
share id and text have equal results; a null id is an id like any other; an empty table gives no
rows; other columns are not looked at, and their names do not matter.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pregao.llm.common import let
from pregao.session import materialise

SLACK = 3
MIN_SHARE = 0.8
MAX_TEMPLATE_WORDS = 20_000
BROADCAST_BYTES = 64_000_000

# What stands between words: ASCII but digits and small letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases to be found word for word, and the label of each.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Opening sentences of public license texts and the usual one-line notices.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC"],
    "creative-commons": ["This work is licensed under a Creative Commons Attribution International License"],
    "cc0": [
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving "
        "all of his or her rights to the work worldwide under copyright law",
    ],
    "gnu": [
        "This work is licensed under the GNU General Public License, version",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files",
    ],
    "mozilla": ["This Source Code Form is subject to the terms of the Mozilla Public License"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrase: bool = False

    @property
    def changes(self) -> int:
        return 0 if self.phrase else int(len(self.words) * (1 - MIN_SHARE) + 1e-9)

    @property
    def gram(self) -> int:
        """Words that vote together."""
        return 3 if len(self.words) - 2 > 3 * self.changes else 2

    @property
    def votes(self) -> int:
        """Votes that a span which can be verified is sure to have."""
        return len(self.words) - self.gram + 1 - self.gram * self.changes


def words_in(text: str) -> tuple[str, ...]:
    return tuple(w for w in re.split(GAP, text.translate(_LOWER)) if w)


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def standard_templates() -> list[Template]:
    phrases = [Template(label, words_in(text), True) for text, label in PHRASES.items()]
    return phrases + [Template(label, words_in(text)) for label, texts in NOTICES.items() for text in texts]


def words(text: str | Column) -> Column:
    """The words of a text; none of null or empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, GAP), lambda w: w != "")


def grams(found: Column) -> Column:
    """Per word the hash of two and of three words from it; null where the words end before."""

    def at(w: Column, i: Column) -> Column:
        second, third = F.get(found, i + 1), F.get(found, i + 2)
        return F.struct(
            F.when(second.isNotNull(), F.xxhash64(w, second)).alias("two"),
            F.when(third.isNotNull(), F.xxhash64(w, second, third)).alias("three"),
        )

    return F.transform(found, at)


def _template_table(spark: SparkSession, templates: list[Template]) -> DataFrame:
    if sum(len(t.words) for t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
    if any(len(t.words) < 2 for t in templates):
        raise ValueError("a template needs two words at least")
    rows = [(n, t.label, list(t.words), t.phrase, t.gram, t.votes) for n, t in enumerate(templates)]
    schema = "template int, label string, template_words array<string>, phrase boolean, gram int, votes int"
    return spark.createDataFrame(rows, schema)


def _template_grams(table: DataFrame) -> DataFrame:
    """(template, phrase, place, two, three): three is null where two words vote."""
    placed = table.select("template", "phrase", "gram", F.posexplode(grams(F.col("template_words"))))
    three = F.when(F.col("gram") == 3, F.col("col.three"))
    whole = placed.filter(F.col("col.two").isNotNull() & (F.col("col.three").isNotNull() | (F.col("gram") == 2)))
    return whole.select("template", "phrase", F.col("pos").alias("place"), F.col("col.two").alias("two"), three.alias("three"))


# What a row is known by: its id and 128 bits of its text.
_KEY = ("_id", "_h1", "_h2")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"),
        F.xxhash64(F.col(key).isNull(), whole).alias("_h1"),
        F.xxhash64(F.lit(1), whole).alias("_h2"),
        F.col(text).alias("_text"),
    )


def spans(keyed: DataFrame, table: DataFrame) -> DataFrame:
    """(row key, template, low, high): candidate spans from their least to their greatest diagonal."""
    # A row per word; the templates are bounded by MAX_TEMPLATE_WORDS.
    rolled = keyed.select(*_KEY, F.posexplode(let(words("_text"), grams)))
    rolled = rolled.select(*_KEY, F.col("pos"), F.col("col.two").alias("two"), F.col("col.three").alias("_three"))
    hits = rolled.join(F.broadcast(_template_grams(table)), "two")
    hits = hits.filter(F.col("three").isNull() | (F.col("three") == F.col("_three")))
    # Rows that share id and text vote once.
    hits = hits.select(*_KEY, "template", "phrase", "place", (F.col("pos") - F.col("place")).alias("diagonal")).distinct()
    votes = hits.groupBy(*_KEY, "template", "phrase", "diagonal").agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy(*_KEY, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(line) > F.when(F.col("phrase"), 0).otherwise(SLACK)
    merged = votes.withColumn("_new", F.coalesce(apart.cast("int"), F.lit(1))).withColumn("span", F.sum("_new").over(line))
    found = merged.groupBy(*_KEY, "template", "span").agg(F.sum("n").alias("n"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    enough = found.join(F.broadcast(table.select("template", "votes")), "template").filter("n >= votes")
    return enough.select(*_KEY, "template", "low", "high")


def _verified(found: Column, template: Column, span: Column) -> Column:
    """Share of the template's words that the text has at or beside the span's diagonals."""
    slack = F.when(template["phrase"], 0).otherwise(SLACK)
    band = F.sequence(span["low"] - slack, span["high"] + slack)

    def counts(word: Column, place: Column) -> Column:
        here = lambda d: (d + place >= 0) & (F.get(found, F.greatest(d + place, F.lit(0))) == word)
        return F.exists(band, lambda d: F.coalesce(here(d), F.lit(False)))

    hit = F.transform(template["words"], counts)
    return F.size(F.filter(hit, lambda h: h)) / F.size(template["words"])


def _measured(found: Column, candidates: Column, templates: list[Template]) -> Column:
    """The verified of a text's candidate spans, by start."""

    def quoted(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    rows = [
        f"struct({quoted(t.label)} AS label, {str(t.phrase).lower()} AS phrase, array({','.join(map(quoted, t.words))}) AS words)"
        for t in templates
    ]
    known = F.expr(f"array({','.join(rows)})")

    def measured(s: Column) -> Column:
        t = F.get(known, s["template"])
        return F.struct(
            F.greatest(s["low"], F.lit(0)).alias("start"),
            F.least(s["high"] + F.size(t["words"]), F.size(found)).alias("end"),
            t["label"].alias("label"),
            t["phrase"].alias("phrase"),
            _verified(found, t, s).alias("share"),
        )

    right = F.filter(F.transform(candidates, measured), lambda s: s["share"] >= F.when(s["phrase"], 1.0).otherwise(MIN_SHARE))
    return F.array_sort(right)


def found_spans(docs: DataFrame, templates: list[Template] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, spans) per row: verified spans with label, phrase, start, end (word numbers) and share.

    Spans are sorted by start. The start of a span is its least diagonal, but at least 0.
    """
    templates = templates or standard_templates()
    table = _template_table(docs.sparkSession, templates)
    keyed = _keyed(docs, key, text)
    entry = F.struct("template", "low", "high")
    listed = spans(keyed, table).groupBy(*_KEY).agg(F.collect_list(entry).alias("_spans"))
    listed = materialise(listed, "license-spans")
    # Rows as they lie in memory: a key of two numbers and the id, and the spans.
    size = listed.agg(F.sum(F.octet_length("_id") + 64 + 32 * F.size("_spans"))).first()[0] or 0
    rows = keyed.join(F.broadcast(listed) if size <= BROADCAST_BYTES else listed, list(_KEY), "left")
    rows = rows.withColumn("_words", words("_text"))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, label: STRING, phrase: BOOLEAN, share: DOUBLE>>)")
    checked = F.when(F.col("_spans").isNull(), none).otherwise(_measured(F.col("_words"), F.col("_spans"), templates))
    return rows.select("doc_id", F.size("_words").cast("long").alias("n_words"), checked.alias("spans"))


def summary(found: DataFrame) -> DataFrame:
    """Per row the phrases' number, first and last place and labels, all labels, and the largest share."""
    phrases = F.filter("spans", lambda s: s["phrase"])

    def labels(spans_: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans_, lambda s: s["label"]))), ",")

    starts = F.transform(phrases, lambda s: s["start"].cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.size(phrases).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(phrases).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )
