"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``MOST``, as even as can be while each source's
expected words meet its target: the rates of greatest entropy are exponentially
tilted by size, ``rate / (MOST - rate) = exp(tilt * size / mean size) / (MOST - 1)``, with one
tilt per source. The tilts solve the convex dual, by Newton steps for all sources at
once, each step one aggregation over (source, size, number of documents). The rates are then
rounded into whole copies: from the largest size down, what rounding leaves over passes
to the next size, so a source ends within about its shortest documents of its target.

Targets: sources in code point order, null last, have weights ``WEIGHTS`` repeating and
share ``SHARE`` of all words; no target exceeds ``MOST`` times its source's words, and what is
above goes to the others by weight until none is above.

Defined results: a null or empty text has size 0 and one copy, and takes no words; a
source without words has target 0; repeated rows are rows of their own; an empty
table gives no rows; extra columns are not looked at. Reruns agree: ties are broken by hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pregao.llm.common import BLANK_CHARS, BLANKS, numbered
from pregao.session import materialise

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
PLACES = 256  # neighbouring places of a source and size that find their share together
TOLERANCE = 1e-10
ROUNDS = 100


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, BLANKS))).cast("long")


# A source as two plain keys, so that null joins like any other.
SOURCE = {"_none": F.isnull, "_source": lambda c: F.coalesce(c.cast("string"), F.lit(""))}


def _with_source(docs: DataFrame) -> DataFrame:
    return docs.withColumns({name: key(F.col("source")) for name, key in SOURCE.items()})


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add ``target`` to rows (_none, _source, source_size), one per source."""
    ranked = numbered(sizes, [F.col(k) for k in SOURCE], "sources")
    place = F.array(*map(F.lit, weights))
    ranked = materialise(ranked.withColumn("weight", F.get(place, (F.col("_position") % len(weights)).cast("int"))), "weights")
    cap = F.col("source_size") * float(most)
    total = ranked.agg(F.sum("source_size")).first()[0]
    if total is None:
        return ranked.withColumn("target", F.lit(0.0)).drop("_position", "weight")
    # The level rises while sources reach their cap, one aggregation of the sources per step.
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level > cap
        fixed, open_, now = ranked.agg(
            F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count_if(above)
        ).first()
        if now == capped or not open_:
            break
        level, capped = (share * total - fixed) / open_, now
    return ranked.withColumn("target", F.least(cap, F.col("weight") * level)).drop("_position", "weight")


def _rate(tilt: Column, size: Column, most: int) -> Column:
    """Rate of a document of this relative size: 1 without tilt, within 0 and ``most``."""
    power = F.greatest(F.least(tilt * size, F.lit(600.0)), F.lit(-600.0))
    return F.lit(float(most)) / (F.lit(1.0) + F.lit(most - 1.0) * F.exp(-power))


def tilts(groups: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """Solve for ``tilt`` per source, given (keys, size, rows) and (keys, source_size, target).

    Newton steps, kept inside the bracket that earlier steps have shown; a step that leaves it
    halves the bracket instead. Sources at their cap need no tilt: ``tilt`` is null there.
    """
    keys = list(SOURCE)
    state = sources.filter(f"target > 0 AND target < source_size * {float(most)} * (1 - 1e-12)")
    counts = groups.filter("size > 0").groupBy(*keys).agg(F.sum("rows").alias("docs"))
    state = state.join(counts, keys).withColumn("mean", F.col("source_size") / F.col("docs"))
    state = state.selectExpr(
        *keys, "target", "mean", "0D AS tilt", "CAST('-Infinity' AS DOUBLE) AS low", "CAST('Infinity' AS DOUBLE) AS high"
    )
    state = materialise(state, "tilts")
    for _ in range(ROUNDS):
        relative = F.col("size") / F.col("mean")
        rate = _rate(F.col("tilt"), relative, most)
        words = F.col("rows") * F.col("size")
        sums = (
            groups.join(state.select(*keys, "mean", "tilt"), keys)
            .groupBy(*keys)
            .agg(F.sum(words * rate).alias("got"), F.sum(words * rate * (1 - rate / most) * relative).alias("slope"))
        )
        off = F.col("got") - F.col("target")
        moved = (
            state.join(sums, keys)
            .withColumn("low", F.when(off < 0, F.col("tilt")).otherwise(F.col("low")))
            .withColumn("high", F.when(off > 0, F.col("tilt")).otherwise(F.col("high")))
            .withColumn("newton", F.when(F.col("slope") > 0, F.col("tilt") - F.try_divide(off, F.col("slope"))))
            .withColumn("off", F.abs(off) / F.col("target"))
        )
        # While one side is open, a step goes no further than twice the distance from zero and one more.
        low = F.when(F.col("low") > F.lit(float("-inf")), F.col("low")).otherwise(F.lit(-1.0) + 2 * F.least("tilt", F.lit(0.0)))
        high = F.when(F.col("high") < F.lit(float("inf")), F.col("high")).otherwise(F.lit(1.0) + 2 * F.greatest("tilt", F.lit(0.0)))
        inside = F.col("newton").between(low, high)
        tilt = F.when(F.col("off") <= TOLERANCE, F.col("tilt")).when(inside, F.col("newton"))
        outside = F.when(F.isnan(low + high), F.col("tilt")).otherwise((low + high) / 2)
        edge = F.when(F.col("newton") > high, high).when(F.col("newton") < low, low)
        open_side = (F.col("low") == F.lit(float("-inf"))) | (F.col("high") == F.lit(float("inf")))
        state = materialise(
            moved.withColumn("tilt", tilt.otherwise(F.when(open_side, F.coalesce(edge, outside)).otherwise(outside))).drop(
                "got", "slope", "newton"
            ),
            "tilts",
        )
        worst = state.agg(F.max("off")).first()[0]
        state = state.drop("off")
        if worst is None or worst <= TOLERANCE:
            break
    return sources.join(state.select(*keys, "mean", "tilt"), keys, "left")


def _round(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """Whole copies per size of one source: what a size leaves over passes to the next smaller one."""
    rows = rows.sort_values("size", ascending=False, kind="stable")
    carry, copies = 0.0, []
    for size, n, rate in zip(rows["size"].tolist(), rows["rows"].tolist(), rows["rate"].tolist(), strict=True):
        wanted = n * rate + (carry / size if size else 0.0)
        k = min(max(int(np.floor(wanted + 0.5)), 0), most * n)
        carry += (n * rate - k) * size
        copies.append(k)
    rows["copies_of_size"] = copies
    return rows[["_none", "_source", "size", "copies_of_size"]]


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) per row of ``docs``."""
    return _mixed(docs, weights, share, most).drop("_text")


def _mixed(docs: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """The rows of ``mix``, and a hash of each text.

    A group for rounding is one source's distinct sizes, so its length is bounded by the
    longest text, not by the number of documents; rows of one source and size are told apart by
    their place in a table sorted by hash, however many they are.
    """
    keys = list(SOURCE)
    measured = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"))
    measured = materialise(_with_source(measured), "sizes")
    order = [*map(F.col, keys), F.col("size"), F.xxhash64("doc_id"), F.col("doc_id"), F.col("_text")]
    ranked = numbered(measured, order, "sizes-in-order")
    groups = materialise(
        ranked.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("rows"), F.min("_position").alias("first")), "size-counts"
    )
    sources = groups.groupBy(*keys).agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    solved = materialise(tilts(groups, materialise(targets(sources, weights, share, most), "targets"), most), "solved")
    # Without a tilt a source is at its cap, or has no words.
    rate = F.when(F.col("tilt").isNotNull(), _rate(F.col("tilt"), F.col("size") / F.col("mean"), most))
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.coalesce(rate, F.when(F.col("target") > 0, float(most)).otherwise(0.0)))
    rated = groups.join(solved, keys).withColumn("rate", rate)
    whole = rated.select(*keys, "size", "rows", "rate").groupBy(*keys).applyInPandas(
        lambda rows: _round(rows, most), "_none boolean, _source string, size long, copies_of_size long"
    )
    shares = rated.drop("rate", "mean", "tilt").join(whole, [*keys, "size"])
    # Any number of rows may have one source and size, so shares go to stretches of their places.
    stretch = F.expr(f"_position DIV {PLACES}").alias("_stretch")
    stretches = F.sequence(F.expr(f"first DIV {PLACES}"), F.expr(f"(first + rows - 1) DIV {PLACES}"))
    shares = shares.withColumn("_stretch", F.explode(stretches))
    place = F.col("_position") - F.col("first")
    copies = F.expr("copies_of_size DIV rows") + (place < F.expr("copies_of_size % rows")).cast("long")
    return ranked.select("*", stretch).join(shares, [*keys, "size", "_stretch"]).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "_text"
    )


def copied(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Copies come back to rows of the same id, source and text; only rows that share all three meet in
    a task, and which of them are copied more often is not told apart.
    """
    keys = ["_id", *SOURCE, "_size", "_text"]
    found = _with_source(_mixed(docs, weights, share, most))
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    times = found.groupBy(identity.alias("_id"), *SOURCE, F.col("size").alias("_size"), "_text").agg(
        *[F.count_if(F.col("copies") >= c).alias(f"_at_least_{c}") for c in range(1, most + 1)]
    )
    same = Window.partitionBy(*keys).orderBy("_text")
    rows = _with_source(docs).withColumns({"_id": identity, "_size": word_count(F.col("text")), "_text": F.xxhash64("text")})
    rows = rows.join(times, keys).withColumn("_row", F.row_number().over(same))
    count = sum(((F.col("_row") <= F.col(f"_at_least_{c}")).cast("int") for c in range(1, most + 1)), F.lit(0))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), count))).filter("_copy > 0").select(docs.columns)
