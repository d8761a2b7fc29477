"""Operator 2: mixing sources to target weights by capped water-filling, DataFrame functions only.

Sources weigh WEIGHTS in turn, in the order of their code points, null last. Together they share all
words; a source whose share is above MOST times its size gets just that, and the excess goes to the
others by weight until none is above. A document is then repeated whole as often as its source is, and
a seeded order of the source's documents decides which get one repetition more: those before the point
where the source's target is met, to half a document.

Defined results: null text has size 0; a null source is a source of its own; documents without words
are taken zero times; repeated rows count each; an empty table gives an empty result. Columns of the
input stay as they are, whatever their names; mix replaces those named like a result column, repeated none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, boxed, materialize, unboxed, whole_text

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 17
#: Slices of the seeded order: a hot source's documents never meet in one task.
SLICES = 4096
ADDED = ("size", "source_size", "target", "repetitions", "taken")


def order_key(doc_id: Column, seed: int = SEED) -> Column:
    """A seeded number below 2^60 that any engine with md5 can work out."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame) -> DataFrame:
    """(source, source_size) with target: one row for each source, so the ordered windows hold no documents.

    Sorted by cap over weight, a source is full if its cap is at most what a share of the rest would give
    it; full sources are a prefix of that order, and the level at the first one after it holds for the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    s = sources.withColumn("weight", F.element_at(weights, (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("double"))
    s = s.withColumn("cap", F.col("source_size").cast("double") * MOST).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("full_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything).cast("double") - F.col("full_before")) / F.col("weight_left"))
    s = s.withColumn("full", F.col("ratio") <= F.col("level"))
    s = s.withColumn("rest", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("rest") * F.col("weight")).alias("target"))


def _mixed(docs: DataFrame, seed: int, keep: Sequence[str] | None = None) -> DataFrame:
    """The rows of docs, boxed, with size, source_size, target, repetitions and taken."""
    rows = boxed(docs, "text", "doc_id", "source", keep=keep).withColumn("size", F.regexp_count(whole_text(), F.lit(WORD)).cast("long"))
    rows = rows.withColumn("u", order_key(F.col("doc_id"), seed)).withColumn("slice", F.shiftright("u", 60 - SLICES.bit_length() + 1).cast("int"))
    rows = rows.withColumn("key", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    slices = rows.groupBy("key", "none", "slice").agg(F.first("source").alias("source"), F.sum("size").alias("slice_size"))
    before = Window.partitionBy("key", "none").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = materialize(slices.withColumn("before", F.coalesce(F.sum("slice_size").over(before), F.lit(0))), "slices")
    totals = slices.groupBy("key", "none").agg(F.first("source").alias("source"), F.sum("slice_size").alias("source_size"))
    filled = water_fill(totals).withColumn("key", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull()).drop("source")
    facts = slices.select("key", "none", "slice", "before").join(filled, ["key", "none"])
    keys = ["key", "none", "slice"]
    inside = Window.partitionBy(*keys).orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    ahead = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    more = F.when((F.col("size") > 0) & (2 * ahead + F.col("size") <= 2 * rest), 1).otherwise(0)
    mixed = rows.drop("text").join(facts, keys).withColumn("repetitions", (whole + more).cast("long"))
    return mixed.withColumn("taken", F.col("repetitions") * F.col("size"))


def mix(docs: DataFrame, seed: int = SEED, keep: Sequence[str] | None = None) -> DataFrame:
    """docs, or the columns to keep, with size, source_size, target, repetitions and taken (words, repeats counted), which replace
    columns of these names. Texts that aren't kept aren't shuffled."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    return unboxed(_mixed(docs, seed, kept), kept, {c: F.col(c) for c in ADDED})


def repeated(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs as they are."""
    rows = _mixed(docs, seed).filter("repetitions > 0 and size > 0")
    return unboxed(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repetitions").cast("int")))), docs.columns, {})
