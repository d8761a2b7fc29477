"""Operator 7: cross-site boilerplate lines by the spread of distinct sites.

For every line hash a HyperLogLog sketch of the sites that show the line is merged by aggregation. Lines whose
estimate is within BAND standard errors of the threshold get an exact distinct count; the others are decided
by the sketch. Lines on SITES sites or more are boilerplate and go, in every document. Every site that shows a line counts,
whatever else stands on the site or in the text.

A caller may ask that lines which only copies of one whole text show don't count (copied False): those are copied documents,
which document-level deduplication thins out to one, and not boilerplate. Two different texts with the line are enough.

Size. Texts are first reduced to the hashes of their lines, once for each text of a site. A line or a text that makes up one in
FREQUENT of all rows or more is met by a broadcast, which so has a bounded size; the others meet by their keys.

Defined results: null text has no lines and stays null; blank lines (nothing but ASCII white space) are never boilerplate; a
null source is a site of its own; lines are compared exactly; a document's other lines keep their order; repeated
rows are treated alike; an empty table gives an empty result. Columns of the input stay as they are, whatever their
names; n_lines, n_removed and, where there is one, n_chars are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import boxed, materialize, meet, unboxed

SITES = 10
LG_K = 12
#: Relative standard error of a sketch of 2^LG_K registers, and the width of the band that is counted exactly.
ERROR, BAND = 1.04 / 2 ** (LG_K / 2), 5
BLANK = " \t\n\x0b\x0c\r"


def _site(source: str = "source"):
    """The site of a source; never an empty string, which sketches pass over."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def line_hashes(docs: DataFrame) -> DataFrame:
    """(text_key, site, keys, n) of each distinct text of a site: the hashes of its lines in order, null for blank ones, and the
    number of rows."""
    keys = F.transform(F.split("text", "\n"), lambda x: F.when(F.btrim(x, F.lit(BLANK)) != "", F.unhex(F.md5(x))))
    rows = docs.filter("text is not null").select(F.unhex(F.md5("text")).alias("text_key"), _site().alias("site"), keys.alias("keys"))
    return rows.groupBy("text_key", "site").agg(F.first("keys").alias("keys"), F.count("*").alias("n"))


def spread(texts: DataFrame, total: int, sites: int = SITES) -> DataFrame:
    """(line_key, n, several) of the lines that at least so many sites show, from line_hashes() with total lines: in how many texts of
    sites the line is, and whether two of them differ."""
    lines = texts.select("text_key", "site", F.explode(F.array_distinct(F.filter("keys", F.isnotnull))).alias("line_key"))
    about = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about")
    several = (F.min("text_key") < F.max("text_key")).alias("several")
    found = lines.groupBy("line_key").agg(about, F.count("*").alias("n"), several)
    found = materialize(found.filter(F.col("about") >= sites * (1 - BAND * ERROR)), "spread")
    sure = F.col("about") > sites * (1 + BAND * ERROR)
    near = found.filter(~sure).select("line_key", "n")
    pairs = meet(lines.select("line_key", "site"), near, ["line_key"], total).distinct()
    exact = pairs.groupBy("line_key").agg(F.count("*").alias("exact")).filter(F.col("exact") >= sites).select("line_key")
    return found.filter(sure).unionByName(found.filter(~sure).join(exact, "line_key", "left_semi")).drop("about")


def boilerplate(texts: DataFrame, total: int, sites: int = SITES, copied: bool = True) -> DataFrame:
    """(line_key, n) of the lines that go."""
    found = spread(texts, total, sites)
    return found.filter(F.lit(copied) | F.col("several")).select("line_key", "n")


def marks(texts: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """(text_key, site, bad, n): the places of boilerplate lines, for texts that have some."""
    lines = texts.select("text_key", "site", F.col("n").alias("rows"), F.posexplode("keys").alias("at", "line_key")).filter("line_key is not null")
    hit = meet(lines, found, ["line_key"], total)
    return hit.groupBy("text_key", "site").agg(F.collect_list("at").alias("bad"), F.first("rows").alias("n"))


def strip(docs: DataFrame, sites: int = SITES, copied: bool = True) -> DataFrame:
    """docs without boilerplate lines, with n_lines and n_removed; n_chars, where there is one, counts anew."""
    texts = materialize(line_hashes(docs.select("text", "source")), "lines")
    n_lines, n_rows = texts.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = materialize(boilerplate(texts, n_lines, sites, copied), "boilerplate")
    bad = materialize(marks(texts, found, n_lines), "marks")
    rows = boxed(docs, "text", "source").withColumn("site", _site()).drop("source")
    # rows without a text are dealt at random: they meet nothing
    rows = rows.withColumn("text_key", F.coalesce(F.unhex(F.md5("text")), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")).cast("binary")))
    rows = meet(rows, bad, ["text_key", "site"], n_rows, "left") if found.take(1) else rows.withColumn("bad", F.lit(None).cast("array<int>"))
    split, cut = F.split("text", "\n"), F.col("bad").isNotNull()
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("bad")), lambda i: F.get(split, i))
    rows = rows.withColumn("kept", F.when(cut, F.array_join(kept, "\n")).otherwise(F.col("text")))
    new = {
        "text": F.col("kept"),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long"),
        "n_removed": F.when(cut, F.size("bad")).otherwise(0).cast("long"),
    }
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return unboxed(rows, docs.columns, new)
