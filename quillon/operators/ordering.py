"""Global order without one task: rows are dealt by ranges of the order, and each range is offset by the sums of those before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.storage import materialize


def running(df: DataFrame, order: Sequence[str], amount: Column, name: str = "_before") -> DataFrame:
    """df with the sum of amount over all rows before each in the order of columns, which must be a total one."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_amount", amount).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    rows = materialize(rows, "ranges")
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = rows.groupBy("_range").agg(F.sum("_amount").alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(ranges), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_offset") + F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return out.drop("_amount", "_range", "_offset")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with the number of each row, from 0, in the order of columns."""
    return running(df, order, F.lit(1), name)


def quantiles(df: DataFrame, value: Column, qs: Sequence[float]) -> DataFrame:
    """One row (n, q0, q1, ...): exact linear quantiles of the values that aren't null; no buffer holds more than a range of them."""
    counts = df.select(value.cast("double").alias("_v")).filter("_v is not null").groupBy("_v").agg(F.count("*").alias("_c"))
    ranked = materialize(running(counts, ["_v"], F.col("_c")), "ranked")
    total = ranked.agg(F.sum("_c").alias("n"))
    out = [F.coalesce(F.max("n"), F.lit(0)).alias("n")]
    for i, q in enumerate(qs):
        place = (F.col("n") - 1) * F.lit(float(q))
        at = lambda r: F.max(F.when((F.col("_before") <= r) & (r < F.col("_before") + F.col("_c")), F.col("_v")))
        low, high = at(F.floor(place)), at(F.ceil(place))
        share = F.max(place - F.floor(place))
        out.append(F.when(low == high, low).otherwise(low + share * (high - low)).alias(f"q{i}"))
    return ranked.crossJoin(F.broadcast(total)).agg(*out)


#: Values of a group that one buffer or one window may hold.
MOST = 1 << 20


def _keyed(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(_k, _v): the keys as one struct, in which nulls are equal, and the values that aren't null."""
    return df.select(F.struct(*keys).alias("_k"), value.cast("double").alias("_v")).filter("_v is not null")


def ranged(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """counts (_k, _v, _c, ...) with _before, the sum of _c in the group of _k before each _v, and _range; and the (_k, _range, _offset, _sum) of the
    ranges that a group lies in. At most one group a range goes on from an earlier one, so few offsets are broadcast."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(counts.repartitionByRange(n, "_k", "_v").withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # ranges of one group
    spans = rows.groupBy("_k", "_range").agg(F.sum("_c").alias("_sum"))
    spans = materialize(spans.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))), "spans")
    going_on = F.broadcast(spans.filter("_offset > 0").select("_k", "_range", "_offset"))  # one row a range at most
    inside = Window.partitionBy("_k", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_c").over(inside), F.lit(0)) + F.coalesce("_offset", F.lit(0))
    placed = rows.join(going_on, ["_k", "_range"], "left").withColumn("_before", before).drop("_offset")
    return placed, spans


def _split(rows: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows (_k, ...) of groups of at most so many, and those of larger ones, if there are any."""
    large = rows.groupBy("_k").agg(F.count("*").alias("_n")).filter(F.col("_n") > (MOST if most is None else most))
    large = materialize(large.select("_k"), "groups")
    if large.isEmpty():
        return rows, None
    return rows.join(large, "_k", "left_anti"), rows.join(large, "_k", "left_semi")


def ranked(df: DataFrame, keys: Sequence[str], value: Column, most: int | None = None) -> DataFrame:
    """(keys, _v, _c, _before): the distinct values of each group with their counts, and how many of the group are smaller. Groups
    of more than `most` values are dealt by ranges of them."""
    small, large = _split(_keyed(df, keys, value).groupBy("_k", "_v").agg(F.count("*").alias("_c")), most)
    inside = Window.partitionBy("_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    out = small.withColumn("_before", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    if large is not None:
        out = out.unionByName(ranged(large)[0].drop("_range"))
    return out.select(*(F.col("_k")[k].alias(k) for k in keys), "_v", "_c", "_before")


def _group_quantiles(counts: DataFrame, qs: Sequence[float]) -> DataFrame:
    """(_k, _q) by ranges: the places of the quantiles are looked up in the ranges that hold them."""
    placed, spans = ranged(counts)
    total = spans.groupBy("_k").agg(F.sum("_sum").alias("_n"))
    places = F.array(*(F.struct(F.lit(i).alias("i"), ((F.col("_n") - 1) * F.lit(float(q))).alias("at")) for i, q in enumerate(qs)))
    wanted = total.select("_k", F.inline(places)).withColumn("end", F.explode(F.array(F.floor("at"), F.ceil("at"))))
    wanted = wanted.distinct().join(spans, "_k").filter("end >= _offset and end < _offset + _sum").select("_k", "_range", "i", "at", "end")
    hit = placed.join(wanted, ["_k", "_range"]).filter("_before <= end and end < _before + _c")
    low, high, share = F.min("_v"), F.max("_v"), F.first(F.col("at") - F.floor("at"))
    ends = hit.groupBy("_k", "i").agg(F.when(low == high, low).otherwise(low + share * (high - low)).alias("v"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])
    return ends.groupBy("_k").agg(listed.alias("_q"))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: Column, qs: Sequence[float], most: int | None = None) -> DataFrame:
    """(keys, _q): exact linear quantiles of each group with a value that isn't null, as an array. Groups of more than `most` rows
    are dealt by ranges of (keys, value), so that no buffer, window or task holds a group, however large it is."""
    small, large = _split(_keyed(df, keys, value), most)
    out = small.groupBy("_k").agg(F.percentile("_v", list(qs)).alias("_q"))
    if large is not None:
        out = out.unionByName(_group_quantiles(large.groupBy("_k", "_v").agg(F.count("*").alias("_c")), qs))
    return out.select(*(F.col("_k")[k].alias(k) for k in keys), "_q")


def with_quantiles(groups: DataFrame, df: DataFrame, keys: Sequence[str], value: Column, names: dict[str, float], most: int | None = None) -> DataFrame:
    """groups, one row for each of the keys, with the named quantiles of df's values; null for groups without any."""
    own = [c for c in groups.columns if c not in names]
    if keys:
        found = group_quantiles(df, keys, value, list(names.values()), most).select(F.struct(*keys).alias("_k"), "_q")
        joined = groups.select(*own, F.struct(*keys).alias("_k")).join(found, "_k", "left")
        parts = [F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)]
    else:
        joined = groups.select(*own).crossJoin(F.broadcast(quantiles(df, value, list(names.values())).drop("n")))  # one row
        parts = [F.col(f"q{i}").alias(n) for i, n in enumerate(names)]
    return joined.select(*own, *parts)
