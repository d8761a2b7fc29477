"""Projections, lookup joins, set operations, sorts and top-k."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ordering import numbered


# --- columns -------------------------------------------------------------------------------------------------


def reorder(df: DataFrame, order: Sequence[str], rest: bool = False) -> DataFrame:
    """Known columns in the given order; the others are dropped, or follow."""
    known = [c for c in order if c in df.columns]
    return df.select(*known, *([c for c in df.columns if c not in known] if rest else []))


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Df, or an error that lists the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def accept_inputs(df: DataFrame, checks: Sequence[tuple[Column, str]], warn_only: bool = False) -> DataFrame:
    """Reason, the ';' list of the checks that hold, and accepted: no reason, or always where they only warn."""
    listed = F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in checks)))
    return df.withColumn("reason", F.concat_ws(";", listed)).withColumn("accepted", F.lit(True) if warn_only else F.col("reason") == "")


def region_qc(regions: DataFrame, min_area: float, min_edge: float) -> DataFrame:
    """small_area and near_edge; the edge distance is the least of the four gaps to the image's borders."""
    edge = F.least(F.col("x0"), F.col("y0"), F.col("width") - F.col("x1"), F.col("height") - F.col("y1"))
    df = regions.withColumn("edge_distance", edge)
    return accept_inputs(df, [(F.col("area") < min_area, "small_area"), (F.col("edge_distance") < min_edge, "near_edge")])


def threshold_filter(df: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """P20: rows above (strictly) or below each threshold; a missing value counts as 0."""
    for column, (side, limit) in rules.items():
        value = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
        df = df.filter(value > limit if side.lower() == "above" else value < limit)
    return df


def min_length(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Groups of n rows or more."""
    big = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= n).select(*keys)
    return df.join(big, list(keys), "left_semi")


def even_sample(df: DataFrame, n: int, order: Sequence[str], keys: Sequence[str] = (), prefer: Column | None = None) -> DataFrame:
    """Rows at round(linspace(0, len - 1, n)) of each group; where some rows are preferred, only these."""
    if prefer is not None:
        df = df.withColumn("_p", F.coalesce(prefer.cast("int"), F.lit(0)))
        df = df.withColumn("_m", F.max("_p").over(Window.partitionBy(*keys))).filter("_p = _m").drop("_p", "_m")
    by = Window.partitionBy(*keys)
    df = df.withColumn("_i", F.row_number().over(by.orderBy(*order)) - 1).withColumn("_len", F.count("*").over(by))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.rint(k * (F.col("_len") - 1) / F.lit(float(max(1, n - 1)))).cast("int"))
    return df.filter(F.array_contains(at, F.col("_i"))).drop("_i", "_len")


def common_keys_of_all(df: DataFrame, item: str, unit: str, value: str) -> DataFrame:
    """Items (frames) whose value is there for every unit."""
    units = df.agg(F.count_distinct(unit).alias("_units"))
    full = df.filter(F.col(value).isNotNull()).groupBy(item).agg(F.count_distinct(unit).alias("_n"))
    return df.join(full.crossJoin(F.broadcast(units)).filter("_n = _units").select(item), item, "left_semi")


# --- joins ---------------------------------------------------------------------------------------------------


def map_column(df: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join to a dimension; missing keys give null. Spark broadcasts dim if its size allows."""
    return df.join(dim, on, "left")


def join_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on all shared columns."""
    return a.join(b, [c for c in a.columns if c in b.columns], "inner")


def combine_by(dfs: dict[str, DataFrame], key: str) -> DataFrame:
    """Data sets joined (full outer) on a key; other columns carry the label."""
    named = [df.select(key, *(F.col(c).alias(f"{c}_{label}") for c in df.columns if c != key)) for label, df in dfs.items()]
    return reduce(lambda a, b: a.join(b, key, "full"), named)


def annotate_hits(cands: DataFrame, hits: DataFrame, key: str, keep_unique: bool = True) -> DataFrame:
    """Stale hit columns replaced; no hit is 0 and not unique; then unique rows only."""
    stale = [c for c in hits.columns if c != key and c in cands.columns]
    out = cands.drop(*stale).join(hits, key, "left").withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("unique", F.coalesce("unique", F.lit(False)))
    return out.filter("unique") if keep_unique else out


def with_group_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and sample standard deviation of the group (0 for one row) on each row; one shuffle by the group."""
    stats = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias(f"{value}_median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"{value}_std"))
    return df.join(stats, list(keys), "left")


def join_near_metric(hubs: DataFrame, near: DataFrame, key: str = "hub_id") -> DataFrame:
    """Rows without the metric go."""
    return hubs.join(near, key, "inner")


def dual_channel(a: DataFrame, b: DataFrame, keys: Sequence[str], labels: tuple[str, str]) -> DataFrame:
    """Two curve summaries on their bin keys; the second may be missing."""
    left, right = (d.select(*keys, *(F.col(c).alias(f"{c}_{l}") for c in d.columns if c not in keys)) for d, l in zip((a, b), labels, strict=True))
    return left.join(right, list(keys), "left")


def apply_review(rows: DataFrame, review: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Review columns by key, blank where there is none."""
    out = rows.drop(*columns).join(review.select(*keys, *columns), list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


def pair_files(files: DataFrame, key: Column, channel: Column, channels: tuple[str, str]) -> DataFrame:
    """(key, first path, second path) where both channels are there."""
    keyed = files.select(key.alias("key"), F.lower(channel).alias("channel"), "path")
    one, two = (keyed.filter(F.col("channel") == c).select("key", F.col("path").alias(f"{c}_path")) for c in channels)
    return one.join(two, "key")


def missing_grid(files: DataFrame, keys: Sequence[str], t: str = "t", z: str = "z") -> DataFrame:
    """All observed t times all observed z of a group, less what is present."""
    grid = files.select(*keys, t).distinct().join(files.select(*keys, z).distinct(), list(keys))
    return grid.join(files.select(*keys, t, z).distinct(), [*keys, t, z], "left_anti")


def complete_grid(files: DataFrame, keys: Sequence[str], t: str = "t", z: str = "z", policy: str = "drop_t") -> DataFrame:
    """Files without incomplete time points (drop_t) or without incomplete groups (skip_group); or an error (fail)."""
    gaps = missing_grid(files, keys, t, z)
    if policy == "drop_t":
        return files.join(gaps.select(*keys, t).distinct(), [*keys, t], "left_anti")
    if policy == "skip_group":
        return files.join(gaps.select(*keys).distinct(), list(keys), "left_anti")
    n = gaps.agg(F.count("*").alias("_gaps"))
    return files.crossJoin(F.broadcast(n)).withColumn("_ok", F.when(F.col("_gaps") > 0, F.raise_error(F.lit("incomplete grid")).cast("boolean")).otherwise(True)).filter("_ok").drop("_gaps", "_ok")


def contiguous(files: DataFrame, keys: Sequence[str], z: str = "z") -> DataFrame:
    """(keys, contiguous): the slices are an unbroken run of numbers."""
    return files.groupBy(*keys).agg((F.max(z) - F.min(z) + 1 == F.count_distinct(z)).alias("contiguous"))


def reindex(df: DataFrame, key: str, values: Sequence, count: str) -> DataFrame:
    """One row for each listed key, in list order; missing counts are 0 with status NA."""
    listed = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"position int, {key} {df.schema[key].dataType.simpleString()}")
    out = listed.join(df, key, "left").withColumn("status", F.when(F.col(count).isNull(), "NA").otherwise("ok"))
    return out.withColumn(count, F.coalesce(count, F.lit(0))).orderBy("position")


def unassigned(all_ids: DataFrame, assigned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids of all that aren't assigned."""
    return all_ids.select(*keys).distinct().join(assigned, list(keys), "left_anti")


def with_reference(df: DataFrame, value: str, condition: str, base: str, date: str, ref: str, ref_date: str, keys: Sequence[str] = ()) -> DataFrame:
    """Reference and delta = value - reference. The reference is the mean over the rows whose base condition is the one a
    row names (ref), of the date it names (ref_date null: any date); if there are none, over the rows whose condition starts
    with that name; else null. Means are taken once for each named pair, not for each row, and don't depend on the order of the rows; names meet conditions by an equi-join on
    the beginnings of the lengths that names have."""
    named = df.select(*keys, F.trim(ref).alias("_ref"), F.col(ref_date).alias("_rd")).filter("_ref is not null").distinct()
    v = F.col(value).cast("double")
    coarse = F.rint(v * 1024) / 1024  # sums of these are exact up to 2^43, and those of what is left round far below the mean's last bit
    coarse = F.when(F.isnan(coarse) | (F.abs(v) > 2.0**43), v).otherwise(coarse)
    fine = F.when(v == coarse, 0.0).otherwise(v - coarse)
    rows = df.groupBy(*keys, F.col(condition).alias("_c"), F.col(base).alias("_b"), F.col(date).alias("_d")).agg(F.sum(coarse).alias("_s"), F.sum(fine).alias("_f"), F.count(value).alias("_n"))
    when = F.col("_rd").isNull() | (F.col("_rd") == F.col("_d"))
    mean = F.try_divide(F.sum("_s") + F.sum("_f"), F.sum("_n"))

    def of(match) -> DataFrame:
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
        on = match & when
        for c in same:
            on = on & c
        return named.alias("n").join(rows.alias("r"), on).groupBy(*(F.col(f"n.{k}").alias(k) for k in keys), "_ref", "_rd").agg(mean.alias("_m"))

    exact = of(F.col("_b") == F.col("_ref")).withColumnRenamed("_m", "_exact")
    widths = F.broadcast(named.select(F.length("_ref").alias("_k")).distinct())  # no more rows than the longest name has letters
    rows = rows.crossJoin(widths).filter(F.length("_c") >= F.col("_k")).withColumn("_p", F.left("_c", F.col("_k")))
    prefix = of(F.col("_p") == F.col("_ref")).withColumnRenamed("_m", "_prefix")
    facts = named
    for other in (exact, prefix):
        o = other.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_ref").alias("_r2"), F.col("_rd").alias("_d2"), other.columns[-1])
        on = (F.col("_ref") == F.col("_r2")) & F.col("_rd").eqNullSafe(F.col("_d2"))
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        facts = facts.join(o, on, "left").drop("_r2", "_d2", *(f"_k{i}" for i in range(len(keys))))
    facts = facts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_ref", "_rd", F.coalesce("_exact", "_prefix").alias("reference"))
    on = (F.trim(ref) == F.col("_ref")) & F.col(ref_date).eqNullSafe(F.col("_rd"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = df.join(facts, on, "left").drop("_ref", "_rd", *(f"_k{i}" for i in range(len(keys))))
    return out.withColumn("delta", F.col(value) - F.col("reference"))


# --- set operations and reshaping ----------------------------------------------------------------------------


def union(dfs: Sequence[DataFrame]) -> DataFrame:
    """Rows of all, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key; empty or null keys go."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return first_per_key(df, keys, order)


def unique_across(a: DataFrame, b: DataFrame, key: str, order: Sequence) -> DataFrame:
    """One row for each key, of the first source if it has it."""
    both = a.withColumn("source_rank", F.lit(0)).unionByName(b.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, [key], ["source_rank", *order])


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U4: keys that both have."""
    return a.select(*keys).intersect(b.select(*keys))


def minus(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of a that b hasn't."""
    return a.select(*keys).subtract(b.select(*keys))


def pivot_counts(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, agg: Column | None = None) -> DataFrame:
    """One column for each listed value; the list keeps Spark from scanning for values."""
    out = df.groupBy(*keys).pivot(column, list(values)).agg(agg if agg is not None else F.count(F.lit(1)))
    return out if agg is not None else out.fillna(0, [str(v) for v in values])


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "Primer", value: str = "val") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(values), name, value)


def upsert(df: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with an updated key are replaced, new ones appended."""
    return df.join(updates, list(keys), "left_anti").unionByName(updates, allowMissingColumns=True)


def add_handle(oligos: DataFrame, handles: dict[str, str], handle: str, order: Sequence, sequence: str = "sequence") -> DataFrame:
    """Handle sequence in front, with rank and length; an unknown handle is an error."""
    if handle not in handles:
        raise KeyError(f"unknown handle {handle!r}; known: {', '.join(sorted(handles))}")
    out = oligos.withColumn("handle", F.lit(handle)).withColumn("full_sequence", F.concat(F.lit(handles[handle]), sequence)).withColumn("full_length", F.length("full_sequence"))
    return numbered(out, order, "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def odd_even(df: DataFrame, within: Sequence[str], order: Sequence, into: str = "odd") -> DataFrame:
    """True for the first, third, ... row of a group in order."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*within).orderBy(*order)) % 2 == 1)


def top_unique(df: DataFrame, within: Sequence[str], place: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first row of each place (a rounded pixel) in order, then the first n of each group."""
    return first_per_key(first_per_key(df, [*within, *place], order), within, order, n)


def validate(df: DataFrame, checks: dict[str, Column], least_rows: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, check, failed, ok): rows that fail each named condition (null fails), and whether there are enough rows; one
    aggregation for all checks, and never an early end."""
    sums = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks.values())]
    out = df.groupBy(*keys).agg(F.count("*").alias("_rows"), *sums)
    named = [F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("failed")) for i, n in enumerate(checks)]
    rows = F.struct(F.lit("rows").alias("check"), F.greatest(F.lit(least_rows) - F.col("_rows"), F.lit(0)).cast("long").alias("failed"))
    return out.select(*keys, F.explode(F.array(*named, rows)).alias("c")).select(*keys, "c.check", "c.failed", (F.col("c.failed") == 0).alias("ok"))


# --- sorts and top-k -----------------------------------------------------------------------------------------


def sort(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """O1, O3: (column, ascending), nulls last."""
    return df.orderBy(*(F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys))


def order_by_list(df: DataFrame, column: str, values: Sequence, drop_others: bool = False) -> DataFrame:
    """O2: sorted by place in the list; other values become null and come last, or go."""
    at = F.array_position(F.array(*map(F.lit, values)), F.col(column))
    out = df.withColumn("_at", F.when(at > 0, at))
    out = out.filter("_at is not null") if drop_others else out.withColumn(column, F.when(F.col("_at").isNotNull(), F.col(column)))
    return out.orderBy(F.col("_at").asc_nulls_last()).drop("_at")


def rank_by(df: DataFrame, keys: Sequence[Column], into: str = "rank", within: Sequence[str] = ()) -> DataFrame:
    """Place in the order of composite keys (with defaults for nulls in the keys)."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*within).orderBy(*keys)))


def top(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """The first n rows."""
    return df.orderBy(*order).limit(n)


def select_tier(df: DataFrame, tier: Column, order: Sequence, n: int, within: Sequence[str] = ()) -> DataFrame:
    """Of each group the rows of the best tier that has any, the first n."""
    out = df.withColumn("_tier", tier)
    out = out.withColumn("_best", F.min("_tier").over(Window.partitionBy(*within))).filter("_tier = _best").drop("_tier", "_best")
    return first_per_key(out, within, order, n)


def top_per_key(df: DataFrame, key: str, order: Sequence, n: int, passing: Column) -> DataFrame:
    """The first passing row of each key in rank order, n keys."""
    return first_per_key(df.filter(passing), [key], order).orderBy(*order).limit(n)


def argmax_row(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Of each group the row that is largest by the given expressions."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def subsample(df: DataFrame, keys: Sequence[str], n: int, unique: Sequence[str], seed: int = 0) -> DataFrame:
    """N rows of each group without replacement, by a seeded hash of the unique columns, so that reruns agree."""
    return first_per_key(df, keys, [F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in unique))), *unique], n)


def sample_rows(df: DataFrame, p: float, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """About a share p of the rows: those whose keys a seeded md5 puts below p, so that runs and engines agree, and rows with equal
    keys come or go together; without keys by Spark's own sampling."""
    if not keys:
        return df.sample(p, seed)
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    return df.filter(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") < int(p * (1 << 32)))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of duplicates; raise_if_any turns them into an error."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def raise_if_any(df: DataFrame, message: str) -> None:
    """An error if df has a row."""
    if df.limit(1).count():
        raise ValueError(message)
