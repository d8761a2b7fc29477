"""Pixel tables (fov, frame, channel, y, x, label, value): projections, regions, colocation, thresholds, traces."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ordering import quantiles, with_quantiles


def mip(pixels: DataFrame, keys: Sequence[str] = ("fov", "channel")) -> DataFrame:
    """Maximum over frames."""
    return pixels.groupBy(*keys, "y", "x").agg(F.max("value").alias("value"))


def block_mean(pixels: DataFrame, n: int, keys: Sequence[str] = ("fov",)) -> DataFrame:
    """Mean image of n consecutive frames."""
    return pixels.groupBy(*keys, F.floor(F.col("frame") / n).alias("block"), "y", "x").agg(F.avg("value").alias("value"))


def stack_stats(pixels: DataFrame, keys: Sequence[str] = ("fov",)) -> DataFrame:
    """Count, negative, zero and finite values, least and largest."""
    v = F.col("value")
    ok = ~F.isnan(v) & (F.abs(v) != float("inf"))
    return pixels.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(v < 0).alias("n_negative"), F.count_if(v == 0).alias("n_zero"), F.count_if(ok).alias("n_finite"), F.min("value").alias("min"), F.max("value").alias("max"))


def region_props(mask: DataFrame, keys: Sequence[str] = ("fov",)) -> DataFrame:
    """Area, centroid and box (upper ends exclusive) by label above 0."""
    return mask.filter("label > 0").groupBy(*keys, "label").agg(F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"))


def region_metrics(pixels: DataFrame, keys: Sequence[str] = ("fov", "label"), decimals: int = 0) -> DataFrame:
    """Max, mean, std, mode of rounded values (ties: smallest), P99 / mode, radius of the disc of that area."""
    out = pixels.groupBy(*keys).agg(F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.mode(F.round("value", decimals), True).alias("mode"), F.percentile("value", 0.99).alias("p99"), F.sqrt(F.count("*") / F.pi()).alias("radius"))
    return out.withColumn("p99_mode", F.try_divide("p99", "mode"))


def compartments(pixels: DataFrame, keys: Sequence[str] = ("fov", "cell")) -> DataFrame:
    """Mean and max by channel of the cell, its nucleus and its cytoplasm (cell without nucleus), 0 if empty; long form.
    pixels: fov, cell, channel, nucleus (bool), value."""
    own = pixels.filter("cell > 0")
    parts = {"cell": F.lit(True), "nucleus": F.col("nucleus"), "cytoplasm": ~F.col("nucleus")}
    return own.groupBy(*keys, "channel").agg(*(F.coalesce(f(F.when(c, F.col("value"))), F.lit(0.0)).alias(f"{p}_{n}") for p, c in parts.items() for n, f in (("mean", F.avg), ("max", F.max))))


def nucleus_stats(pixels: DataFrame, channels: Sequence, keys: Sequence[str] = ("fov", "cell")) -> DataFrame:
    """One row a nucleus: mean and max by channel for nucleus and cytoplasm in fixed order, and areas."""
    wide = compartments(pixels, keys).groupBy(*keys).pivot("channel", list(channels)).agg(*(F.first(f"{p}_{n}").alias(f"{p}_{n}") for p in ("nucleus", "cytoplasm") for n in ("mean", "max")))
    one = pixels.filter((F.col("cell") > 0) & (F.col("channel") == channels[0]))
    areas = one.groupBy(*keys).agg(F.count_if("nucleus").alias("nucleus_area"), F.count_if(~F.col("nucleus")).alias("cytoplasm_area"))
    return areas.join(wide, list(keys))


def pcc(pixels: DataFrame, a: str, b: str, keys: Sequence[str] = ("fov", "label")) -> DataFrame:
    """Pearson r by region, null below two pixels or without variance."""
    return pixels.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, F.corr(a, b)).alias("r"))


def manders(pixels: DataFrame, a: str, b: str, ta: float, tb: float, keys: Sequence[str] = ("fov", "label")) -> DataFrame:
    """Share of a where b is above its threshold, and the mirror; null where the total is 0."""
    m = lambda x, y, t: F.try_divide(F.sum(F.when(F.col(y) > t, F.col(x)).otherwise(0.0)), F.sum(x))
    return pixels.groupBy(*keys).agg(m(a, b, tb).alias("m1"), m(b, a, ta).alias("m2"))


def otsu(df: DataFrame, keys: Sequence[str], value: str, bins: int = 256) -> DataFrame:
    """(keys, threshold): the centre of the histogram bin that splits with the largest between-class variance (ties: the
    lowest); constant data give their value. The windows hold at most `bins` rows a group."""
    span = df.groupBy(*keys).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif((F.col("_hi") - F.col("_lo")) / bins, F.lit(0.0))), F.lit(bins - 1))
    joined = df.join(span, list(keys)) if keys else df.crossJoin(F.broadcast(span))
    h = joined.groupBy(*keys, "_lo", "_hi", F.coalesce(b, F.lit(0)).alias("_b")).agg(F.count("*").cast("double").alias("_n"))
    h = h.withColumn("_c", F.col("_lo") + (F.col("_b") + 0.5) * (F.col("_hi") - F.col("_lo")) / bins)
    every = Window.partitionBy(*keys)
    up = every.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_w0", F.sum("_n").over(up)).withColumn("_s0", F.sum(F.col("_n") * F.col("_c")).over(up)).withColumn("_w", F.sum("_n").over(every)).withColumn("_s", F.sum(F.col("_n") * F.col("_c")).over(every))
    w1 = F.col("_w") - F.col("_w0")
    between = F.col("_w0") * w1 * F.pow(F.col("_s0") / F.col("_w0") - (F.col("_s") - F.col("_s0")) / F.nullif(w1, F.lit(0.0)), 2)
    h = h.withColumn("_v", F.coalesce(between, F.lit(-1.0)))
    return h.groupBy(*keys).agg(F.max_by("_c", F.struct("_v", -F.col("_b"))).alias("threshold"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi")).withColumn("threshold", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("threshold"))).drop("_lo", "_hi")


def cloud_class(pixels: DataFrame, value: str, threshold: float, least: int, keys: Sequence[str] = ("fov", "label")) -> DataFrame:
    """with_cloud if more than `least` pixels are above the threshold; the background mean only then."""
    n = F.count_if(F.col(value) > threshold)
    out = pixels.groupBy(*keys).agg(n.alias("bright"), F.avg(F.when(F.col(value) <= threshold, F.col(value))).alias("_bg"))
    return out.withColumn("class", F.when(F.col("bright") > least, "with_cloud").otherwise("no_cloud")).withColumn("background_mean", F.when(F.col("bright") > least, F.col("_bg"))).drop("_bg")


def adaptive_threshold(pixels: DataFrame, value: str, k: float, keys: Sequence[str] = ("fov", "label"), n: int = 20, by_mode: bool = False) -> DataFrame:
    """Mean, std, mode, base (mean of the n smallest values, or the mode) and threshold = base + k std."""
    small = pixels.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).filter(F.col("_r") <= n).groupBy(*keys).agg(F.avg(value).alias("_small"))
    main = pixels.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.mode(F.round(value), True).alias("mode")).join(small, list(keys))
    main = main.withColumn("base", F.col("mode") if by_mode else F.col("_small")).drop("_small")
    return main.withColumn("threshold", F.col("base") + k * F.col("std"))


def puncta_stats(puncta: DataFrame, pixel_um: float, keys: Sequence[str] = ("condition", "cell")) -> DataFrame:
    """Puncta with area_um2, diameter_um and circularity."""
    a = F.col("area") * pixel_um**2
    return puncta.withColumn("area_um2", a).withColumn("diameter_um", 2 * F.sqrt(a / F.pi())).withColumn("circularity", F.try_divide(4 * F.pi() * F.col("area"), F.col("perimeter") * F.col("perimeter")))


def puncta_per_cell(puncta: DataFrame, condition: str = "condition", cell: str = "cell") -> DataFrame:
    """Mean and sem over cells of the number of puncta, by condition."""
    per = puncta.groupBy(condition, cell).agg(F.count("*").alias("n"))
    return per.groupBy(condition).agg(F.count("*").alias("n_cells"), F.avg("n").alias("mean"), (F.stddev_samp("n") / F.sqrt(F.count("*"))).alias("sem"))


def _partitions(items: tuple[int, ...]) -> list[list[tuple[int, ...]]]:
    """Partitions of the items into blocks of two or more."""
    if not items:
        return [[]]
    first, rest, out = items[0], items[1:], []
    for size in range(1, len(rest) + 1):
        for others in combinations(rest, size):
            left = tuple(i for i in rest if i not in others)
            out += [[(first, *others), *p] for p in _partitions(left)]
    return out


def cumulant(pixels: DataFrame, order: int, keys: Sequence[str] = ("fov",)) -> DataFrame:
    """(keys, y, x, value): autocumulant of 2..6 at frame lags 0..order - 1 of the fluctuations: moments of products over
    partitions without single blocks, each block of size b with the factor (-1)^(k-1) (k-1)! of k blocks."""
    from math import factorial

    pixel = Window.partitionBy(*keys, "y", "x")
    d = pixels.withColumn("_d", F.col("value") - F.avg("value").over(pixel))
    for i in range(order):
        d = d.withColumn(f"_d{i}", F.lead("_d", i).over(pixel.orderBy("frame")) if i else F.col("_d"))
    d = d.filter(F.col(f"_d{order - 1}").isNotNull())
    blocks = sorted({b for p in _partitions(tuple(range(order))) for b in p})

    def product(b: tuple[int, ...]) -> Column:
        out = F.col(f"_d{b[0]}")
        for i in b[1:]:
            out = out * F.col(f"_d{i}")
        return out

    names = {b: "_m" + "_".join(map(str, b)) for b in blocks}
    m = d.groupBy(*keys, "y", "x").agg(*(F.avg(product(b)).alias(names[b]) for b in blocks))
    total = F.lit(0.0)
    for p in _partitions(tuple(range(order))):
        term = F.lit(float((-1) ** (len(p) - 1) * factorial(len(p) - 1)))
        for b in p:
            term = term * F.col(names[b])
        total = total + term
    return m.select(*keys, "y", "x", total.alias("value"))


def disc_offsets(radius: int, inner: float = 0.0) -> Column:
    """Array of (dy, dx) with inner <= d <= radius."""
    pairs = [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if inner**2 <= y * y + x * x <= radius**2]
    return F.array(*(F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in pairs))


def spot_stats(spots: DataFrame, pixels: DataFrame, radius: int, keys: Sequence[str] = ("fov",)) -> DataFrame:
    """Mean, median, min, max, sum, population std of the pixels within a radius; contrast and SNR against a ring from there
    to twice the radius. spots: fov, spot, y, x (whole pixels)."""
    both = spots.select(*keys, "spot", F.col("y").alias("_y"), F.col("x").alias("_x"), F.explode(disc_offsets(2 * radius)).alias("o"))
    both = both.select(*keys, "spot", (F.col("_y") + F.col("o.dy")).alias("y"), (F.col("_x") + F.col("o.dx")).alias("x"), (F.col("o.dy") * F.col("o.dy") + F.col("o.dx") * F.col("o.dx") <= radius**2).alias("_in"))
    j = both.join(pixels.select(*keys, "y", "x", "value"), [*keys, "y", "x"])
    v, ring = F.when(F.col("_in"), F.col("value")), F.when(~F.col("_in"), F.col("value"))
    out = j.groupBy(*keys, "spot").agg(F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("total"), F.stddev_pop(v).alias("std"), F.avg(ring).alias("_bg"), F.stddev_pop(ring).alias("_sd"))
    out = out.withColumn("contrast", F.try_divide(F.col("mean") - F.col("_bg"), F.abs(F.col("mean") + F.col("_bg")))).withColumn("snr", F.try_divide(F.col("mean") - F.col("_bg"), F.col("_sd")))
    return out.drop("_bg", "_sd")


def local_max(spots: DataFrame, pixels: DataFrame, radii: Sequence[int] = (1, 2, 3), keys: Sequence[str] = ("fov",)) -> DataFrame:
    """The largest value in the square of +-r for each r."""
    r = max(radii)
    offsets = F.array(*(F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y in range(-r, r + 1) for x in range(-r, r + 1)))
    both = spots.select(*keys, "spot", F.col("y").alias("_y"), F.col("x").alias("_x"), F.explode(offsets).alias("o"))
    both = both.select(*keys, "spot", (F.col("_y") + F.col("o.dy")).alias("y"), (F.col("_x") + F.col("o.dx")).alias("x"), F.greatest(F.abs("o.dy"), F.abs("o.dx")).alias("_r"))
    j = both.join(pixels.select(*keys, "y", "x", "value"), [*keys, "y", "x"])
    return j.groupBy(*keys, "spot").agg(*(F.max(F.when(F.col("_r") <= k, F.col("value"))).alias(f"max_r{k}") for k in radii))


def roi_pixels(seeds: DataFrame, foreground: DataFrame, r: int, r1: float, r2: int, keys: Sequence[str] = ("fov",)) -> DataFrame:
    """(fov, roi, y, x, is_signal): discs of d <= r, rings of r1 <= d <= r2 without foreground pixels; rois without both go."""
    disc = seeds.select(*keys, "roi", F.col("y").alias("_y"), F.col("x").alias("_x"), F.explode(disc_offsets(r)).alias("o"), F.lit(True).alias("is_signal"))
    ring = seeds.select(*keys, "roi", F.col("y").alias("_y"), F.col("x").alias("_x"), F.explode(disc_offsets(r2, r1)).alias("o"), F.lit(False).alias("is_signal"))
    place = lambda d: d.select(*keys, "roi", (F.col("_y") + F.col("o.dy")).alias("y"), (F.col("_x") + F.col("o.dx")).alias("x"), "is_signal")
    both = place(disc).unionByName(place(ring).join(foreground.select(*keys, "y", "x").distinct(), [*keys, "y", "x"], "left_anti"))
    whole = both.groupBy(*keys, "roi").agg(F.count_distinct("is_signal").alias("_n")).filter("_n = 2").select(*keys, "roi")
    return both.join(whole, [*keys, "roi"], "left_semi")


def traces(pixels: DataFrame, rois: DataFrame, keys: Sequence[str] = ("fov",)) -> DataFrame:
    """(fov, roi, frame, peak_mean, background_mean, mean_difference, integrated_difference)."""
    j = rois.join(pixels.select(*keys, "frame", "y", "x", "value"), [*keys, "y", "x"])
    v, b = F.when(F.col("is_signal"), F.col("value")), F.when(~F.col("is_signal"), F.col("value"))
    out = j.groupBy(*keys, "roi", "frame").agg(F.avg(v).alias("peak_mean"), F.avg(b).alias("background_mean"), F.sum(v).alias("_s"), F.count(v).alias("_n"))
    return out.withColumn("mean_difference", F.col("peak_mean") - F.col("background_mean")).withColumn("integrated_difference", F.col("_s") - F.col("_n") * F.col("background_mean")).drop("_s", "_n")


def trace_metrics(df: DataFrame, keys: Sequence[str] = ("roi",), value: str = "value", background: str | None = None, first: int = 5) -> DataFrame:
    """Mean of the first frames, mean and slope of the late half, slope of the background, median absolute difference noise."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_i", F.row_number().over(w.orderBy("frame"))).withColumn("_n", F.count("*").over(w)).withColumn("_d", F.abs(F.lead(value).over(w.orderBy("frame")) - F.col(value)))
    late = F.col("_i") > F.col("_n") / 2
    out = [F.avg(F.when(F.col("_i") <= first, F.col(value))).alias("initial_mean"), F.avg(F.when(late, F.col(value))).alias("late_mean"), F.regr_slope(F.when(late, F.col(value)), F.col("frame")).alias("late_slope"), (1.4826 * F.percentile("_d", 0.5) / F.sqrt(F.lit(2.0))).alias("noise")]
    out += [F.regr_slope(F.col(background), F.col("frame")).alias("background_slope")] if background else []
    return d.groupBy(*keys).agg(*out)


def step_scale(df: DataFrame, keys: Sequence[str] = ("roi",), value: str = "value") -> DataFrame:
    """(keys, noise, step, threshold): three-point median, late half, downward jumps above centre + 4 noise, the median of the
    lower half of them; without jumps max(8 noise, 1); the threshold is half of it."""
    w = Window.partitionBy(*keys).orderBy("frame")
    n = F.count("*").over(Window.partitionBy(*keys))
    m = med3(df, keys, value).withColumn("_i", F.row_number().over(w)).withColumn("_n", n).filter("_i > _n / 2")
    d = m.withColumn("_d", F.col("med3") - F.lead("med3").over(w)).filter("_d is not null")
    c = d.groupBy(*keys).agg(F.percentile("_d", 0.5).alias("_c"))
    d = d.join(c, list(keys))
    noise = d.groupBy(*keys).agg((1.4826 * F.percentile(F.abs(F.col("_d") - F.col("_c")), 0.5)).alias("noise"))
    jumps = d.join(noise, list(keys)).filter(F.col("_d") > F.col("_c") + 4 * F.col("noise"))
    half = jumps.groupBy(*keys).agg(F.percentile("_d", 0.5).alias("_mid"))
    step = jumps.join(half, list(keys)).filter("_d <= _mid").groupBy(*keys).agg(F.percentile("_d", 0.5).alias("_step"))
    out = noise.join(step, list(keys), "left").withColumn("step", F.coalesce("_step", F.greatest(8 * F.col("noise"), F.lit(1.0)))).drop("_step")
    return out.withColumn("threshold", F.col("step") / 2)


def med3(df: DataFrame, keys: Sequence[str], value: str = "value", at: str = "frame") -> DataFrame:
    """med3, the median of three neighbours; ends repeat the nearest value."""
    w = Window.partitionBy(*keys).orderBy(at)
    v = F.col(value)
    return df.withColumn("med3", F.get(F.array_sort(F.array(F.coalesce(F.lag(value).over(w), v), v, F.coalesce(F.lead(value).over(w), v))), F.lit(1)))


def diff(df: DataFrame, keys: Sequence[str], value: str = "value", at: str = "frame") -> DataFrame:
    """Diff, the next value less this one; the last row of a series goes."""
    w = Window.partitionBy(*keys).orderBy(at)
    return df.withColumn("diff", F.lead(value).over(w) - F.col(value)).filter("diff is not null")


def interpolate(df: DataFrame, keys: Sequence[str], value: str = "value", at: str = "frame") -> DataFrame:
    """Filled, with nulls on the line between the valid neighbours, flat beyond the ends."""
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(at).rowsBetween(0, Window.unboundedFollowing)
    pair = F.when(F.col(value).isNotNull(), F.struct(F.col(at).cast("double").alias("t"), F.col(value).cast("double").alias("v")))
    d = df.withColumn("_p", pair).withColumn("_a", F.last("_p", ignorenulls=True).over(before)).withColumn("_b", F.first("_p", ignorenulls=True).over(after))
    t = (F.col(at) - F.col("_a.t")) / F.nullif(F.col("_b.t") - F.col("_a.t"), F.lit(0.0))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * t
    return d.withColumn("filled", F.coalesce(F.col(value).cast("double"), line, F.col("_a.v"), F.col("_b.v"))).drop("_p", "_a", "_b")


def roi_class(seeds: DataFrame, keys: Sequence[str] = ("fov", "roi"), most: float = 5.0) -> DataFrame:
    """Point if one seed and a diameter of at most 5, else extended. seeds: fov, roi, diameter."""
    return seeds.groupBy(*keys).agg(F.count("*").alias("n_seeds"), F.max("diameter").alias("diameter")).withColumn("roi_class", F.when((F.col("n_seeds") == 1) & (F.col("diameter") <= most), "point").otherwise("extended"))


def profiles(manifest: DataFrame, key: str = "profile") -> DataFrame:
    """Files, frames, size and the first exposure by acquisition profile."""
    return manifest.groupBy(key).agg(F.count("*").alias("files"), F.sum("frames").alias("frames"), F.sum("size").alias("size"), F.min_by("exposure", "path").alias("exposure"))


def preflight(manifest: DataFrame, keys: Sequence[str], expected: DataFrame | None = None) -> DataFrame:
    """Accepted files and frames, skipped files by data set; other numbers than expected are an error."""
    ok = F.col("accepted")
    out = manifest.groupBy(*keys).agg(F.count_if(ok).alias("files"), F.sum(F.when(ok, F.col("frames")).otherwise(0)).alias("frames"), F.count_if(~ok).alias("skipped"))
    if expected is None:
        return out
    named = expected.select(*keys, F.col("files").alias("_f"), F.col("frames").alias("_n"))
    bad = (F.col("files") != F.col("_f")) | (F.col("frames") != F.col("_n"))
    return out.join(named, list(keys), "left").withColumn("files", F.when(bad, F.raise_error(F.lit("manifest differs from what is expected")).cast("bigint")).otherwise(F.col("files"))).drop("_f", "_n")


def count_summary(rois: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Total, accepted, fraction, within range, median, mean and outside counts. rois: keys, flag, count."""
    ok = F.col("flag") == 1
    c = F.when(ok, F.col("count"))
    inside = F.when(c <= most, c)
    out = rois.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(ok).alias("accepted"), F.count(inside).alias("within"), F.percentile(inside, 0.5).alias("median"), F.avg(inside).alias("mean"), F.count_if(c > most).alias("outside"))
    return out.withColumn("fraction", F.col("accepted") / F.col("total"))


def sweep(results: DataFrame, key: str = "multiplier") -> DataFrame:
    """Accepted fraction and median count by threshold multiplier."""
    ok = F.col("flag") == 1
    return results.groupBy(key).agg((F.count_if(ok) / F.count("*")).alias("accepted_fraction"), F.percentile(F.when(ok, F.col("count")), 0.5).alias("median_count"))


def infer_spacing(files: DataFrame, keys: Sequence[str], at: str, place: str) -> DataFrame:
    """Median step of a place between consecutive slices or times."""
    w = Window.partitionBy(*keys).orderBy(at)
    return files.withColumn("_s", F.col(place) - F.lag(place).over(w)).groupBy(*keys).agg(F.percentile("_s", 0.5).alias("spacing"))


def stack_groups(files: DataFrame, pattern: str = r"^(.*)_X(\d+)_Y(\d+)_Z(\d+)") -> DataFrame:
    """(prefix, x, y, n, slices): names grouped by prefix and place, slices in the order of Z."""
    part = lambda i: F.regexp_extract("name", pattern, i)
    named = files.filter(F.col("name").rlike(pattern)).select(part(1).alias("prefix"), part(2).cast("int").alias("x"), part(3).cast("int").alias("y"), F.struct(part(4).cast("int").alias("z"), "name").alias("s"))
    return named.groupBy("prefix", "x", "y").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list("s")), lambda s: s["name"]).alias("slices"))


def keep_hub(hubs: DataFrame, value: str, median: str, std: str, k: float, hard: float | None = None) -> DataFrame:
    """Keep: value >= max(median + k std, hard); a null value or threshold gives false."""
    t = F.col(median) + k * F.col(std)
    t = t if hard is None else F.greatest(t, F.lit(float(hard)))
    return hubs.withColumn("keep", F.coalesce(F.col(value) >= t, F.lit(False)))


def scale_check(hubs: DataFrame, a: str, b: str, low: float = 0.01, high: float = 100.0, least: int = 20) -> DataFrame:
    """One row (n, ratio, ok): the median ratio of positive pairs must lie within the limits if there are at least 20."""
    r = F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(a) / F.col(b))
    out = quantiles(hubs, r, [0.5]).select("n", F.col("q0").alias("ratio"))
    return out.withColumn("ok", (F.col("n") < least) | F.col("ratio").between(low, high))


def pct_norm(df: DataFrame, keys: Sequence[str], value: str, lo: float = 1, hi: float = 99) -> DataFrame:
    """clip((v - Plo) / (Phi - Plo), 0, 1); flat groups give 0."""
    cuts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    cuts = with_quantiles(cuts, df, keys, F.col(value), {"_lo": lo / 100, "_hi": hi / 100}).drop("_n")
    out = df.join(cuts, list(keys)) if keys else df.crossJoin(F.broadcast(cuts))
    a, b = F.col("_lo"), F.col("_hi")
    scaled = F.least(F.greatest(F.try_divide(F.col(value) - a, b - a), F.lit(0.0)), F.lit(1.0))
    return out.withColumn("scaled", F.when(b > a, scaled).otherwise(0.0)).drop("_lo", "_hi")


def minmax(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(v - min) / (max - min) by series, null for a flat one."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("scaled", F.try_divide(F.col(value) - lo, hi - lo))
