"""Curves over bins: pooling, weights, normalisation, fits, bootstrap, pair correlation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.spatial import pair_counts
from quillon.operators.stats import finite
from quillon.operators.ordering import numbered


def sliding_bins(spark: SparkSession, rmax: float, width: float, step: float) -> DataFrame:
    """(bin, start, end, center): overlapping bins by number."""
    n = int((rmax - width) / step + 1e-9) + 1
    return spark.range(n).select(F.col("id").cast("int").alias("bin"), (F.col("id") * step).alias("start"), (F.col("id") * step + width).alias("end"), (F.col("id") * step + width / 2).alias("center"))


def load_curves(curves: DataFrame, max_cv: float) -> DataFrame:
    """Cells whose baseline_cv (missing: 1.0) is at most the limit, with weight = n_interest + n_ref."""
    return curves.filter(F.coalesce("baseline_cv", F.lit(1.0)) <= max_cv).withColumn("weight", (F.col("n_interest") + F.col("n_ref")).cast("double"))


def aggregate_rdf(df: DataFrame, keys: Sequence[str] = ("bin",), value: str = "value") -> DataFrame:
    """Mean, sample std, sem, hubs, distinct nuclei, pixels by bin, finite values only. df: bin, hub, fov, nucleus, n_pixels, value."""
    v = df.withColumn("_v", finite(F.col(value))).filter("_v is not null")
    out = v.groupBy(*keys).agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.count("*").alias("n_hubs"), F.count_distinct("fov", "nucleus").alias("n_nuclei"), F.sum("n_pixels").alias("pixels"))
    return out.withColumn("sem", F.col("std") / F.sqrt("n_hubs"))


def pool_pcf(df: DataFrame, nucleus: Sequence[str], values: Sequence[str], keys: Sequence[str] = ("bin",)) -> DataFrame:
    """Mean over non-missing values and population std over the root of the number of all nuclei."""
    n = df.agg(F.count_distinct(*nucleus).alias("_n"))
    clean = df.select(*keys, *(finite(F.col(v)).alias(v) for v in values)).crossJoin(F.broadcast(n))
    return clean.groupBy(*keys).agg(*(e for v in values for e in (F.avg(v).alias(f"{v}_mean"), (F.stddev_pop(v) / F.sqrt(F.max("_n"))).alias(f"{v}_sem"))))


def weighted_stats(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean, std and sem = sqrt(variance / n); nulls stay out, none gives null."""
    v = df.filter(F.col(value).isNotNull() & F.col(weight).isNotNull()).withColumn("_m", F.sum(F.col(value) * F.col(weight)).over(w := Window.partitionBy(*keys)) / F.sum(weight).over(w))
    out = v.groupBy(*keys).agg(F.first("_m").alias("mean"), F.try_divide(F.sum(F.col(weight) * F.pow(F.col(value) - F.col("_m"), 2)), F.sum(weight)).alias("_var"), F.count("*").alias("n"))
    return out.withColumn("std", F.sqrt("_var")).withColumn("sem", F.sqrt(F.col("_var") / F.col("n"))).drop("_var")


def pcf_summary(df: DataFrame, keys: Sequence[str], r: str = "r", value: str = "value", at: Sequence[float] = (1.0, 5.0, 10.0)) -> DataFrame:
    """The largest value and the values of the bins nearest to some radii (ties: the smaller radius)."""
    return df.groupBy(*keys).agg(F.max(value).alias("max"), *(F.min_by(value, F.struct(F.abs(F.col(r) - x), r)).alias(f"at_{x:g}") for x in at))


def near_metric(df: DataFrame, keys: Sequence[str], value: str = "value", n: int = 3) -> DataFrame:
    """Mean over the first n bins."""
    w = Window.partitionBy(*keys).orderBy("bin")
    return df.withColumn("_r", F.dense_rank().over(w)).filter(F.col("_r") <= n).groupBy(*keys).agg(F.avg(value).alias("near"))


def tail_norm(df: DataFrame, keys: Sequence[str], value: str = "value", n: int = 5) -> DataFrame:
    """Normalised by the mean of the last n finite bins; a zero or missing baseline gives null."""
    v = df.withColumn("_v", finite(F.col(value).cast("double"))).withColumn("_none", F.col("_v").isNull())
    r = F.row_number().over(Window.partitionBy(*keys, "_none").orderBy(F.desc("bin")))
    v = v.withColumn("_r", r).withColumn("_b", F.avg(F.when(~F.col("_none") & (F.col("_r") <= n), F.col("_v"))).over(Window.partitionBy(*keys)))
    return v.withColumn("normalised", F.try_divide(F.col("_v"), F.nullif("_b", F.lit(0.0)))).drop("_v", "_none", "_r", "_b")


def far_norm(df: DataFrame, keys: Sequence[str], r: str = "r", value: str = "value", n: int = 10, beyond: float | None = None) -> DataFrame:
    """Baseline of the last n bins, or of all bins beyond a radius if these are at least n; cv = population std / mean."""
    w = Window.partitionBy(*keys)
    v = df.withColumn("_r", F.row_number().over(w.orderBy(F.desc(r))))
    far = F.lit(False) if beyond is None else F.col(r) > beyond
    v = v.withColumn("_many", F.count_if(far).over(w) >= n)
    used = F.when(F.when(F.col("_many"), far).otherwise(F.col("_r") <= n), F.col(value))
    v = v.withColumn("baseline", F.avg(used).over(w)).withColumn("baseline_cv", F.try_divide(F.stddev_pop(used).over(w), F.avg(used).over(w)))
    return v.withColumn("normalised", F.try_divide(F.col(value), F.nullif("baseline", F.lit(0.0)))).drop("_r", "_many")


def first_last(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Values at the smallest and the largest bin."""
    return df.groupBy(*keys).agg(F.min_by(value, "bin").alias("first"), F.max_by(value, "bin").alias("last"))


def fit_decay(curve: DataFrame, keys: Sequence[str], r: str = "r", value: str = "value", r0_max: float = 500.0, steps: int = 500) -> DataFrame:
    """K8: g = 1 + A exp(-r / r0) by a grid of r0 in (0, r0_max], A in closed form clipped to [-1, 5], first bin skipped: A, r0, R2,
    RMSE, MAE, max residual, sign changes and grade (good, fair, poor by R2 at 0.9 and 0.7)."""
    spark = curve.sparkSession
    c = curve.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(r))).filter("_i > 1").drop("_i").select(*keys, F.col(r).cast("double").alias("_r"), (F.col(value) - 1.0).alias("_y"))
    grid = spark.range(1, steps + 1).select((F.col("id") * (r0_max / steps)).alias("r0"))
    e = F.exp(-F.col("_r") / F.col("r0"))
    sums = c.crossJoin(F.broadcast(grid)).groupBy(*keys, "r0").agg(F.sum(e * e).alias("ee"), F.sum(e * F.col("_y")).alias("ey"), F.sum(F.col("_y") * F.col("_y")).alias("yy"))
    a = F.least(F.greatest(F.coalesce(F.try_divide("ey", "ee"), F.lit(0.0)), F.lit(-1.0)), F.lit(5.0))
    sums = sums.withColumn("A", a).withColumn("sse", F.col("yy") - 2 * F.col("A") * F.col("ey") + F.col("A") * F.col("A") * F.col("ee"))
    best = sums.groupBy(*keys).agg(F.min_by(F.struct("A", "r0"), F.struct("sse", "r0")).alias("_b")).select(*keys, "_b.A", "_b.r0")
    res = c.join(best, list(keys)) if keys else c.crossJoin(F.broadcast(best))
    res = res.withColumn("_e", F.col("_y") - F.col("A") * F.exp(-F.col("_r") / F.col("r0")))
    res = res.withColumn("_flip", (F.signum("_e") * F.signum(F.lag("_e").over(Window.partitionBy(*keys).orderBy("_r"))) < 0).cast("int"))
    out = res.groupBy(*keys, "A", "r0").agg((1 - F.try_divide(F.sum(F.col("_e") * F.col("_e")), F.var_pop("_y") * F.count("*"))).alias("r2"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg(F.abs("_e")).alias("mae"), F.max(F.abs("_e")).alias("max_residual"), F.coalesce(F.sum("_flip"), F.lit(0)).alias("sign_changes"))
    return out.withColumn("grade", F.when(F.col("r2") >= 0.9, "good").when(F.col("r2") >= 0.7, "fair").otherwise("poor"))


def bootstrap(curves: DataFrame, cell: str, rounds: int, n: int, seed: int = 0, r: str = "r", value: str = "value", weight: str = "weight") -> DataFrame:
    """K7: rounds of n cells drawn with replacement by a seeded hash; the weighted mean curve of each is fitted; 5, 50 and 95 % of A
    and r0; failed fits (null) are skipped. Cells are numbered once, draws meet them by an equi-join."""
    spark = curves.sparkSession
    cells = numbered(curves.select(cell).distinct(), [cell], "_i")
    count = cells.agg(F.count("*").alias("_n"))
    draws = spark.range(rounds * n).select((F.col("id") % rounds).alias("round"), F.xxhash64(F.lit(seed), "id").alias("_h")).crossJoin(F.broadcast(count))
    draws = draws.withColumn("_i", F.pmod("_h", F.col("_n"))).groupBy("round", "_i").agg(F.count("*").alias("_times"))
    drawn = draws.join(cells, "_i").join(curves, cell)
    w = F.col(weight) * F.col("_times")
    mean = drawn.groupBy("round", r).agg(F.try_divide(F.sum(w * F.col(value)), F.sum(w)).alias(value)).filter(F.col(value).isNotNull())
    fits = fit_decay(mean, ["round"], r, value).filter("r2 is not null")
    return fits.agg(F.count("*").alias("rounds"), *(F.get(F.percentile(c, [0.05, 0.5, 0.95]), F.lit(i)).alias(f"{c}_{p}") for c in ("A", "r0") for i, p in enumerate((5, 50, 95))))


def mask_term(masks: DataFrame, bins: Sequence[tuple[int, float, float]], keys: Sequence[str] = ("fov", "nucleus"), samples: int = 64) -> DataFrame:
    """(keys, bin, area, edge): angular mean of a mask's autocorrelation at the bins' centres, over its area. One mask goes to one
    task: it is an image of a nucleus, whose size does not grow with the data. masks: keys, y, x."""
    angles = np.linspace(0, 2 * np.pi, samples, endpoint=False)

    def term(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf.y.to_numpy(int) - int(pdf.y.min()), pdf.x.to_numpy(int) - int(pdf.x.min())
        h, w = y.max() + 1, x.max() + 1
        m = np.zeros((2 * h, 2 * w))
        m[y, x] = 1
        area = m.sum()
        corr = np.fft.irfft2(np.abs(np.fft.rfft2(m)) ** 2, m.shape) / area
        rows = []
        for b, start, end in bins:
            r = (start + end) / 2
            dy, dx = r * np.sin(angles), r * np.cos(angles)
            inside = (np.abs(dy) < h) & (np.abs(dx) < w)
            y0, x0 = np.floor(dy).astype(int), np.floor(dx).astype(int)
            fy, fx = dy - y0, dx - x0
            at = lambda i, j: corr[i % (2 * h), j % (2 * w)]
            v = at(y0, x0) * (1 - fy) * (1 - fx) + at(y0 + 1, x0) * fy * (1 - fx) + at(y0, x0 + 1) * (1 - fy) * fx + at(y0 + 1, x0 + 1) * fy * fx
            rows.append((*(pdf[k].iloc[0] for k in keys), b, float(area), float(np.where(inside, v, 0).mean())))
        return pd.DataFrame(rows, columns=[*keys, "bin", "area", "edge"])

    types = dict(masks.dtypes)
    return masks.groupBy(*keys).applyInPandas(term, ", ".join(f"{k} {types[k]}" for k in keys) + ", bin int, area double, edge double")


def pcf(p1: DataFrame, p2: DataFrame, masks: DataFrame, width: float, step: float, rmax: float, keys: Sequence[str] = ("fov", "nucleus"), least: int = 500) -> DataFrame:
    """K4: (keys, bin, start, end, g): g = N / (area rho1 rho2 ring edge); null if the norm is 0; nuclei with fewer points of either
    kind are skipped. p1: keys, i, x, y; p2: keys, j, x, y, in pixels of the mask."""
    n1 = p1.groupBy(*keys).agg(F.count("*").alias("n1")).filter(F.col("n1") >= least)
    n2 = p2.groupBy(*keys).agg(F.count("*").alias("n2")).filter(F.col("n2") >= least)
    n_bins = int((rmax - width) / step + 1e-9) + 1
    bins = [(i, i * step, i * step + width) for i in range(n_bins)]
    used = n1.join(n2, list(keys))
    terms = mask_term(masks, bins, keys).join(used, list(keys))
    pairs = pair_counts(p1.join(used, list(keys), "left_semi"), p2.join(used, list(keys), "left_semi"), width, step, rmax, keys).select(*keys, "bin", "n")
    out = terms.join(pairs, [*keys, "bin"], "left").withColumn("start", F.col("bin") * step).withColumn("end", F.col("bin") * step + width)
    ring = F.pi() * (F.col("end") * F.col("end") - F.col("start") * F.col("start"))
    norm = F.col("n1") * F.col("n2") / F.col("area") * ring * F.col("edge")
    return out.select(*keys, "bin", "start", "end", F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), F.nullif(norm, F.lit(0.0))).alias("g"))


def mask_runs(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, y, runs): the runs of neighbouring pixels of each row of a mask, as (first, last)."""
    pixels = mask.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()
    run = F.col("x") - F.row_number().over(Window.partitionBy(*keys, "y").orderBy("x"))
    runs = pixels.withColumn("_run", run).groupBy(*keys, "y", "_run").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return runs.groupBy(*keys, "y").agg(F.collect_list(F.struct("a", "b")).alias("runs"))


def ring_area_weights(points: DataFrame, mask: DataFrame, width: int, n_bins: int, keys: Sequence[str] = ("fov", "nucleus")) -> DataFrame:
    """K5: (keys, point, bin, weight): whole ring area over the ring's pixels inside the mask, for each reference point; null if none.
    Rings are (start, end] in pixels around the point's pixel. A disc is a span of each row, whose pixels come from the row's runs; a
    point meets 2 rmax + 1 rows, not the pixels of its rings."""
    rmax = width * n_bins
    discs = F.array(*(F.lit(float(width * k)) for k in range(n_bins + 1)))
    at = points.select(*keys, "point", F.rint("y").cast("int").alias("_y"), F.rint("x").cast("int").alias("_x"))
    at = at.withColumn("_dy", F.explode(F.sequence(F.lit(-rmax), F.lit(rmax)))).withColumn("y", F.col("_y") + F.col("_dy"))
    rows = at.join(mask_runs(mask, keys), [*keys, "y"])

    def pixels(radius: Column) -> Column:
        half = F.floor(F.sqrt(radius * radius - F.col("_dy") * F.col("_dy")))
        shared = lambda r: F.greatest(F.least(r["b"], F.col("_x") + half) - F.greatest(r["a"], F.col("_x") - half) + 1, F.lit(0))
        inside = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + shared(r))
        return F.when(F.abs("_dy") <= radius, inside).otherwise(F.lit(0).cast("long"))

    held = rows.select(*keys, "point", F.transform(discs, pixels).alias("_n"))
    ring = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda k: F.struct(k.alias("bin"), (F.get("_n", k + 1) - F.get("_n", k)).alias("n")))
    n = held.select(*keys, "point", F.inline(ring)).groupBy(*keys, "point", "bin").agg(F.sum("n").alias("n"))
    grid = points.select(*keys, "point", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    area = F.pi() * (F.pow((F.col("bin") + 1) * width, 2) - F.pow(F.col("bin") * width, 2))
    return grid.join(n, [*keys, "point", "bin"], "left").select(*keys, "point", "bin", F.try_divide(area, F.col("n")).alias("weight"))


def pcf_polygon(p1: DataFrame, p2: DataFrame, mask: DataFrame, width: int, n_bins: int, keys: Sequence[str] = ("fov", "nucleus")) -> DataFrame:
    """K5: (keys, bin, g): neighbours of each reference point weighted by its ring's area over the part inside the mask, over
    what even density gives. p1: keys, point, x, y; p2: keys, j, x, y."""
    from quillon.operators.spatial import distance_join

    a = p1.select(*keys, "point", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p2.select(*keys, "j", F.col("x").alias("bx"), F.col("y").alias("by"))
    n = distance_join(a, b, float(width * n_bins), keys, strict=False).filter("dist > 0").groupBy(*keys, "point", (F.ceil(F.col("dist") / width) - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    w = ring_area_weights(p1, mask, width, n_bins, keys).join(n, [*keys, "point", "bin"], "left")
    size = mask.groupBy(*keys).agg(F.count("*").alias("area")).join(p2.groupBy(*keys).agg(F.count("*").alias("n2")), list(keys))
    per = w.groupBy(*keys, "bin").agg(F.sum(F.coalesce(F.col("n") * F.col("weight"), F.lit(0.0))).alias("s"), F.count("*").alias("n1")).join(size, list(keys))
    area = F.pi() * (F.pow((F.col("bin") + 1) * width, 2) - F.pow(F.col("bin") * width, 2))
    return per.select(*keys, "bin", F.try_divide(F.col("s"), F.col("n1") * area * F.col("n2") / F.col("area")).alias("g"))


def rdf_lsq(pixels: DataFrame, hubs: DataFrame, rmax: int, keys: Sequence[str] = ("fov", "nucleus"), least: int | None = None, ridge: float = 1e-9) -> DataFrame:
    """K6: (keys, radius, n_pixels, profile): each standardised pixel is the sum over hubs of profile[round half even(d)]. The design
    counts come from a distance join, the normal equations from one groupBy; only they, (rmax + 1)^2 sums, go to a small solve."""
    from quillon.operators.spatial import distance_join

    w = Window.partitionBy(*keys)
    v = pixels.withColumn("_z", (F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_pop("value").over(w), F.lit(0.0)))
    a = v.select(*keys, "_z", F.col("y").alias("ay"), F.col("x").alias("ax"))
    b = hubs.select(*keys, F.col("y").alias("by"), F.col("x").alias("bx"))
    d = distance_join(a, b, rmax + 0.5, keys, strict=False).withColumn("r", F.rint("dist").cast("int")).filter(F.col("r") <= rmax)
    design = d.groupBy(*keys, "ay", "ax", "r").agg(F.count("*").alias("n"), F.first("_z").alias("_z"))
    other = design.select(*keys, "ay", "ax", F.col("r").alias("r2"), F.col("n").alias("n2"))
    normal = design.join(other, [*keys, "ay", "ax"]).groupBy(*keys, "r", "r2").agg(F.sum(F.col("n") * F.col("n2")).cast("double").alias("g"))
    right = design.groupBy(*keys, "r").agg(F.sum(F.col("n") * F.col("_z")).alias("b"), F.count("*").alias("n_pixels"))
    rows = normal.join(right, [*keys, "r"])
    few = least if least is not None else rmax + 1
    n_pix = design.select(*keys, "ay", "ax").distinct().groupBy(*keys).agg(F.count("*").alias("_pix"))
    rows = rows.join(n_pix, list(keys))
    types = dict(pixels.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rs = np.sort(pdf.r.unique())
        at = {r: i for i, r in enumerate(rs)}
        g, rhs, n = np.zeros((len(rs), len(rs))), np.zeros(len(rs)), np.zeros(len(rs), int)
        for r, r2, gv, bv, nv in zip(pdf.r, pdf.r2, pdf.g, pdf.b, pdf.n_pixels, strict=True):
            g[at[r], at[r2]], rhs[at[r]], n[at[r]] = gv, bv, nv
        ok = pdf._pix.iloc[0] >= few and np.isfinite(rhs).all()
        sol = np.linalg.lstsq(g + ridge * np.eye(len(rs)), rhs, rcond=None)[0] if ok else np.full(len(rs), np.nan)
        out = pd.DataFrame({k: pdf[k].iloc[0] for k in keys} | {"radius": rs, "n_pixels": n, "profile": sol}, index=range(len(rs)))
        return out.astype({"profile": object}).where(out.profile.notna(), None) if not ok else out

    return rows.groupBy(*keys).applyInPandas(solve, ", ".join(f"{k} {types[k]}" for k in keys) + ", radius int, n_pixels long, profile double")
