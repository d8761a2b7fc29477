"""Tracks of points over frames: edges, displacements, angles, fits, votes, linking."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import safe_log10
from quillon.operators.ordering import numbered

TRACK = ("track",)
HISTORY = "array<struct<frame:bigint,x:double,y:double>>"


def edges(tracks: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """(keys, source, target, source_frame, target_frame, frame_difference, distance, edge_type). tracks: keys, spot, frame, x, y."""
    w = Window.partitionBy(*keys).orderBy("frame", "spot")
    ahead = tracks.withColumns({f"_{c}": F.lead(c).over(w) for c in ("spot", "frame", "x", "y")}).filter("_spot is not null")
    dx, dy = F.col("_x") - F.col("x"), F.col("_y") - F.col("y")
    lag = F.col("_frame") - F.col("frame")
    return ahead.select(*keys, F.col("spot").alias("source"), F.col("_spot").alias("target"), F.col("frame").alias("source_frame"), F.col("_frame").alias("target_frame"), lag.alias("frame_difference"), F.sqrt(dx * dx + dy * dy).alias("distance"), F.when(lag == 1, "adjacent").otherwise("gap_closing").alias("edge_type"))


def track_summary(tracks: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """(keys, n, first_frame, last_frame, max_step, gap_edges)."""
    e = edges(tracks, keys).groupBy(*keys).agg(F.max("distance").alias("max_step"), F.count_if(F.col("edge_type") == "gap_closing").alias("gap_edges"))
    n = tracks.groupBy(*keys).agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    return n.join(e, list(keys), "left").withColumn("gap_edges", F.coalesce("gap_edges", F.lit(0)))


def drop_dead_pixels(tracks: DataFrame, keys: Sequence[str] = TRACK, most: int = 2) -> DataFrame:
    """Without tracks in which an x or a y value comes more than twice."""
    bad = None
    for c in ("x", "y"):
        own = tracks.groupBy(*keys, c).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*keys)
        bad = own if bad is None else bad.unionByName(own)
    return tracks.join(bad.distinct(), list(keys), "left_anti")


#: Frames of a block: pairs of points of a track meet by pairs of blocks, so that a long track isn't one task's.
FRAMES = 256
#: Pairs of corners of a hull that are compared at once.
HULL_PAIRS = 1 << 20


def pairs(tracks: DataFrame, keys: Sequence[str] = TRACK, max_lag: int | None = None) -> DataFrame:
    """(keys, lag, d2): squared distances of all pairs of a track's points that are 1..rows - 1 frames apart, max_lag at most."""
    at = F.floor(F.col("frame") / FRAMES)
    size = tracks.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    most = F.col("_n") - 1 if max_lag is None else F.least(F.col("_n") - 1, F.lit(max_lag))
    a = tracks.select(*keys, F.col("frame").alias("_f"), F.col("x").alias("_x"), F.col("y").alias("_y")).join(size, list(keys)).withColumn("_most", most)
    own = F.floor(F.col("_f") / FRAMES)
    a = a.filter("_most >= 1").withColumn("_p", own).withColumn("_q", F.explode(F.sequence(own, F.least(F.col("_hi"), F.floor((F.col("_f") + F.col("_most")) / FRAMES)))))
    b = tracks.select(*keys, "frame", "x", "y").join(size.select(*keys, "_lo"), list(keys)).withColumn("_q", at).withColumn("_p", F.explode(F.sequence("_lo", at)))
    both = a.join(b.drop("_lo"), [*keys, "_p", "_q"]).withColumn("lag", F.col("frame") - F.col("_f")).filter((F.col("lag") >= 1) & (F.col("lag") <= F.col("_most")))
    d2 = (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y"))
    return both.select(*keys, "lag", d2.alias("d2"))


def msd(tracks: DataFrame, keys: Sequence[str] = TRACK, max_lag: int | None = None) -> DataFrame:
    """(keys, lag, msd, n_pairs): mean squared displacement over pairs exactly lag frames apart, lag up to rows - 1 and at most max_lag."""
    return pairs(tracks, keys, max_lag).groupBy(*keys, "lag").agg(F.avg("d2").alias("msd"), F.count("*").alias("n_pairs"))


def fit_lags(curve: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """The first min(max(3, round half even(n / 2)), n) lags of each curve."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    keep = F.least(F.greatest(F.lit(3), F.bround(n / 2.0)), n)
    return curve.withColumn("_keep", keep).withColumn("_r", F.row_number().over(w.orderBy("lag"))).filter("_r <= _keep").drop("_keep", "_r")


def angles(tracks: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """(keys, frame, angle): heading differences in degrees, wrapped to [-180, 180]."""
    w = Window.partitionBy(*keys).orderBy("frame", "spot")
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    heads = tracks.withColumn("_h", F.atan2(ny - F.col("y"), nx - F.col("x"))).withColumn("_h2", F.lead("_h").over(w)).filter("_h2 is not null")
    d = F.degrees(F.col("_h2") - F.col("_h"))
    return heads.select(*keys, "frame", F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d).alias("angle"))


def angle_fractions(turns: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """(keys, f0 .. f5): shares of absolute angles in six bins of 30 degrees, half open, the last closed."""
    b = F.least(F.floor(F.abs("angle") / 30), F.lit(5))
    return turns.withColumn("_b", b).groupBy(*keys).agg(*((F.count_if(F.col("_b") == i) / F.count("*")).alias(f"f{i}") for i in range(6)))


def diffusion(curve: DataFrame, keys: Sequence[str] = TRACK, interval: float = 1.0) -> DataFrame:
    """K2: linear and log-log fits of the first lags: D = slope / (8/3) if slope > 0, sigma = 1000 sqrt(b / 4) if b >= 0, r2;
    alpha = log-log slope, log10_D = intercept - log10 4, loglog_r2."""
    c = fit_lags(curve, keys).withColumn("_t", F.col("lag") * interval)
    c = c.withColumn("_lt", safe_log10(F.col("_t"))).withColumn("_lm", safe_log10(F.col("msd")))
    fit = c.groupBy(*keys).agg(F.regr_slope("msd", "_t").alias("slope"), F.regr_intercept("msd", "_t").alias("intercept"), F.regr_r2("msd", "_t").alias("r2"), F.regr_slope("_lm", "_lt").alias("alpha"), F.regr_intercept("_lm", "_lt").alias("_b"), F.regr_r2("_lm", "_lt").alias("loglog_r2"))
    fit = fit.withColumn("D", F.when(F.col("slope") > 0, F.col("slope") / (8 / 3))).withColumn("sigma", F.when(F.col("intercept") >= 0, 1000 * F.sqrt(F.col("intercept") / 4)))
    return fit.withColumn("log10_D", F.col("_b") - F.log10(F.lit(4.0))).drop("_b")


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points (rows x, y), in order."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    halves = []
    for some in (points.tolist(), points[::-1].tolist()):
        half: list[list[float]] = []
        for p in some:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (p[1] - half[-2][1]) <= (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0]):
                half.pop()
            half.append(p)
        halves += half[:-1]
    return np.array(halves)


def farthest(corners: np.ndarray) -> float:
    """The largest distance between corners of a hull: blocks of rows against all, in bounded memory."""
    best, step = 0.0, max(1, HULL_PAIRS // max(1, len(corners)))
    for at in range(0, len(corners), step):
        d = corners[at : at + step, None] - corners
        best = max(best, float((d * d).sum(2).max()))
    return math.sqrt(best)


def diameters(tracks: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """(keys, max_distance): the farthest two points of each track. A task keeps the hull's corners of what it has of a track, these
    meet by track, and only the corners of the last hull are compared. Points without coordinates don't count."""
    some = tracks.select(F.struct(*keys).alias("_k"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x is not null and y is not null")
    rows = some.select("_k", F.xxhash64("_k").alias("_h"), "x", "y").filter(~F.isnan("x") & ~F.isnan("y"))

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, xy = b.column("_h").to_numpy(), np.stack([b.column(c).to_numpy() for c in ("x", "y")], axis=1)
            order = np.argsort(h, kind="stable")
            bounds = np.r_[0, np.flatnonzero(np.diff(h[order])) + 1, len(h)]
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                if j > i:
                    own = hull(xy[order[i:j]])
                    key = b.column("_k").take(pa.array(np.full(len(own), order[i])))
                    yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(own), h[order[i]])), pa.array(own[:, 0]), pa.array(own[:, 1])], ["_k", "_h", "x", "y"])

    def widest(group: pa.Table) -> pa.Table:
        last = hull(np.stack([group[c].to_numpy() for c in ("x", "y")], axis=1))
        return pa.table({"_k": group["_k"].slice(0, 1), "max_distance": pa.array([farthest(last)])})

    key = rows.schema["_k"].dataType.simpleString()
    met = rows.mapInArrow(corners, f"_k {key}, _h long, x double, y double")
    return met.groupBy("_k").applyInArrow(widest, f"_k {key}, max_distance double").select("_k.*", "max_distance")


def aio_table(tracks: DataFrame, keys: Sequence[str] = TRACK, intensity: str = "value", max_lag: int | None = None) -> DataFrame:
    """One row a track: arrays of t, x, y, end-to-end and mean step, largest pairwise distance, mean and largest intensity, and the fits."""
    rows = tracks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("frame").cast("long").alias("frame"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("_p"), F.avg(intensity).alias("mean_intensity"), F.max(intensity).alias("max_intensity"), F.count("*").alias("n"))
    d = lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    p = F.col("_p")
    n = F.size(p)
    steps = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: d(F.get(p, i), F.get(p, i - 1))))
    out = rows.withColumn("list_of_t", F.transform(p, lambda q: q["frame"])).withColumn("list_of_x", F.transform(p, lambda q: q["x"])).withColumn("list_of_y", F.transform(p, lambda q: q["y"]))
    out = out.withColumn("end_to_end", d(F.get(p, n - 1), F.get(p, F.lit(0)))).withColumn("mean_step", F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / (n - 1))
    out = out.join(diameters(tracks, keys), list(keys), "left").withColumn("max_distance", F.coalesce("max_distance", F.lit(0.0)))
    return out.drop("_p").join(diffusion(msd(tracks, keys, max_lag), keys), list(keys), "left")


def explode_tracks(aio: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """U8: arrays (or their texts) of t, x, y to detections, with a running trajectory number."""
    parse = lambda c: F.from_json(c, "array<double>") if dict(aio.dtypes)[c] == "string" else F.col(c).cast("array<double>")
    ids = numbered(aio.select(*keys).distinct(), keys, "trajectory").withColumn("trajectory", (F.col("trajectory") + 1).cast("int"))
    z = aio.select(*keys, F.explode(F.arrays_zip(parse("list_of_t").alias("t"), parse("list_of_x").alias("x"), parse("list_of_y").alias("y"))).alias("d"))
    return z.select(*keys, F.col("d.t").alias("frame"), F.col("d.x").alias("x"), F.col("d.y").alias("y")).join(ids, list(keys))


def assign_cell(tracks: DataFrame, keys: Sequence[str] = TRACK, label: str = "cell") -> DataFrame:
    """(keys, cell, confidence, labels, ambiguous): mode of labels other than 0 (ties: smallest), else 0; confidence is
    the share of rows equal to it, zeros included; labels is the ';' list; ambiguous: several labels, or confidence below 1."""
    mode = tracks.groupBy(*keys).agg(F.coalesce(F.mode(F.when(F.col(label) != 0, F.col(label)), True), F.lit(0)).alias("_cell"), F.array_sort(F.collect_set(label)).alias("_labels"))
    out = tracks.join(mode, list(keys)).groupBy(*keys).agg(F.first("_cell").alias("cell"), F.avg((F.col(label) == F.col("_cell")).cast("double")).alias("confidence"), F.first("_labels").alias("_l"))
    return out.select(*keys, "cell", "confidence", F.concat_ws(";", F.col("_l").cast("array<string>")).alias("labels"), ((F.size("_l") > 1) | (F.col("confidence") < 1)).alias("ambiguous"))


def mobile(df: DataFrame, step: float = 30.0, alpha: float = 0.7) -> DataFrame:
    """Mean step in nm and alpha strictly above the limits."""
    return df.filter((F.col("mean_step_nm") > step) & (F.col("alpha") > alpha))


def filter_metric(df: DataFrame, metric: str, step: float = 30.0, r2: float = 0.7, alpha: float = 0.5) -> DataFrame:
    """Rows that count for a metric."""
    good = (F.col("mean_step_nm") > step) & (F.col("r2") > r2)
    rules = {"sigma": good, "D": good & (F.col("alpha") > alpha), "alpha": (F.col("loglog_r2") > r2) & (F.col("alpha") > 0)}
    return df.filter(rules[metric]) if metric in rules else df


def fraction_tables(df: DataFrame, keys: Sequence[str] = ("condition",), file: str = "file", step: float = 30.0, alpha: float = 0.5) -> DataFrame:
    """Mean and sem over files of the immobile (step below), constrained (mobile, alpha at most) and normal (mobile,
    alpha above) shares; a null alpha is in neither of the two."""
    moving = F.col("mean_step_nm") >= step
    kinds = {"immobile": F.col("mean_step_nm") < step, "constrained": moving & (F.col("alpha") <= alpha), "normal": moving & (F.col("alpha") > alpha)}
    per = df.groupBy(*keys, file).agg(*((F.count_if(c) / F.count("*")).alias(k) for k, c in kinds.items()))
    return per.groupBy(*keys).agg(F.count("*").alias("n_files"), *(e for k in kinds for e in (F.avg(k).alias(f"{k}_mean"), (F.stddev_samp(k) / F.sqrt(F.count("*"))).alias(f"{k}_sem"))))


def legacy_fractions(df: DataFrame, keys: Sequence[str] = ("condition",), file: str = "file", step: float = 30.0, alpha: float = 0.5) -> DataFrame:
    """As A24 by replicate, the file name before FOV; replicates without constrained rows go; constrained and
    normal shares are of the mobile rows."""
    r = df.withColumn("replicate", F.regexp_replace(file, r"[ _-]*FOV.*$", ""))
    moving = F.col("mean_step_nm") >= step
    per = r.groupBy(*keys, "replicate").agg(F.count("*").alias("n"), F.count_if(~moving).alias("i"), F.count_if(moving).alias("m"), F.count_if(moving & (F.col("alpha") <= alpha)).alias("c"), F.count_if(moving & (F.col("alpha") > alpha)).alias("o")).filter("c > 0")
    return per.groupBy(*keys).agg(F.count("*").alias("n_replicates"), F.avg(F.col("i") / F.col("n")).alias("immobile"), F.avg(F.col("c") / F.col("m")).alias("constrained"), F.avg(F.col("o") / F.col("m")).alias("normal"))


def metric_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, N, mean, median, std, sem), nulls dropped."""
    long = df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(list(keys), list(metrics), "metric", "v").filter("v is not null")
    return long.groupBy(*keys, "metric").agg(F.count("v").alias("N"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.stddev_samp("v").alias("std"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("sem"))


def cell_counts(df: DataFrame, keys: Sequence[str] = ("condition",), cell: Sequence[str] = ("file", "cell")) -> DataFrame:
    """Distinct cells above 0, rows with one, background rows (null counts as 0), all rows."""
    label = F.coalesce(F.col(cell[-1]), F.lit(0))
    return df.groupBy(*keys).agg(F.count_distinct(F.when(label > 0, F.struct(*cell))).alias("n_cells"), F.count_if(label > 0).alias("assigned"), F.count_if(label <= 0).alias("background"), F.count("*").alias("total"))


def select_crop(tracks: DataFrame, box: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Whole tracks that touch a half-open box. box: one row x0, x1, y0, y1."""
    hit = tracks.crossJoin(F.broadcast(box)).filter("x >= x0 and x < x1 and y >= y0 and y < y1").select(*keys).distinct()
    return tracks.join(hit, list(keys), "left_semi")


def extent(points: DataFrame) -> DataFrame:
    """(x0, x1, y0, y1), half open, of points or pixels."""
    return points.agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))


def occupation(df: DataFrame, keys: Sequence[str] = ("condition",)) -> DataFrame:
    """Posterior summed over the error grid by diffusion coefficient, with its log10."""
    return df.groupBy(*keys, "diff_coef").agg(F.sum("posterior").alias("occupation")).withColumn("log10_diff_coef", safe_log10(F.col("diff_coef")))


def sessions(dets: DataFrame, keys: Sequence[str], gap: int = 2, least: int = 5) -> DataFrame:
    """T4 (batch): runs of rows whose frame difference is at most gap, numbered, of least rows or more."""
    w = Window.partitionBy(*keys).orderBy("frame")
    new = F.when(F.col("frame") - F.lag("frame").over(w) <= gap, 0).otherwise(1)
    runs = dets.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return runs.groupBy(*keys, "session").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")).filter(F.col("n") >= least)
