"""Statistics by group: blocks, histograms, regressions, tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.operators.ordering import quantiles, ranked, running, with_quantiles


def finite(c: Column) -> Column:
    """The value if it is finite, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def safe_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """N, mean, median, population std, q90 and max of finite values."""
    v = df.withColumn("_v", finite(F.col(value).cast("double")))
    out = v.groupBy(*keys).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.max("_v").alias("max"))
    return with_quantiles(out, v, keys, F.col("_v"), {"median": 0.5, "q90": 0.9})


def counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A1: rows by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def detector_summary(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Count, median and q90 of measures; null keys are a group."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"))
    for m in measures:
        out = with_quantiles(out, df, keys, F.col(m), {f"{m}_median": 0.5, f"{m}_q90": 0.9})
    return out


def screen_summary(df: DataFrame, keys: Sequence[str], value: str, flag: str, first: str, order: str) -> DataFrame:
    """Count, the first of a column in order, sum of flags, median, population std, q90, max."""
    n = [F.count("*").alias("n"), F.min_by(first, order).alias(first), F.count_if(F.col(flag)).alias("n_flagged")]
    out = df.groupBy(*keys).agg(*n, F.stddev_pop(value).alias("std"), F.max(value).alias("max"))
    return with_quantiles(out, df, keys, F.col(value), {"median": 0.5, "q90": 0.9})


def control_threshold(ctrl: DataFrame, value: str, q: float | None = 0.95, manual: float | None = None) -> DataFrame:
    """One row, threshold: the linear quantile (or the largest, q None) of finite control values, or the manual one."""
    v = finite(F.col(value).cast("double"))
    if manual is None and q is not None:
        return quantiles(ctrl, v, [q]).select(F.col("q0").alias("threshold"))
    return ctrl.agg((F.max(v) if manual is None else F.lit(float(manual))).alias("threshold"))


def sweep_k(df: DataFrame, ks: Sequence[float], value: str, median: str, std: str, first: str, last: str) -> DataFrame:
    """For each multiplier the retained rows (value >= median + k std), and means of a first and a last column over them."""
    k = F.explode(F.array(*(F.lit(float(x)) for x in ks))).alias("k")
    kept = df.select("*", k).filter(F.col(value) >= F.col(median) + F.col("k") * F.col(std))
    return kept.groupBy("k").agg(F.count("*").alias("retained"), F.avg(first).alias("first_mean"), F.avg(last).alias("last_mean"))


def tails(df: DataFrame, value: str, q: float = 0.1) -> DataFrame:
    """Low at or below the q quantile, high at or above the 1 - q quantile, else middle."""
    cuts = quantiles(df, F.col(value), [q, 1 - q]).select(F.col("q0").alias("_lo"), F.col("q1").alias("_hi"))
    c = F.col(value)
    return df.crossJoin(F.broadcast(cuts)).withColumn("group", F.when(c <= F.col("_lo"), "low").when(c >= F.col("_hi"), "high").otherwise("middle")).drop("_lo", "_hi")


def hist(df: DataFrame, value: str, lo: float, hi: float, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, count, probability, density): half-open bins, the last closed, values outside dropped; each group sums to 1."""
    width = (hi - lo) / n
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(n - 1))
    out = df.filter(F.col(value).between(lo, hi)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("count"))
    out = out.withColumn("probability", F.col("count") / F.sum("count").over(Window.partitionBy(*keys)))
    return out.withColumn("density", F.col("probability") / width)


def hist2d(df: DataFrame, x: str, y: str, n: int = 5) -> DataFrame:
    """(bx, by, count, density) over unit bins of [0, n], the last closed."""
    b = lambda c: F.least(F.floor(c), F.lit(n - 1))
    out = df.filter(F.col(x).between(0, n) & F.col(y).between(0, n)).groupBy(b(F.col(x)).alias("bx"), b(F.col(y)).alias("by")).agg(F.count("*").alias("count"))
    return out.withColumn("density", F.col("count") / F.sum("count").over(Window.partitionBy()))


def robust_sigma(df: DataFrame, keys: Sequence[str], value: str, rounds: int = 0, limit: float = 3.0) -> DataFrame:
    """(keys, sigma): 1.4826 times the median absolute deviation; up to three rounds drop what is beyond limit sigma first."""
    now = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    median = lambda d, c, name: with_quantiles(d.groupBy(*keys).agg(F.count("*").alias("_n")), d, keys, F.col(c), {name: 0.5}).drop("_n")
    meet = lambda d, one: d.join(one, list(keys)) if keys else d.crossJoin(F.broadcast(one))
    for i in range(rounds + 1):
        dev = meet(now, median(now, "_v", "_m")).withColumn("_d", F.abs(F.col("_v") - F.col("_m")))
        sigma = median(dev, "_d", "_s").withColumn("sigma", 1.4826 * F.col("_s")).drop("_s")
        if i == rounds:
            return sigma
        now = meet(dev, sigma).filter((F.col("sigma") == 0) | (F.col("_d") <= limit * F.col("sigma"))).select(*keys, "_v")
    return now


def dispersion(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, gini, cv, robust): sorted-rank Gini, population std over mean, (P90 - P10) / median if that is positive; a
    negative value or a zero mean is an error. Ranks of equal values are summed at once."""
    v = F.col(value).cast("double")
    base = df.groupBy(*keys).agg((F.min(v) < 0).alias("_low"), F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std"), F.count(v).alias("_n"), F.sum(v).alias("_sum"))
    ranks = F.col("_c") * F.col("_before") + F.col("_c") * (F.col("_c") + 1) / 2
    weighted = ranked(df, keys, v).groupBy(*keys).agg(F.sum(ranks * F.col("_v")).alias("_w"))
    out = base.select("*", F.struct(*keys).alias("_k")).join(weighted.select(F.struct(*keys).alias("_k"), "_w"), "_k", "left").drop("_k") if keys else base.crossJoin(F.broadcast(weighted))
    out = with_quantiles(out, df, keys, v, {"_p10": 0.1, "_p50": 0.5, "_p90": 0.9})
    n = F.col("_n")
    gini = 2 * F.col("_w") / (n * F.col("_sum")) - (n + 1) / n
    bad = F.raise_error(F.lit("negative values or zero mean")).cast("double")
    robust = F.when(F.col("_p50") > 0, (F.col("_p90") - F.col("_p10")) / F.col("_p50"))
    return out.select(*keys, F.when(F.col("_low") | (F.col("_mean") == 0), bad).otherwise(gini).alias("gini"), (F.col("_std") / F.nullif("_mean", F.lit(0.0))).alias("cv"), robust.alias("robust"))


def mean_ci(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean with the normal 95 % interval."""
    half = 1.959963984540054 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def box_stats(df: DataFrame, condition: str, columns: Sequence[str]) -> DataFrame:
    """Quartiles by column and condition."""
    long = df.select(condition, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([condition], list(columns), "column", "v")
    out = long.groupBy(condition, "column").agg(F.count("*").alias("_n"))
    return with_quantiles(out, long, [condition, "column"], F.col("v"), {"q1": 0.25, "q2": 0.5, "q3": 0.75}).drop("_n")


def calibrate(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """K3: rows with slope, intercept, r2 of the least-squares line of y on x, and predicted."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    out = df.join(fit, list(keys)) if keys else df.crossJoin(F.broadcast(fit))
    return out.withColumn("predicted", F.col("slope") * F.col(x) + F.col("intercept"))


# --- tests ---------------------------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    from math import lgamma

    return np.vectorize(lgamma, otypes=[float])(x)


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t: the regularized incomplete beta function by its continued fraction."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    x, a, b = df / (df + t * t), df / 2, np.full_like(df, 0.5)
    swap = x > (a + 1) / (a + b + 2)
    x0, a0, b0 = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        c, d = np.ones_like(x0), 1 / np.where(np.abs(1 - (a0 + b0) * x0 / (a0 + 1)) < tiny, tiny, 1 - (a0 + b0) * x0 / (a0 + 1))
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (b0 - m) * x0 / ((a0 + 2 * m - 1) * (a0 + 2 * m)), -(a0 + m) * (a0 + b0 + m) * x0 / ((a0 + 2 * m) * (a0 + 2 * m + 1))):
                d = 1 / np.where(np.abs(1 + num * d) < tiny, tiny, 1 + num * d)
                c = np.where(np.abs(1 + num / c) < tiny, tiny, 1 + num / c)
                h = h * d * c
        front = np.exp(_log_gamma(a0 + b0) - _log_gamma(a0) - _log_gamma(b0) + a0 * np.log(x0) + b0 * np.log1p(-x0)) / a0
        p = np.where(swap, 1 - front * h, front * h)
    return np.where(np.isnan(t) | np.isnan(df), np.nan, np.clip(p, 0, 1))


def log_beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """log I_x(a, b) for 0 < x < 1, also where I is too small for a double: the continued fraction, on the side where it is short."""
    swap = x > (a + 1) / (a + b + 2)
    x0, a0, b0 = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    keep = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones_like(x0), 1 / keep(1 - (a0 + b0) * x0 / (a0 + 1))
    h, m = d.copy(), 0
    while len(h):
        m += 1
        old = h
        for num in (m * (b0 - m) * x0 / ((a0 + 2 * m - 1) * (a0 + 2 * m)), -(a0 + m) * (a0 + b0 + m) * x0 / ((a0 + 2 * m) * (a0 + 2 * m + 1))):
            d, c = 1 / keep(1 + num * d), keep(1 + num / c)
            h = h * d * c
        if np.abs(h - old).max() <= 1e-15 * np.abs(h).max() and (np.abs(h - old) <= 1e-14 * np.abs(h)).all():
            break
    front = _log_gamma(a0 + b0) - _log_gamma(a0) - _log_gamma(b0) + a0 * np.log(x0) + b0 * np.log1p(-x0) - np.log(a0)
    part = front + np.log(h)
    return np.where(swap, np.log1p(-np.exp(np.minimum(part, -1e-16))), np.minimum(part, 0.0))


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of t with df degrees of freedom; one row a test, so little data."""
    return pd.Series(t_tail(t.astype(float).to_numpy(), df.astype(float).to_numpy())).replace({np.nan: None}).astype(object)


def _moments(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    return df.groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))


def _pairs(m: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    a, b = (m.select(*keys, *(F.col(c).alias(f"{c}{i}") for c in (group, "n", "m", "v"))) for i in (1, 2))
    return a.join(b, list(keys)).filter(F.col(f"{group}1") < F.col(f"{group}2")) if keys else a.crossJoin(F.broadcast(b)).filter(F.col(f"{group}1") < F.col(f"{group}2"))


def welch(df: DataFrame, group: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """K9: t, df and p of the unequal-variance test for each pair of groups; from one aggregated row a group."""
    p = _pairs(_moments(df, keys, group, value), keys, group)
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    p = p.withColumn("t", (F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)).withColumn("df", (e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1)))
    return p.withColumn("p", t_pvalue("t", "df")).select(*keys, f"{group}1", f"{group}2", "n1", "n2", "m1", "m2", "t", "df", "p")


def ttest(df: DataFrame, group: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-variance t, df, p for each pair of groups."""
    p = _pairs(_moments(df, keys, group, value), keys, group).withColumn("df", (F.col("n1") + F.col("n2") - 2).cast("double"))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / F.col("df")
    p = p.withColumn("t", (F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))))
    return p.withColumn("p", t_pvalue("t", "df")).select(*keys, f"{group}1", f"{group}2", "t", "df", "p")


def ttest_1samp(df: DataFrame, keys: Sequence[str], value: str, mu: float = 1.0) -> DataFrame:
    """T, df, p of a group's mean against mu."""
    m = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    m = m.withColumn("t", (F.col("m") - mu) / (F.col("s") / F.sqrt("n"))).withColumn("df", (F.col("n") - 1).cast("double"))
    return m.withColumn("p", t_pvalue("t", "df"))


def mwu(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """One row: U of the first group, z with tie correction, two-sided p by the normal approximation. Values are
    counted first, and ranks run over ranges of them."""
    c = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("t"), F.count_if(F.col(group) == first).alias("a"))
    c = running(c, [value], F.col("t")).withColumn("rank", F.col("_before") + (F.col("t") + 1) / 2)
    s = c.agg(F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum("a").cast("double").alias("n1"), F.sum("t").cast("double").alias("n"), F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    n1, n = F.col("n1"), F.col("n")
    n2 = n - n1
    s = s.withColumn("U", F.col("r") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    s = s.withColumn("z", (F.col("U") - n1 * n2 / 2) / sd)
    return s.select(n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), "U", "z", normal_p(F.col("z")).alias("p"))


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal value."""
    from math import erfc, sqrt

    return z.map(lambda x: None if x is None or x != x else erfc(abs(x) / sqrt(2)))


@F.pandas_udf(DoubleType())
def binomial_log_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """-log P(X >= k), X binomial: the incomplete beta function, in about the square root of n steps."""
    k, n, p = (np.asarray(v, float) for v in (k, n, p))
    out = np.full(len(k), np.nan)
    known = ~(np.isnan(k) | np.isnan(n) | np.isnan(p))
    out[known & (k <= 0)] = 0.0
    out[known & (k > 0) & ((k > n) | (p <= 0))] = np.inf
    out[known & (k > 0) & (k <= n) & (p >= 1)] = 0.0
    asked = known & (k > 0) & (k <= n) & (p > 0) & (p < 1)
    k, n, p = np.floor(k[asked]), np.floor(n[asked]), p[asked]
    out[asked] = -log_beta_share(k, n - k + 1, p)
    return pd.Series(out)


def peak_scores(peaks: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """Peaks (peak, a, b, total_a, total_b) with -log tails of a among a + b under three null shares (even, by totals, by
    totals with pseudocounts), both tails, the larger of them."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    ta, tb = F.col("total_a").cast("double"), F.col("total_b").cast("double")
    shares = {"even": F.lit(0.5), "totals": ta / (ta + tb), "pseudo": (ta + pseudo) / (ta + tb + 2 * pseudo)}
    for name, share in shares.items():
        up = binomial_log_tail(a, a + b, share)
        down = binomial_log_tail(b, a + b, 1 - share)
        peaks = peaks.withColumn(f"{name}_up", up).withColumn(f"{name}_down", down).withColumn(f"{name}_score", F.greatest(f"{name}_up", f"{name}_down"))
    return peaks


def cap_inf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Infinite values become the largest finite value of the group plus 1."""
    top = F.max(finite(F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn(value, F.when(F.abs(value) == float("inf"), top + 1).otherwise(F.col(value)))


def find_peaks(series: DataFrame, keys: Sequence[str], at: str, value: str, height: float = 50.0) -> DataFrame:
    """Strict local maxima of at least a height, numbered in order."""
    w = Window.partitionBy(*keys).orderBy(at)
    v = F.col(value)
    out = series.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).filter((v > F.col("_a")) & (v > F.col("_b")) & (v >= height)).drop("_a", "_b")
    return out.withColumn("peak", F.row_number().over(w))


def match_ladder(peaks: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Peaks matched in order to the sizes of a ladder."""
    ladder = peaks.sparkSession.createDataFrame([(i + 1, s) for i, s in enumerate(sizes)], "peak int, size int")
    return peaks.join(F.broadcast(ladder), "peak")
