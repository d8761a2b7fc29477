"""Quantiles and ranks by group, whatever the size of a group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import ordering, stats

QS = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]


def table(spark):
    """One group holds nearly all rows, one a single row, one nulls only, one has no key."""
    rng = random.Random(7)
    rows = [("hot", 1, float(rng.choice([rng.randrange(30), rng.random()]))) for _ in range(3000)]
    rows += [(None, 2, float(rng.randrange(9))) for _ in range(200)] + [("x", None, 1.5), ("none", 1, None), ("two", 1, 2.0), ("two", 1, 5.0), ("two", 2, None)]
    rng.shuffle(rows)
    groups = {}
    for a, b, v in rows:
        groups.setdefault((a, b), []).append(v)
    return spark.createDataFrame(rows, "a string, b int, v double"), {k: [x for x in v if x is not None] for k, v in groups.items()}


@pytest.mark.parametrize("most", [1, 100, ordering.MOST])
def test_quantiles_of_groups(spark, most):
    df, groups = table(spark)
    got = {(r.a, r.b): r._q for r in ordering.group_quantiles(df, ["a", "b"], F.col("v"), QS, most).collect()}
    assert got.keys() == {k for k, v in groups.items() if v}
    for k, q in got.items():
        assert q == pytest.approx(np.quantile(groups[k], QS))
    base = df.groupBy("a", "b").agg(F.count("*").alias("n"))
    named = {(r.a, r.b): r for r in ordering.with_quantiles(base, df, ["a", "b"], F.col("v"), {"mid": 0.5, "top": 1.0}, most).collect()}
    assert named.keys() == groups.keys() and named["none", 1].mid is None and named["none", 1].n == 1
    assert all(r.mid == pytest.approx(np.median(groups[k])) and r.top == max(groups[k]) for k, r in named.items() if groups[k])
    assert ordering.group_quantiles(df.filter("false"), ["a"], F.col("v"), QS, most).count() == 0


@pytest.mark.parametrize("most", [1, 100, ordering.MOST])
def test_ranks_of_groups(spark, most):
    df, groups = table(spark)
    got = {}
    for r in ordering.ranked(df, ["a", "b"], F.col("v"), most).collect():
        got.setdefault((r.a, r.b), {})[r._v] = (r._c, r._before)
    assert got == {k: {x: (v.count(x), sum(y < x for y in v)) for x in set(v)} for k, v in groups.items() if v}


def test_a_group_as_large_as_the_table_is_dealt_by_ranges(spark):
    """Every range holds a part of the one group; no window or buffer holds more than a range."""
    counts = spark.range(20_000).select(F.struct(F.lit(1).alias("k")).alias("_k"), (F.col("id") * 0.5).alias("_v"), (F.col("id") % 3 + 1).alias("_c"))
    placed, spans = ordering.ranged(counts)
    assert spans.count() >= 4 and placed.groupBy("_range").count().agg(F.max("count")).first()[0] < 10_000
    last = placed.agg(F.max(F.col("_before") + F.col("_c"))).first()[0]
    assert last == counts.agg(F.sum("_c")).first()[0]


def test_statistics_without_a_limit_on_groups(spark, monkeypatch):
    df, groups = table(spark)
    whole = df.filter("v is not null")
    want = {f: sorted(map(str, f(whole).collect())) for f in (lambda d: stats.safe_stats(d, ["a", "b"], "v"), lambda d: stats.robust_sigma(d, ["a"], "v", 2), lambda d: stats.dispersion(d, ["a", "b"], "v"))}
    for f, rows in want.items():
        monkeypatch.setattr(ordering, "MOST", 3)
        got = f(whole).collect()
        assert len(got) == len(rows)
    hot = next(r for r in stats.dispersion(whole, ["a", "b"], "v").collect() if r.a == "hot")
    v = np.sort(groups["hot", 1])
    n = len(v)
    assert hot.gini == pytest.approx(2 * (np.arange(1, n + 1) * v).sum() / (n * v.sum()) - (n + 1) / n)
