"""Hot keys, hot buckets and polygons by cells: the same pairs, with bounded tasks."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import cover, intervals, skew, spatial


def amplicon(spark, n=3000):
    """Reads of which 99 % start in one bucket, and windows of which most lie there too."""
    rng = random.Random(1)
    reads = [(i, "c", *sorted(rng.sample(range(5000, 5900), 2))) if i % 100 else (i, "c", i * 7, i * 7 + 50) for i in range(n)]
    windows = [(i, "c", 5000 + i * 3, 5010 + i * 3) for i in range(200)] + [(900 + i, "c", i * 700, i * 700 + 900) for i in range(30)]
    left = spark.createDataFrame(reads, "read long, contig string, a0 long, a1 long")
    right = spark.createDataFrame(windows, "win long, contig string, b0 long, b1 long")
    want = {(r, w) for r, _, a, b in reads for w, _, c, d in windows if a <= d and c <= b}
    return left, right, want


@pytest.mark.parametrize("block", [None, 40, 700])
def test_a_hot_bucket_gives_the_same_pairs(spark, block):
    left, right, want = amplicon(spark)
    got = [(r.read, r.win) for r in intervals.range_join(left, right, ("a0", "a1"), ("b0", "b1"), ["contig"], 1024, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    for how, one in (("left_semi", True), ("left_anti", False)):
        some = right.filter("win < 3")
        kept = {r.read for r in intervals.range_join(left, some, ("a0", "a1"), ("b0", "b1"), ["contig"], 1024, how, block).collect()}
        assert kept == {r.read for r in left.collect() if one == any((r.read, w) in want for w in range(3))}


def test_no_task_of_a_hot_bucket_is_large(spark):
    """What one task gets of a bucket that nearly all reads share: a block of either side, give or take the hash."""
    left, right, _ = amplicon(spark)
    a, b = intervals._bucketed(left, ("a0", "a1"), 1024), intervals._bucketed(right, ("b0", "b1"), 1024)
    keys = ["contig", "_bucket"]
    heavy = skew.heavy_keys(a, b, keys, 50)
    assert heavy.count() >= 1
    cut = [(skew.in_blocks(a, heavy, keys, "_li", "_rj"), a), (skew.in_blocks(b, heavy, keys, "_rj", "_li"), b)]
    for blocks, whole in cut:
        assert whole.groupBy(*keys).count().agg(F.max("count")).first()[0] > 150
        assert blocks.groupBy(*keys, "_bi", "_bj").count().agg(F.max("count")).first()[0] < 100
    plan = intervals.range_join(left, right, ("a0", "a1"), ("b0", "b1"), ["contig"], 1024, block=50)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_skewed_join_by_plain_join(spark):
    rng = random.Random(2)
    left = spark.createDataFrame([(i, rng.choice([None, 1, 1, 1, 2, 3, i])) for i in range(400)], "a long, k long")
    right = spark.createDataFrame([(i, rng.choice([None, 1, 2, 2, i])) for i in range(300)] + [(7, 1)] * 5, "b long, k long")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    for block in (1, 13, 90, 10_000):
        assert sorted(map(tuple, skew.skewed_join(left, right, ["k"], block).collect())) == want
    none = left.filter("false")
    assert skew.skewed_join(none, right, ["k"], 13).count() == skew.skewed_join(right, none, ["k"], 13).count() == 0


def plain_inside(x, y, v):
    odd = False
    for (px, py), (qx, qy) in zip(v, v[-1:] + v[:-1], strict=True):
        if (py > y) != (qy > y) and x < (qx - px) * (y - py) / (qy - py) + px:
            odd = not odd
    return odd


def test_points_in_odd_polygons_by_brute_force(spark):
    """Stars, slivers, tiny and huge polygons, points on vertices, edges and cell borders, coordinates without a value."""
    import math

    rng = random.Random(4)
    shapes = {}
    for i in range(40):
        cx, cy, size, n = rng.uniform(-50, 50), rng.uniform(-50, 50), 2.0 ** rng.randrange(-4, 6), rng.choice([3, 4, 7, 20])
        shapes[i] = [(cx + size * rng.uniform(0.2, 1) * math.cos(6.283 * k / n), cy + size * rng.uniform(0.2, 1) * math.sin(6.283 * k / n)) for k in range(n)]
    shapes |= {50: [(-8.0, -8.0), (8.0, -8.0), (8.0, 8.0), (-8.0, 8.0)], 51: [(0.0, 0.0), (64.0, 0.5), (64.0, 0.75)], 52: [(1.0, 1.0), (2.0, 2.0)], 53: [(3.0, 3.0)] * 3}
    points = [(rng.uniform(-60, 60), rng.uniform(-60, 60)) for _ in range(1500)] + [v for s in shapes.values() for v in s]
    points += [(float(x), float(y)) for x in range(-9, 10, 2) for y in range(-9, 10)] + [(8.0, 0.0), (0.0, 8.0), (-8.0, -8.0)]
    rows = [(i, "f", x, y) for i, (x, y) in enumerate(points)] + [(-1, "f", None, 1.0), (-2, "f", float("nan"), 1.0), (-3, "g", 0.0, 0.0)]
    polys = spark.createDataFrame([("f", i, v) for i, v in shapes.items()] + [("f", 60, None), ("f", 61, [])], "fov string, cell long, vertices array<struct<x:double,y:double>>")
    table = spark.createDataFrame(rows, "point long, fov string, x double, y double")
    want = {i: min((c for c, v in shapes.items() if plain_inside(x, y, v)), default=-1) for i, (x, y) in enumerate(points)} | {-1: -1, -2: -1, -3: -1}
    for block in (None, 9):
        got = {r.point: r.cell for r in spatial.in_polygon(table, polys, block=block).collect()}
        assert got == want
    assert len(set(want.values())) > 20


def test_outer_polygons_by_brute_force(spark):
    rng = random.Random(5)
    shapes = {}
    for i in range(120):
        x, y, r = rng.uniform(0, 60), rng.uniform(0, 60), rng.choice([1, 2, 5, 20])
        shapes[i] = [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]
    box = {i: (v[1][0] - v[0][0]) * (v[2][1] - v[1][1]) for i, v in shapes.items()}
    want = {i for i, v in shapes.items() if not any(box[j] > box[i] and all(plain_inside(x, y, w) for x, y in v) for j, w in shapes.items() if j != i)}
    polys = spark.createDataFrame([("f", i, v) for i, v in shapes.items()], "fov string, cell long, vertices array<struct<x:double,y:double>>")
    assert {r.cell for r in spatial.outer_only(polys).collect()} == want and 5 < len(want) < 115


def test_candidates_follow_hits_on_a_grid_of_polygons(spark):
    """100 x 100 polygons and points all over: nearly every candidate is a hit, and most hits need no check."""
    side = F.sequence(F.lit(0), F.lit(99))
    grid = spark.range(1).select(F.explode(side).alias("i")).select("i", F.explode(side).alias("j"))
    corner = lambda a, b: F.struct((F.col("i") * 10 + a).cast("double").alias("x"), (F.col("j") * 10 + b).cast("double").alias("y"))
    octagon = F.array(corner(3, 1), corner(7, 1), corner(9, 3), corner(9, 7), corner(7, 9), corner(3, 9), corner(1, 7), corner(1, 3))
    polys = grid.select(F.lit("f").alias("fov"), (F.col("i") * 100 + F.col("j")).alias("cell"), octagon.alias("vertices"))
    points = spark.range(20_000).select(F.lit("f").alias("fov"), F.col("id").alias("point"), (F.rand(1) * 1000).alias("px"), (F.rand(2) * 1000).alias("py"))
    met = cover.candidates(points, polys, ["fov"], ["cell"])
    n, border = met.agg(F.count("*"), F.count_if("border")).first()
    hits = spatial.in_polygon(points.withColumnsRenamed({"px": "x", "py": "y"}), polys).filter("cell >= 0").count()
    assert 0.5 < hits / 20_000 < 0.6 and hits <= n < 2 * hits and border < 0.8 * n  # edges along cells are the worst case
