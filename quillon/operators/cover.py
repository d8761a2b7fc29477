"""Polygons as cells of a grid in two dimensions.

A polygon's box is cut into square cells of a power of two, at most PARTS along its longer side or one more. Cells that no edge
touches lie wholly inside or outside and go by their centre; a cell that an edge touches is cut once more into FINER times FINER, so
that a long border costs small cells and a wide inside few large ones. Points meet the cells of the sizes in use by an equi-join;
in a whole cell they are inside without a look at the polygon, only in cells of the border is there something to check.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.skew import BLOCK, skewed_join
from quillon.plans.storage import materialize

PARTS, FINER = 4, 2
#: Pairs of cell and edge that a worker looks at together.
AT_ONCE = 1 << 20


def inside(x: Column, y: Column, vertices: Column) -> Column:
    """Ray casting over an array of (x, y) vertices."""
    n = F.size(vertices)

    def step(odd: Column, i: Column) -> Column:
        p, q = F.get(vertices, i), F.get(vertices, (i + n - 1) % n)
        crosses = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
        return F.when(crosses & (x < at), ~odd).otherwise(odd)

    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), step)).otherwise(False)


def with_box(polys: DataFrame) -> DataFrame:
    """polys with min_x, max_x, min_y, max_y of their vertices."""
    xs, ys = F.transform("vertices", lambda v: v["x"]), F.transform("vertices", lambda v: v["y"])
    return polys.withColumns({"min_x": F.array_min(xs), "max_x": F.array_max(xs), "min_y": F.array_min(ys), "max_y": F.array_max(ys)})


def _side(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _edges(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, ...]:
    return xs, ys, np.roll(xs, 1), np.roll(ys, 1)


def _border_and_whole(x: np.ndarray, y: np.ndarray, side: float, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of cells at (x, y): whether an edge touches the closed cell, or comes as near as rounding can tell; and whether it is
    inside, by its centre."""
    px, py, qx, qy = _edges(xs, ys)
    dx, dy = qx - px, qy - py
    border, whole = np.zeros(len(x), bool), np.zeros(len(x), bool)
    step = max(1, AT_ONCE // len(xs))
    for at in range(0, len(x), step):
        cx, cy = x[at : at + step, None], y[at : at + step, None]
        near = (np.minimum(px, qx) <= cx + side) & (np.maximum(px, qx) >= cx)
        near &= (np.minimum(py, qy) <= cy + side) & (np.maximum(py, qy) >= cy)
        off = [dx * (b - py) - dy * (a - px) for a in (cx, cx + side) for b in (cy, cy + side)]
        slack = (np.abs(dx) + np.abs(dy)) * side * 1e-9
        near &= (np.minimum.reduce(off) <= slack) & (np.maximum.reduce(off) >= -slack)
        border[at : at + step] = near.any(1)
        mx, my = cx + side / 2, cy + side / 2
        crosses = (py > my) != (qy > my)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = mx < (qx - px) * (my - py) / (qy - py) + px
        whole[at : at + step] = (crosses & left).sum(1) % 2 == 1
    return border, whole & ~border


def cells_of(xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(level, cx, cy, border) of a polygon: its whole cells, and those of its border."""
    if len(xs) < 3 or not (np.isfinite(xs).all() and np.isfinite(ys).all()):
        return []
    extent = max(np.ptp(xs), np.ptp(ys), 1e-12)
    level = math.ceil(math.log2(extent / PARTS))
    out = []
    along = [np.arange(math.floor(v.min() / 2.0**level), math.floor(v.max() / 2.0**level) + 1) for v in (xs, ys)]
    cx, cy = (v.ravel() for v in np.meshgrid(*along, indexing="ij"))
    border, whole = _border_and_whole(cx * 2.0**level, cy * 2.0**level, 2.0**level, xs, ys)
    out += [(level, a, b, False) for a, b in zip(cx[whole].tolist(), cy[whole].tolist(), strict=True)]
    i, j = (v.ravel() for v in np.meshgrid(np.arange(FINER), np.arange(FINER), indexing="ij"))
    cx, cy = ((v[border, None] * FINER + k).ravel() for v, k in ((cx, i), (cy, j)))
    level -= FINER.bit_length() - 1
    border, whole = _border_and_whole(cx * 2.0**level, cy * 2.0**level, 2.0**level, xs, ys)
    return out + [(level, a, b, c) for a, b, c, d in zip(*(v.tolist() for v in (cx, cy, border, border | whole)), strict=True) if d]


def cover(polys: DataFrame, more: Sequence[str]) -> DataFrame:
    """(more, level, cx, cy, border): the cells of each polygon, with the columns named. polys: vertices array<struct<x, y>>."""
    names = ("level", "cx", "cy", "border")

    @F.pandas_udf("array<struct<level:int,cx:bigint,cy:bigint,border:boolean>>")
    def cells(xs: pd.Series, ys: pd.Series) -> pd.Series:
        numbers = lambda v: np.array([], float) if v is None else np.asarray(v, float)
        return pd.Series([[dict(zip(names, c, strict=True)) for c in cells_of(numbers(x), numbers(y))] for x, y in zip(xs, ys, strict=True)])

    along = lambda c: F.transform("vertices", lambda v: v[c].cast("double"))
    return polys.select(*more, F.inline(cells(along("x"), along("y"))))


def candidates(points: DataFrame, polys: DataFrame, on: Sequence[str], more: Sequence[str], block: int | None = BLOCK) -> DataFrame:
    """points (on, px, py, ...) with the columns `more` of the polygons (on, vertices, ...) in whose cells they are, and border:
    whether that is still to be checked. Other columns of points must have names that polygons don't have."""
    cells = materialize(cover(polys, [*on, *more]), "cover")
    levels = F.broadcast(cells.select("level").distinct())  # as many as there are sizes of doubles at most, a few in practice
    there = points.filter("px is not null and py is not null and not isnan(px) and not isnan(py)").crossJoin(levels)
    there = there.withColumns({"cx": F.floor(F.col("px") / _side(F.col("level"))), "cy": F.floor(F.col("py") / _side(F.col("level")))})
    return skewed_join(there, cells, [*on, "level", "cx", "cy"], block).drop("level", "cx", "cy")
