"""Equi-joins whose keys may be hot: heavy keys are cut into blocks of both sides, and pairs of blocks are dealt.

Rows of both sides are counted by key. A key with more than BLOCK rows on either side is heavy: its left rows are dealt to
blocks i of at most about BLOCK rows and its right rows to blocks j, each left row goes to all pairs (i, j) of its own i, each
right row to all of its own j. Every pair of rows so meets once, in the one pair of blocks that both are in, and a task holds two
blocks at most. All other keys have the one pair (0, 0), as in a plain join.

At most HEAVY keys, those with the most rows, are cut, which bounds what is broadcast; a further key then has no more than one
row in HEAVY. Blocks go by a hash of the whole row, so a task that runs again deals its rows as before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.storage import materialize

#: Rows of a block, and keys that are cut at most.
BLOCK, HEAVY = 1 << 20, 1 << 16


def heavy_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(keys, _li, _rj): the numbers of blocks of either side, for keys that both sides have and one has more than a block of."""
    sizes = [d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in ((left, "_nl"), (right, "_nr"))]
    both = sizes[0].join(sizes[1], list(keys)).filter((F.col("_nl") > block) | (F.col("_nr") > block))
    most = both.orderBy(F.desc(F.col("_nl") + F.col("_nr")), *keys).limit(HEAVY)
    return most.select(*keys, F.ceil(F.col("_nl") / block).cast("int").alias("_li"), F.ceil(F.col("_nr") / block).cast("int").alias("_rj"))


def in_blocks(side: DataFrame, heavy: DataFrame, keys: Sequence[str], own: str, other: str) -> DataFrame:
    """A side with (_bi, _bj), the pairs of blocks that its rows go to."""
    block, pair = ("_bi", "_bj") if own == "_li" else ("_bj", "_bi")
    mine = F.when(F.col(own) > 1, F.pmod(F.xxhash64(*side.columns), F.col(own))).otherwise(0).cast("int")
    dealt = side.join(F.broadcast(heavy), list(keys), "left").withColumn(block, mine)
    every = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
    return dealt.withColumn(pair, F.explode(every)).drop("_li", "_rj")


def skewed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], block: int | None = BLOCK) -> DataFrame:
    """The inner join of two sides, whose other columns have different names, on equal keys; block None: a plain join. Keys are
    counted when the join is made, once, unless both sides are smaller than a block; where none is heavy the join is a plain one."""
    if block is None or all(d.select(*keys).limit(block + 1).count() <= block for d in (left, right)):
        return left.join(right, list(keys))
    heavy = materialize(heavy_keys(left, right, keys, block), "heavy")
    if heavy.isEmpty():
        return left.join(right, list(keys))
    a, b = in_blocks(left, heavy, keys, "_li", "_rj"), in_blocks(right, heavy, keys, "_rj", "_li")
    return a.join(b, [*keys, "_bi", "_bj"]).drop("_bi", "_bj")
