"""Operator 3: exact top-k inner products by pivot-table elimination.

Vectors are centred on their mean m, and PIVOTS pivots far from each other are taken from a bounded sample. With q' = q - m and
c' = c - m the score is q.c = q'.c' + m.c' + q.m, where q'.c' = (|q'|^2 + |c'|^2 - d(q', c')^2) / 2. For a query and a
candidate the largest |d(q', p) - d(c', p)| over the pivots is a lower bound of d(q', c') and so gives an upper bound of the score.
Pivots are looked at GROUP at a time, for as long as a group eliminates more candidates than its own cost is worth: a candidate whose
bound falls below the query's threshold isn't looked at again. What is left is evaluated in the order of the bounds, in growing
chunks, until the next bound is below the k-th best score.

Queries meet candidates in blocks of fixed size. A first pass over one block of a bounded size gives every query k exact scores;
the k-th is the threshold that all other blocks start from. Queries times candidates bounds is the work, as it is in any exact search
that no bound shortens: on vectors drawn at random from a sphere of 64 dimensions pivots eliminate little (see README), on
clustered ones nearly all.

Defined results: vectors that are null or hold null or non-finite components take no part; a missing
component of a shorter vector counts as 0; a query's own row is left out, other rows with its id aren't; each row that repeats
a query is a query, each candidate row counts; ties go to the smaller id. An empty table gives no rows. Components are whole numbers
below 2^20. Columns but id and vector aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize

PIVOTS, GROUP = 128, 16
#: Rows that the mean and the pivots are chosen from, by a hash.
SAMPLE = 4096
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
CHUNK = 64
#: A further group of pivots is looked at if the last one eliminated this share of what it met.
WORTH = 0.05
SCALE = 256
FOUND = "query long, query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): whole-number components of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    whole = F.col(vector).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("double")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """n of the rows: the longest, then again and again the one farthest from all that are chosen."""
    chosen = [int(np.argmax((rows * rows).sum(1)))] if len(rows) else []
    left = ((rows - rows[chosen[0]]) ** 2).sum(1) if chosen else None
    while len(chosen) < min(n, len(rows)):
        chosen.append(int(np.argmax(left)))
        left = np.minimum(left, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T))


def products(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Inner products, without the threads of a matrix library: a task has its own core only."""
    return np.einsum("ij,j->i", rows, one)


class Evaluated:
    """How many candidates queries met, and for how many of them the score was worked out."""

    met = scored = 0


def best(q: np.ndarray, c: np.ndarray, mean: np.ndarray, pivots: np.ndarray, floor: np.ndarray, same: np.ndarray, ids: np.ndarray, k: int, counts: Evaluated | None = None):
    """Yield (query index, candidate index, score) of the k best candidates, ties to the smaller id, whose scores are at least
    floor[query]. q, c: whole numbers; same: the index of the candidate that is the query's own row, or -1."""
    a, b = q - mean, c - mean
    dq, dc = distances(a, pivots), np.ascontiguousarray(distances(b, pivots).T)
    an, bn = (a * a).sum(1), (b * b).sum(1)
    more = b @ mean
    slack = 1e-6 * (bn + np.abs(more)) + 1
    for i in range(len(q)):
        known = bn + an[i] + 2 * (more + q[i] @ mean)  # twice the bound, before a distance is taken off
        left, low = np.arange(len(c)), np.zeros(len(c))
        for g in range(0, len(pivots), GROUP):
            near = dc[g : g + GROUP] if len(left) == len(c) else dc[g : g + GROUP, left]
            low = np.maximum(low, np.abs(near - dq[i, g : g + GROUP, None]).max(0))
            bound = (known[left] - low * low) / 2 + slack[left] + 1e-6 * an[i]
            keep = bound >= floor[i]
            few = len(left) - np.count_nonzero(keep) < WORTH * len(left)
            left, low = left[keep], low[keep]
            if few:
                break
        bound = (known[left] - low * low) / 2 + slack[left] + 1e-6 * an[i]
        own = left != same[i]
        left, bound = left[own], bound[own]
        order = np.argsort(-bound)
        top: list[tuple[int, int, int]] = []
        if counts:
            counts.met += len(c)
        at, size = 0, CHUNK
        while at < len(order) and bound[order[at]] >= max(floor[i], -top[-1][0] if len(top) == k else -np.inf):
            some = left[order[at : at + size]]
            at, size = at + size, 2 * size
            if counts:
                counts.scored += len(some)
            scores = (products(c[some], q[i]) if 4 * len(some) < len(c) else products(c, q[i])[some]).astype(np.int64)
            if len(some) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                some, scores = some[scores >= kth], scores[scores >= kth]
            top = sorted(top + [(-int(s), int(ids[j]), int(j)) for s, j in zip(scores, some, strict=True)])[:k]
        for s, _, j in top:
            yield i, j, -s


def top_k(vectors: DataFrame, is_query: Column | str, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of vectors, as scaled() returns them, that is_query holds for, against all rows."""
    spark = vectors.sparkSession
    rows = materialize(vectors.select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.filter(is_query)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_asked = asked.count()
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    share = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))
    sample = _matrix(rows.filter(share).select("v").limit(2 * SAMPLE).toArrow()["v"], width)  # a bounded sample
    mean = sample.mean(0).round() if len(sample) else np.zeros(width)
    chosen = far_apart(sample - mean, pivots)
    q_blocks, c_blocks = math.ceil(n_asked / QUERY_BLOCK), math.ceil(n / CANDIDATE_BLOCK)
    deal = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            query, own, row, ids = left["row"].to_numpy(), left["vec_id"].to_numpy(), right["row"].to_numpy(), right["vec_id"].to_numpy()
            order = np.argsort(row)
            place = np.minimum(np.searchsorted(row, query, sorter=order), len(row) - 1)
            same = np.where(row[order[place]] == query, order[place], -1)
            floor = left["floor"].to_numpy().astype(np.float64)
            for i, j, score in best(_matrix(left["v"], width), _matrix(right["v"], width), mean, chosen, floor, same, ids, k):
                for column, x in zip(out, (query[i], own[i], ids[j], score), strict=True):
                    column.append(x)
        return pa.table([pa.array(x, pa.int64()) for x in out], ["query", "query_id", "vec_id", "score"])

    def search(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        """queries (row, vec_id, v, floor, cb) against candidates (row, vec_id, v, cb)."""
        a = queries.withColumn("qb", deal(q_blocks)).groupBy("qb", "cb")
        b = candidates.withColumn("qb", each(q_blocks)).groupBy("qb", "cb")
        return a.cogroup(b).applyInArrow(meet, FOUND)

    dealt = rows.select(*(F.col(c).alias(c) for c in rows.columns)).withColumn("cb", deal(c_blocks))
    start = dealt.filter("cb = 0")
    nothing = F.lit(-(1 << 62)).cast("long")
    first = materialize(search(asked.withColumn("floor", nothing).withColumn("cb", F.lit(0)), start), "first")
    if c_blocks > 1:
        floors = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k).select(F.col("query").alias("row"), "floor")
        informed = asked.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", nothing)).withColumn("cb", F.explode(F.sequence(F.lit(1), F.lit(c_blocks - 1))))
        first = first.unionByName(search(informed, dealt.filter("cb > 0")))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def share_evaluated(vectors: np.ndarray, queries: np.ndarray, k: int = 5, pivots: int = PIVOTS) -> float:
    """The share of candidates whose score is worked out if each query (a row number) has a threshold from the first block."""
    mean = vectors[:SAMPLE].mean(0).round()
    chosen, counts = far_apart(vectors[:SAMPLE] - mean, pivots), Evaluated()
    scores = vectors[queries] @ vectors[: CANDIDATE_BLOCK // 8].T
    floor = np.sort(scores, axis=1)[:, -k - 1]  # the own row may be among them
    for _ in best(vectors[queries], vectors, mean, chosen, floor, queries, np.arange(len(vectors)), k, counts):
        pass
    return counts.scored / counts.met
