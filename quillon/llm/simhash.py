"""Operator 9: SimHash near-duplicates with pivot distance tables.

Every distinct fingerprint gets its Hamming distances to PIVOTS reference fingerprints. Two fingerprints within
d bits differ by d at most in each of these. The first few distances, the coordinates, deal the fingerprints over the
cluster: a coordinate is cut into buckets of 2 d + 1, a fingerprint goes to the bucket of x and to that of x + d, so that two
within d bits share the bucket of the one further on in every coordinate, and thus a cell. How many coordinates deal is worked
out from the number of fingerprints. Within a cell, pairs that differ by more than d in any of the other distances are
discarded, the rest are verified by their exact distance. Cells of more than CELL fingerprints are cut into blocks, and pairs of
blocks are dealt, so no task holds more than two blocks; what links in one is handed on as a forest, not as all its pairs.
Copies share a fingerprint and never meet.

keep_one, which deletes, needs links at an exact similarity of SIMILAR on shingle sets. A pair at 0.8 differs in some 15 % of its
bits, so no fingerprint of a fixed length finds it within a few bits, and distances of whole fingerprints to pivots are as much
alike in random pairs. So the fingerprint of a set is long, and pivots deal its parts: PIVOT_BITS bits have a table with the
nearest of 4,096 pivots, which differ from each other by 7 bits or more and leave no word further than 3 bits off; a part goes to
the cell of its nearest pivot, and two texts meet in each cell that they share (their parts differ by 6 bits at most there). The
number of parts is worked out from the chance that a part of a pair at SIMILAR shares its pivot: such a pair is missed with a
probability below MISS, whatever the size of the table; larger tables add bits to the parts, and parts. Within a cell pairs stay
whose first 256 bits differ by FAR at most, and of those that stay only pairs whose exact Jaccard similarity is SIMILAR or more are
links. Where more than SMALL others are close to a text in a cell, not each pair is handed on: what hangs together there is a clump,
and a text is in one clump. The cells of the first LEADERS parts make clumps, at most one leader a cell for each text; then all cells
hand on the close pairs of different clumps, or join clumps where these are many. All of a clump meets its leaders and the least, and
then, block by block, all pairs that these links leave apart and whose minima don't rule SIMILAR out are compared where they meet;
only of sets beyond MOST hashes some pairs are left to a join. Texts of one clump don't meet in cells again, nor those of one class
in a clump: in large groups the commonest clump or class goes to the blocks of the others only.

Shingles are words of the text, ASCII letters in lower case, hashed by XXH64. Further 64-bit words of long
fingerprints come from the same hash, mixed.

Defined results: null text is the empty text; a text without words has fingerprint 0 and links like any other; fewer
words than a shingle are one shingle; rows with one doc_id are one node; rows with a null id get the class of an
equal fingerprint, or null, and link nothing (keep_one keeps them). Columns stay as they are, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import boxed, materialize, partitions, sliced, unboxed, whole_text

SEED = 42
PIVOTS = 16
#: 64-bit fingerprints: links at so many bits or fewer.
DISTANCE = 2
#: Words in a shingle of near copies.
NEAR_SHINGLE = 5
#: Exact similarity of near copies as a fraction.
SIMILAR = (4, 5)
#: Bits of a part that pivots deal, the shift register that makes the 4,096 pivots (Golay's code), and of 2,048 words about a pivot how
#: many stay in its cell when 0 to 6 bits are turned.
PIVOT_BITS, PIVOT_CODE, STAY = 23, 0xC75, (2048, 508, 508, 128, 128, 20, 20)
#: Shingles of a tiny set, how often a bit differs at most in a pair at SIMILAR of other and of tiny sets (4 and 5 shingles are the
#: worst; a test works out both), and the probability that such a pair is missed.
TINY, UNLIKE, MISS = 5, (0.1612, 0.1875), 7.3e-5
#: Of 256 bits and of the first 128 so many differ at most in such pairs (more have a probability below 1e-6).
FAR, HALF_FAR = (72, 80), 47
#: What a part costs a text (its bits, its row), in comparisons of a pair.
PART_COST = 250
#: Minima of a set in large clumps: BANDS times WIDTH.
BANDS, WIDTH = 24, 5
#: Of a text's BANDS * WIDTH minima so many agree at least in a pair at SIMILAR (96 are expected; fewer have a probability below 2e-7).
AGREE = 72
#: Rows close to one in a cell whose pairs are handed on one by one, rows of a block, and pairs that a sweep holds at once.
SMALL, CELL, SWEEP = 8, 4096, 1 << 22
#: Parts whose cells make clumps, and texts that one of a clump is linked to at most, beside the least.
LEADERS = 8
#: Rows of a block of near copies, hashes of a set that it holds, and how far the similarity of two such sketches may be off (six
#: standard errors of a sample of half of them).
BLOCK, MOST, MARGIN = 1024, 2048, 0.075
#: What dealing a row costs, in comparisons of a pair.
ROW_COST = 50
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def more_bits(h: np.ndarray, word: int) -> np.ndarray:
    """The hash of a shingle for the given 64-bit word of the fingerprint; itself for the first."""
    if not word:
        return h
    x = (h + np.uint64(word * 0x9E3779B97F4A7C15 % (1 << 64))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def fingerprint_of(text: str, shingle: int, words64: int = 1) -> list[int]:
    """The 64-bit words of a text's fingerprint."""
    words = text.encode().lower().split()
    if not words:
        return [0] * words64
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), (ends[min(shingle, len(words)) - 1 :] - 1).tolist(), strict=True)
    h = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    out = []
    for word in range(words64):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            part = more_bits(h[at : at + (1 << 16)], word)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]))
    return out


def _names(words64: int) -> list[str]:
    return [f"f{i}" for i in range(words64)]


def fingerprints(docs: DataFrame, shingle: int, words64: int = 1, text: str = "text") -> DataFrame:
    """(doc_id, f0, f1, ...): the bits as signed numbers."""
    names = _names(words64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = np.array([fingerprint_of(t, shingle, words64) for t in b.column(1).to_pylist()], np.uint64).reshape(-1, words64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(fps[:, i].copy().view(np.int64)) for i in range(words64))], ["doc_id", *names])

    return docs.select(docs["doc_id"].cast("long"), whole_text(text).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (rows, 64-bit words) to the reference fingerprints."""
    refs = np.array([[xxhash.xxh64_intdigest(f"{i} {j}".encode(), SEED) for j in range(fps.shape[1])] for i in range(PIVOTS)], np.uint64)
    return np.stack([np.bitwise_count(fps ^ r).sum(1, dtype=np.int16) for r in refs], axis=1)


def survivors(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within distance: those that no pivot discards, verified."""
    for p in range(PIVOTS):
        near = np.abs(table[i, p] - table[j, p]) <= distance
        i, j = i[near], j[near]
    same = np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int16) <= distance
    return i[same], j[same]


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def sweep(fps: np.ndarray, table: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within a large group: each row with the root of its class.

    Rows in the order of the first pivot meet, block by block, the rows up to distance further on.
    """
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    parent = np.arange(len(fps))
    step = max(1, SWEEP // len(fps))
    for at in range(0, len(fps), step):
        stop = min(len(fps), at + step)
        last = int(np.searchsorted(table[:, 0], table[stop - 1, 0] + distance, side="right"))
        i, j = np.meshgrid(np.arange(at, stop), np.arange(at, last), indexing="ij")
        ahead = j > i
        for a, b in zip(*(x.tolist() for x in survivors(fps, table, i[ahead], j[ahead], distance)), strict=True):
            x, y = _root(parent, a), _root(parent, b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    roots = np.array([_root(parent, i) for i in range(len(fps))])
    moved = np.flatnonzero(roots != np.arange(len(fps)))
    return order[moved], order[roots[moved]]


def coordinates(n: int, bits: int, distance: int) -> int:
    """How many pivot distances deal n fingerprints: those at which rows dealt and pairs met cost least."""
    width = 2 * distance + 1
    more, met = 1 + distance / width, min(1.0, width / math.sqrt(math.pi * bits))  # rows for one; chance that two meet
    return min(range(PIVOTS + 1), key=lambda k: n * more**k * (ROW_COST + n / 2 * met**k))


def cells(table: np.ndarray, k: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the cells of each row of pivot distances, by its first k."""
    row, cell, width = np.arange(len(table)), np.zeros(len(table), np.uint64), 2 * distance + 1
    for p in range(k):
        x = table[row, p].astype(np.int64)
        near, far = x // width, (x + distance) // width
        two = np.flatnonzero(near != far)
        row, bucket, cell = np.r_[row, row[two]], np.r_[near, far[two]], np.r_[cell, cell[two]]
        cell = cell * np.uint64(0x9E3779B97F4A7C15) + bucket.astype(np.uint64) + np.uint64(1)
    return row, cell.view(np.int64)


def in_blocks(rows: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """rows with i and j: one pair of blocks for each group of key up to most rows; in larger ones a row is in the block
    that by deals it to and goes to the pairs of that block with all others."""
    big = materialize(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("blocks")), "big")
    rows = rows.join(big, key, "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"), F.lit(0)))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own"))
    rows = rows.withColumn("other", F.explode(F.coalesce(others, F.array(F.lit(0)))))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "own", "other")


def across_blocks(rows: DataFrame, key: str, by: str, same: str, most: int) -> DataFrame:
    """rows with i and j, as in_blocks has them, where two rows meet only if they differ in same, which is never null: in a group of
    more than most rows those of its commonest value go to the blocks of the others, and to no pair of their own."""
    large = materialize(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most), "large")
    top = rows.join(large, key).groupBy(key, "n", same).agg(F.count("*").alias("k")).groupBy(key, "n").agg(F.max(F.struct("k", same)).alias("top"))
    blocks = lambda n: F.ceil(n / most).cast("int")
    big = materialize(top.select(key, F.col("top")[same].alias("common"), blocks(F.col("n") - F.col("top.k")).alias("rest"), blocks(F.col("top.k")).alias("tops")), "big")
    rows, rest, deal = rows.join(big, key, "left"), F.col("rest"), lambda n: F.pmod(F.xxhash64(by), n).cast("int")
    rows = rows.withColumn("own", F.coalesce(F.when(F.col(same) == F.col("common"), rest + deal(F.col("tops"))).when(rest > 0, deal(rest)), F.lit(0)))
    others = F.filter(F.sequence(F.lit(0), rest + F.col("tops") - 1), lambda x: (x != F.col("own")) & ((x < rest) | (F.col("own") < rest)))
    rows = rows.withColumn("other", F.explode(F.coalesce(others, F.array(F.lit(0)))))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("common", "rest", "tops", "own", "other")


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the bounds of the groups, from batches in the order of keys."""

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for k in keys:
            x = t[k].to_numpy()
            new |= x[1:] != x[:-1]
        return np.r_[0, np.flatnonzero(new) + 1]

    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch])
            if held and all(held[-1][k][-1] == t[k][-1] for k in keys):  # one group goes on
                held.append(t)
                continue
            t = pa.concat_tables([*held, t]).combine_chunks()
            bounds = starts(t)
            held = [t.slice(int(bounds[-1]))]
            if len(bounds) > 1:
                yield t.slice(0, int(bounds[-1])), bounds
    if held:
        t = pa.concat_tables(held).combine_chunks()
        yield t, np.r_[starts(t), t.num_rows]


def dealt(distinct: DataFrame, words64: int, distance: int) -> DataFrame:
    """(cell, node, pivots, f0, ...): distinct fingerprints (node, f0, ...) with their row of the pivot table, by their cells."""
    names, k = _names(words64), coordinates(distinct.count(), 64 * words64, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = pivot_table(np.stack([b.column(n).to_numpy().view(np.uint64) for n in names], axis=1))
            row, cell = cells(table, k, distance)
            rows = [x.tobytes() for x in table]
            picked = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(cell), picked.column("node"), pa.array(rows, pa.binary()).take(pa.array(row)), *(picked.column(n) for n in names)], ["cell", "node", "pivots", *names])

    return distinct.select("node", *names).mapInArrow(run, "cell long, node long, pivots binary, " + ", ".join(f"{n} long" for n in names))


def links(distinct: DataFrame, words64: int, distance: int) -> DataFrame:
    """(a, b): edges between the nodes of distinct fingerprints (node, f0, ...), with the connected components of all links."""
    names, keys = _names(words64), ["cell", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in by_group(batches, keys):
            node, sizes = t["node"].to_numpy(), np.diff(bounds)
            fps = np.stack([t[n].to_numpy().view(np.uint64) for n in names], axis=1)
            table = np.frombuffer(b"".join(t["pivots"].to_pylist()), np.int16).reshape(len(node), PIVOTS)
            group, size = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes, sizes)
            a, b = [node[:0]], [node[:0]]
            left = np.flatnonzero((size > 1) & (size <= 64))
            for lag in range(1, 64):
                left = left[(left + lag < len(node)) & (size[left] > lag)]
                if not len(left):
                    break
                i = left[group[left] == group[left + lag]]
                i, j = survivors(fps, table, i, i + lag, distance)
                a.append(node[i])
                b.append(node[j])
            for g in np.flatnonzero(sizes > 64).tolist():
                at, stop = int(bounds[g]), int(bounds[g + 1])
                i, j = sweep(fps[at:stop], table[at:stop], distance)
                a.append(node[at:stop][i])
                b.append(node[at:stop][j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    met = in_blocks(materialize(dealt(distinct, words64, distance), "cells"), "cell", "node", CELL)
    return met.repartition(partitions(distinct.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): nodes of the edges (a, b) with the smallest node of their component.

    Alternating large and small stars; each round is written to the shared folder.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(smallest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(smallest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def classes(docs: DataFrame, shingle: int, bits: int = 64, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, f0, ..., component_id): component_id is the smallest doc_id that links reach, itself included."""
    words64 = bits // 64
    names = _names(words64)
    fps = materialize(fingerprints(docs, shingle, words64), "simhash")
    distinct = materialize(fps.groupBy(*names).agg(F.min("doc_id").alias("node")), "distinct")
    own = distinct.filter("node is not null")
    edges = links(own, words64, distance)
    # rows with one doc_id are one node, whatever their fingerprints
    same_id = fps.filter("doc_id is not null").join(own, names).filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"), *names)
    repeated = fps.filter("doc_id is not null").groupBy("doc_id").agg(F.count_distinct(*names).alias("n")).filter("n > 1").select(F.col("doc_id").alias("a"))
    edges = edges.unionByName(same_id.join(repeated, "a", "left_semi").select("a", "b"))
    named = distinct.join(components(edges), "node", "left").select(*names, F.coalesce("root", "node").alias("component_id"))
    return fps.join(named, names).select("doc_id", *names, "component_id")


def near_duplicates(docs: DataFrame, shingle: int, bits: int = 64, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint as hex digits, component_id) for every document."""
    found = classes(docs, shingle, bits, distance)
    digits = F.concat(*(F.lpad(F.lower(F.hex(n)), 16, "0") for n in reversed(_names(bits // 64))))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; none for a text without words."""
    words = text.encode().lower().split()
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)] if words else [], np.uint64))


_FACTORS = np.array([xxhash.xxh64_intdigest(f"minimum {i}".encode(), SEED) | 1 for i in range(BANDS * WIDTH)], np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of a set's hashes under each factor."""
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(out, (hashes[at : at + (1 << 12), None] * _FACTORS).min(0), out=out)
    return out


def _set_key(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


@cache
def nearest_pivot() -> np.ndarray:
    """For each word of PIVOT_BITS bits the number of the pivot within 3 bits; there is one."""
    pivots = np.zeros(1, np.int32)
    for i in range(12):
        pivots = np.r_[pivots, pivots ^ np.int32(PIVOT_CODE << i)]
    turned = np.array([sum(1 << b for b in bits) for k in range(4) for bits in combinations(range(PIVOT_BITS), k)], np.int32)
    table = np.empty(1 << PIVOT_BITS, np.int16)
    table[pivots[:, None] ^ turned] = np.arange(len(pivots), dtype=np.int16)[:, None]
    return table


def parts(extra: int, unlike: float) -> int:
    """How many parts with so many extra bits find a pair whose bits differ that often."""
    stay = sum(math.comb(PIVOT_BITS, k) * unlike**k * (1 - unlike) ** (PIVOT_BITS - k) * n / STAY[0] for k, n in enumerate(STAY))
    return math.ceil(math.log(MISS) / math.log1p(-stay * (1 - unlike) ** extra))


def extra_bits(n: int) -> int:
    """How many bits a part has beside those that its pivot deals: those at which parts made and pairs met cost least for n texts."""
    return min(range(32), key=lambda e: parts(e, UNLIKE[0]) * (PART_COST + n / 2 / (1 << 12 + e)))


def set_bits(hashes: np.ndarray, words64: int) -> np.ndarray:
    """The fingerprint of a shingle set: a bit is 1 if set in over half of its hashes, mixed anew for each 64-bit word."""
    salts = np.array([(i + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for i in range(words64)], np.uint64)
    ones = np.zeros(64 * words64, np.int64)
    for at in range(0, len(hashes), 255):  # what a byte can count
        x = (hashes[at : at + 255, None] + salts) * _M1
        x = (x ^ (x >> np.uint64(33))) * _M2
        x ^= x >> np.uint64(33)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return 2 * ones > len(hashes)


def part_cells(bits: np.ndarray, count: int, extra: int) -> np.ndarray:
    """The cells of the first parts of a fingerprint: the part's number, its extra bits, its nearest pivot."""
    width = PIVOT_BITS + extra
    words = bits[: count * width].reshape(count, width) @ (1 << np.arange(width))
    near = nearest_pivot()[words & (1 << PIVOT_BITS) - 1]
    return np.arange(count) << 12 + extra | words >> PIVOT_BITS << 12 | near


def sketches(docs: DataFrame, shingle: int, extra: int) -> DataFrame:
    """(doc_id, text_key, v, size, cells, f0, ..., f3): the hash of the text, the key of the shingle set, its size, the cells of its
    fingerprint's parts and the first 256 bits."""
    names, counts = _names(4), [parts(extra, x) for x in UNLIKE]
    words64 = [max(4, -(-n * (PIVOT_BITS + extra) // 64)) for n in counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            v, sizes, cells, first = [], [], [], []
            for text in b.column(1).to_pylist():
                hashes = shingle_set(text, shingle)
                tiny = len(hashes) <= TINY
                bits = set_bits(hashes, words64[tiny])
                v.append(_set_key(hashes))
                sizes.append(len(hashes))
                cells.append(part_cells(bits, counts[tiny], extra))
                first.append(np.packbits(bits[:256], bitorder="little").view(np.int64))
            fps = np.array(first, np.int64).reshape(-1, 4)
            columns = [b.column(0), b.column(2), pa.array(v, pa.int64()), pa.array(sizes, pa.int32()), pa.array(cells, pa.list_(pa.int64())), *(pa.array(fps[:, i].copy()) for i in range(4))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "v", "size", "cells", *names])

    text = whole_text()
    rows = docs.select(docs["doc_id"].cast("long"), text.alias("text"), F.md5(text).alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key string, v long, size int, cells array<long>, " + ", ".join(f"{n} long" for n in names))


def shingle_sets(docs: DataFrame, distinct: DataFrame, needed: DataFrame, shingle: int, most: int | None = None) -> DataFrame:
    """(v, hashes) of the needed (v): the sorted shingle sets; with most the least hashes of larger ones, whether these are all (whole),
    and a byte of each minimum (mins)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [shingle_set(t, shingle) for t in b.column(1).to_pylist()]
            columns = {"v": pa.array([_set_key(x) for x in sets], pa.int64()), "hashes": pa.array([x[:most].view(np.int64) for x in sets], pa.list_(pa.int64()))}
            if most is not None:
                least = [minima(x) for x in sets]
                columns |= {"whole": pa.array([len(x) <= most for x in sets]), "mins": pa.array([(x >> np.uint64(56) ^ x & np.uint64(255)).astype(np.uint8).tobytes() for x in least], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    nodes = distinct.join(needed.select("v").distinct(), "v", "left_semi").select("node.doc_id").distinct()
    texts = docs.select(docs["doc_id"].cast("long"), whole_text().alias("text")).join(nodes, "doc_id", "left_semi")
    more = [] if most is None else ["whole", "mins"]
    found = texts.mapInArrow(run, "v long, hashes array<long>" + (", whole boolean, mins binary" if more else ""))
    return materialize(found.groupBy("v").agg(*(F.first(c).alias(c) for c in ["hashes", *more])), "sets")


def similar(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of distinct shingle sets (v, node) with an exact Jaccard similarity of SIMILAR or more."""
    sets = shingle_sets(docs, distinct, pairs.select(F.explode(F.array("a", "b")).alias("v")), shingle)
    both = pairs.join(sets.select(F.col("v").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("v").alias("b"), F.col("hashes").alias("y")), "b")
    n = F.size(F.array_intersect("x", "y"))
    return both.filter(SIMILAR[1] * n >= SIMILAR[0] * (F.size("x") + F.size("y") - n)).select("a", "b")


def verdict(x: np.ndarray, y: np.ndarray, whole: bool) -> int:
    """Of two sorted sets 1 if they are similar, 0 if not. Of sketches, the least hashes of sets, 0 or -1 if the sets have to be
    asked: below the smaller sketch's last hash they hold an even sample of both sets, of MOST / 2 hashes or more."""
    if not whole:
        top = min(x[-1], y[-1])
        x, y = x[: np.searchsorted(x, top, "right")], y[: np.searchsorted(y, top, "right")]
    n = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - n
    if whole:
        return int(SIMILAR[1] * n >= SIMILAR[0] * union)
    return -int(n / union >= SIMILAR[0] / SIMILAR[1] - MARGIN)


def apart(v: np.ndarray, root: np.ndarray, mins: np.ndarray, sets: list[np.ndarray], whole: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """(a, b, sure) of a group: pairs in different classes that are similar, or may be. Pairs of one class, also of one that a pair
    found here makes, aren't looked at."""
    _, name, count = np.unique(root, return_inverse=True, return_counts=True)
    order = np.lexsort((name, count[name]))  # small classes first: each row meets those behind it
    parent, sizes = np.arange(len(count)), np.array([len(x) for x in sets])
    for at, i in enumerate(order.tolist()):
        j = order[at + 1 :]
        j = j[name[j] != name[i]]
        j = j[(mins[j] == mins[i]).sum(1) >= AGREE]
        either = ~(whole[j] & whole[i])
        j = j[either | (SIMILAR[1] * np.minimum(sizes[j], sizes[i]) >= SIMILAR[0] * np.maximum(sizes[j], sizes[i]))]
        for k in j.tolist():
            a, b = _root(parent, name[i]), _root(parent, name[k])
            if a != b and (found := verdict(sets[i], sets[k], bool(whole[i] and whole[k]))):
                yield min(v[i], v[k]), max(v[i], v[k]), found > 0
                if found > 0:
                    parent[max(a, b)] = min(a, b)


def close(group: np.ndarray, size: np.ndarray, words: list[np.ndarray], clump: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows in one group (rows come by groups), and in different clumps, whose 256 bits differ by FAR at most and whose sizes
    allow SIMILAR."""
    rows, lag, out = np.arange(len(group)), 0, ([np.arange(0)], [np.arange(0)])
    _, index, count = np.unique(group, return_inverse=True, return_counts=True)
    more = count[index]
    while True:
        if lag % 32 == 0:  # whole groups that have no such lag are left out from time to time
            rows = rows[more[rows] > lag + 1]
            g, (w0, w1) = group[rows], (w[rows] for w in words[:2])
            c = None if clump is None else clump[rows]
        lag += 1
        same = g[lag:] == g[:-lag]
        if not same.any():
            return np.concatenate(out[0]), np.concatenate(out[1])
        if c is not None:
            same &= c[lag:] != c[:-lag]
        same &= np.bitwise_count(w0[lag:] ^ w0[:-lag]) + np.bitwise_count(w1[lag:] ^ w1[:-lag]) <= HALF_FAR
        at = np.flatnonzero(same)
        i, j = rows[at], rows[at + lag]
        least, largest = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        far = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int16) for w in words)
        near = (far <= np.where(largest <= TINY, FAR[1], FAR[0])) & (SIMILAR[1] * least >= SIMILAR[0] * largest)
        out[0].append(i[near])
        out[1].append(j[near])


def clumps(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Of n rows with edges (i, j) the least row that each hangs together with."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root


def candidates(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of sets by the cells of their parts: pairs (a, b) of close ones, and of the leaders of clumps with others; and (v, clump) of what
    is in clumps, of which the pairs within one clump aren't all handed on."""
    names, order = _names(4), ["cell", "i", "j"]

    def by_cells(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions(distinct.sparkSession), *order).sortWithinPartitions(*order)

    def crowded(t: pa.Table, bounds: np.ndarray, clump: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = close(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), t["size"].to_numpy(), [t[n].to_numpy().view(np.uint64) for n in names], clump)
        heavy = np.bincount(i, minlength=t.num_rows) + np.bincount(j, minlength=t.num_rows) > SMALL
        return i, j, heavy[i] | heavy[j]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in by_group(batches, order):
            v, (i, j, large) = t["v"].to_numpy(), crowded(t, bounds)
            root = clumps(i[large], j[large], len(v))
            led = np.flatnonzero(root != np.arange(len(v)))
            yield pa.RecordBatch.from_arrays([pa.array(v[root[led]]), pa.array(v[led])], ["a", "b"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in by_group(batches, order):
            v, clump = t["v"].to_numpy(), t["clump"].to_numpy()
            i, j, large = crowded(t, bounds, clump)
            own, index = np.unique(np.r_[clump[i[large]], clump[j[large]]], return_inverse=True)
            root = clumps(*np.split(index, 2), len(own))
            led = np.flatnonzero(root != np.arange(len(own)))
            i, j = i[~large], j[~large]
            columns = [np.r_[np.minimum(v[i], v[j]), own[root[led]]], np.r_[np.maximum(v[i], v[j]), own[led]], np.r_[np.ones(len(i), bool), np.zeros(len(led), bool)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "pair"])

    rows = distinct.select(F.explode(F.slice("cells", 1, LEADERS)).alias("cell"), "v", "size", *names)
    big = materialize(rows.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > CELL), "big")
    block = F.pmod(F.xxhash64("cell", "v"), F.ceil(F.col("n") / CELL)).cast("int")  # others than those of one block meet in another cell, or below
    rows = rows.join(big, "cell", "left").withColumn("i", F.coalesce(block, F.lit(0))).withColumn("j", F.col("i")).drop("n")
    led = materialize(by_cells(rows).mapInArrow(first, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "led")

    clump = distinct.join(components(led).withColumnRenamed("node", "v"), "v", "left").withColumn("clump", F.coalesce("root", "v"))
    rows = clump.select(F.explode("cells").alias("cell"), "v", "size", *names, "clump")
    found = materialize(by_cells(across_blocks(rows, "cell", "v", "clump", CELL)).mapInArrow(across, "a long, b long, pair boolean"), "close")

    held = components(led.unionByName(found.filter("not pair").select("a", "b"))).select(F.col("node").alias("v"), F.col("root").alias("clump"))
    held = materialize(held.unionByName(held.select(F.col("clump").alias("v"), "clump").distinct()), "clumps")
    pairs = found.filter("pair").select("a", "b").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(held.select(F.col("v").alias(end), F.col("clump").alias(f"clump_{end}")), end, "left")
    pairs = pairs.filter(F.coalesce(F.col("clump_a") != F.col("clump_b"), F.lit(True))).select("a", "b")
    least = held.filter("v <> clump").select(F.col("clump").alias("a"), F.col("v").alias("b"))
    return pairs.unionByName(led.unionByName(least).distinct()), held


def left_apart(docs: DataFrame, distinct: DataFrame, large: DataFrame, roots: DataFrame, shingle: int) -> DataFrame:
    """(a, b, sure): what pairs of sets in one clump, which different classes hold, add to the links: enough of them to join
    the classes. Blocks of a clump hold the sets themselves, or sketches of large ones."""
    rows = large.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    several = rows.groupBy("clump").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("clump")
    rows = materialize(rows.join(several, "clump", "left_semi"), "apart")
    rows = rows.join(shingle_sets(docs, distinct, rows, shingle, MOST), "v")
    order = ["clump", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in by_group(batches, order):
            for at, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                g = t.slice(at, stop - at)
                if stop - at < 2:
                    continue
                mins = np.frombuffer(b"".join(g["mins"].to_pylist()), np.uint8).reshape(stop - at, BANDS * WIDTH)
                lists = [x.view(np.uint64) for x in g["hashes"].to_numpy()]
                found = list(apart(g["v"].to_numpy(), g["root"].to_numpy(), mins, lists, g["whole"].to_numpy()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "sure"])

    met = across_blocks(rows, "clump", "v", "root", BLOCK).repartition(partitions(large.sparkSession), *order).sortWithinPartitions(*order)
    return met.mapInArrow(run, "a long, b long, sure boolean")


def copies(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_key): of each class of texts that exact similarities of SIMILAR or more link, the smallest."""
    docs = docs.filter(docs["doc_id"].isNotNull())
    extra = extra_bits(docs.count())
    found = materialize(sketches(docs, shingle, extra), "sketches")
    distinct = found.groupBy("v").agg(F.min(F.struct("doc_id", "text_key")).alias("node"), *(F.first(c).alias(c) for c in ("size", "cells", *_names(4))))
    distinct = materialize(distinct, "distinct")
    pairs, large = candidates(distinct)
    edges = materialize(similar(docs, distinct, materialize(pairs, "pairs"), shingle), "links")
    roots = components(edges).withColumnRenamed("node", "v")
    rest = materialize(left_apart(docs, distinct, large, roots, shingle), "rest")
    if not rest.isEmpty():
        asked = similar(docs, distinct, rest.filter("not sure").select("a", "b").distinct(), shingle)
        roots = components(edges.unionByName(rest.filter("sure").select("a", "b")).unionByName(asked)).withColumnRenamed("node", "v")
    return distinct.join(roots, "v", "left").groupBy(F.coalesce("root", "v").alias("root")).agg(F.min("node").alias("node")).select("node.*")


def keep_one(docs: DataFrame, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """docs without near copies: of each class the row with the smallest doc_id stays (then with the smallest hash of the
    text; of rows that repeat both, one); rows without an id stay."""
    found = copies(docs, shingle)
    rows = boxed(docs, "doc_id", "text").withColumn("text_key", F.md5(whole_text()))
    kept = rows.join(found, ["doc_id", "text_key"], "left_semi").withColumn("again", F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy(F.lit(0))))
    return unboxed(kept.filter("again = 1").select("row").unionByName(rows.filter("doc_id is null").select("row")), docs.columns, {})
