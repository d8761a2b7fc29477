"""Operator 1: quartile bucket digests of documents.

Every window of five bytes gives six hashed byte triplets. They are counted in BUCKETS buckets, each
bucket is coded by the quartile of its count (two bits), and a header holds the length class and the
ratios of the quartiles. Two digests are compared by a difference score with an upper bound.

Defined results: null text is the empty text; an empty text has no triplets, its digest is all zero;
equal texts have equal digests whatever their ids; texts of one to four bytes are padded with zero
bytes to one window. Rows that repeat a doc_id follow each other in the order of a hash of their texts, null
ids come last. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import partitions, sliced, whole_text

BUCKETS = 512
#: Offsets of the second and third byte of the triplets within a window of five bytes.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: A bucket whose codes are lowest in one digest and highest in the other counts this much.
FAR = 6
LENGTH_BASE = 1.1


def _tables() -> np.ndarray:
    rng = np.random.default_rng(20240601)
    return rng.integers(0, BUCKETS, size=(len(TRIPLETS), 3, 256)).astype(np.uint16)


_T = _tables()


def triplet_counts(data: bytes) -> np.ndarray:
    if 0 < len(data) < 5:
        data = data.ljust(5, b"\0")
    b = np.frombuffer(data, np.uint8)
    n = len(b) - 4
    if n <= 0:
        return np.zeros(BUCKETS, np.int64)
    counts = np.zeros(BUCKETS, np.int64)
    for (i, j), (first, second, third) in zip(TRIPLETS, _T, strict=True):
        counts += np.bincount(first[b[:n]] ^ second[b[i : i + n]] ^ third[b[j : j + n]], minlength=BUCKETS)
    return counts


def digest(data: bytes) -> str:
    """Hex digest: one byte of length class, one byte of quartile ratios, two bits for each bucket."""
    if not data:
        return "00" * (2 + BUCKETS // 4)
    counts = triplet_counts(data)
    q1, q2, q3 = np.partition(counts, [k := BUCKETS // 4 - 1, 2 * k + 1, 3 * k + 2])[[k, 2 * k + 1, 3 * k + 2]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    length = 1 + min(254, int(math.log(len(data)) / math.log(LENGTH_BASE)))
    ratios = (int(16 * q1 / (q3 + 1)) << 4 | int(16 * q2 / (q3 + 1))) if q3 else 0
    return bytes([length, ratios]).hex() + body.astype(np.uint8).tobytes().hex()


def _distance_table() -> np.ndarray:
    """Difference of two body bytes: four codes each."""
    codes = (np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3
    gap = np.abs(codes[:, None, :] - codes[None, :, :])
    return np.where(gap == 3, FAR, gap).sum(-1).astype(np.int64)


_GAP = _distance_table()
#: What two digests with independent, evenly spread codes differ by on average: the bound of the score.
BOUND = BUCKETS * sum(FAR if abs(a - b) == 3 else abs(a - b) for a in range(4) for b in range(4)) / 16


def difference(x: str, y: str) -> float:
    """0 for equal digests, BOUND at most."""
    a, b = np.frombuffer(bytes.fromhex(x), np.uint8), np.frombuffer(bytes.fromhex(y), np.uint8)
    lengths = abs(int(a[0]) - int(b[0]))
    ratios = abs((int(a[1]) >> 4) - (int(b[1]) >> 4)) + abs((int(a[1]) & 15) - (int(b[1]) & 15))
    return min(BOUND, float(_GAP[a[2:], b[2:]].sum() + lengths + ratios))


def likeness(x: str, y: str) -> float:
    return 1.0 - difference(x, y) / BOUND


def fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs with the digest of every whole text."""

    @F.pandas_udf("string")
    def digests(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: digest(t.encode()))

    return docs.withColumn(into, digests(whole_text(text)))


def in_id_order(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, echo, id, text) dealt over the cluster in ranges of (id, hash of the text, place in the input) and sorted in each; the
    first row of each range is there once more as the last (echo 1) of the range before it, the very first one in the last range.

    So every task sees each of its rows with the row that follows it, and neither an id nor a text that many rows
    share is one task's. Only the keys of range starts, one for each partition, pass through the driver.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text).alias("text"), F.xxhash64(whole_text(text)).alias("h"), F.monotonically_increasing_id().alias("m"))
    order = (F.col("id").asc_nulls_last(), F.col("h"), F.col("m"))
    ranged = rows.select("id", "h", "m").repartitionByRange(partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id())
    firsts = ranged.groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "m")).alias("k")).select("k.*").collect()
    starts = sorted((r.none, r.id or 0, r.h, r.m) for r in firsts)

    @F.pandas_udf("array<int>")
    def places(none: pd.Series, ids: pd.Series, h: pd.Series, m: pd.Series) -> pd.Series:
        keys = zip(none.tolist(), ids.tolist(), h.tolist(), m.tolist(), strict=True)
        parts = [(bisect_right(starts, k) - 1, k) for k in keys]
        return pd.Series([[p, (p - 1) % len(starts)] if starts[p] == k else [p] for p, k in parts], dtype=object)

    dealt = rows.select("*", F.posexplode(places(F.col("id").isNull(), F.coalesce("id", F.lit(0).cast("long")), "h", "m")).alias("echo", "part"))
    dealt = dealt.repartitionById(max(1, len(starts)), F.col("part")).sortWithinPartitions("part", "echo", *order)
    return dealt.select("part", "echo", "id", "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: A range ends with a copy of the next one's first row; where that is missing, its last document would be lost.
CHANGED = "the documents came in another order the second time: write them to a table first"


def edits(docs: DataFrame) -> DataFrame:
    """Each document's digest against that of its edited text and that of the next document (see RESULT). Rows that are equal in id
    and text are told apart by their place, so docs must give its rows alike each time, as files and tables do; if not, this fails."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def one(doc_id, text, own, following, next_digest) -> tuple:
        half = len(text) // 2
        edited = (text[: len(text) - half] + following[:half]).encode()
        changed = digest(edited)
        return doc_id, len(text), hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in sliced(batches, 3):
            out = []
            for part, echo, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = digest(text.encode())
                if held is not None:
                    if held[0] != part:
                        raise RuntimeError(CHANGED)
                    out.append(one(*held[1:], text, own))
                held = None if echo else (part, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if held is not None:
            raise RuntimeError(CHANGED)

    return in_id_order(docs).mapInArrow(run, RESULT)
