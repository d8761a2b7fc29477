"""Operator 4: language-model scoring with a log-frequency Bloom filter.

Words. Tasks turn words into 64-bit ids and count them slice by slice; one shuffle brings the ids of a bucket
together, with exact counts. Words that make up at least one in FREQUENT of all training tokens, FREQUENT at most for
that reason, are broadcast; every other word is met in its bucket. The number of buckets follows the size of
the texts, so that a bucket has a bounded number of tokens however large the input is.

Filter. Pairs (history, word) go to the bucket of the word if it isn't frequent, else to that of the pair's hash. A
pair's count c becomes the level 1 + floor(log_BASE(c)), and the pair enters its bucket's segment of the Bloom
filter once for each level up to its own. A reader probes level after level until one is missing; the levels found give
the count back, exactly up to 4 and its lower end beyond. Segments aren't broadcast whole, as they grow with the corpus:
the probes of all documents are dealt to the segments, one pass over the documents in all, and their sums go back.
Pairs that make up one in FREQUENT of all pairs are broadcast with their levels, so no key is hot.

Score. With p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) and f(u) the number of distinct words after u,
    p(w | u) = (max(c(uw) - DISCOUNT, 0) + DISCOUNT f(u) p(w)) / c(u)    for a frequent u,
    p(w | u) = (c(uw) + STRENGTH p(w)) / (c(u) + STRENGTH)               for another.
c(w), c(u) and f(u) are exact; c(uw) comes from the filter and is never above the count but for a false positive, so that
the probabilities of a history sum to one or a little less. DISCOUNT and STRENGTH were chosen on training rows only
(remainder 2 scored by a model of remainders 0, 3 and 4).

Defined results: null or empty text is one end token; without training documents N = V = 0; repeated rows
are scored each; a null doc_id is a training row (its remainder is unknown, not 1). Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, partitions, sliced, whole_text

FREQUENT = 1 << 21
KEY_BITS, HASHES = 10, 5
BASE = 1.5
DISCOUNT, STRENGTH = 0.75, 10.0
#: Bytes of text for which there is one bucket, and bytes that a worker takes up at once.
BUCKET_BYTES, SLICE_BYTES = 6 << 20, 2 << 20
#: Above the level of any 64-bit count.
MOST_LEVELS = 200
FOLDS, HELD_OUT = 5, 1
END = xxhash.xxh3_64_intdigest(b"\n end")
_GOLD, _MIX, _LEVEL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id: str = "doc_id", folds: int = FOLDS, remainder: int = HELD_OUT):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == remainder, F.lit(False))


class Tokens(NamedTuple):
    """ids: distinct words, the end token last; at: the place in ids of each token; first: of the token before it, the
    end token at a text's start; lengths: tokens of each text."""

    ids: np.ndarray
    at: np.ndarray
    first: np.ndarray
    lengths: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, doc = words.flatten(), pc.list_parent_indices(words).to_numpy().astype(np.int64)
    real = pc.binary_length(flat).to_numpy() > 0
    coded, doc = flat.filter(pa.array(real)).dictionary_encode(), doc[real]
    ids = np.array([*map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), END], np.uint64)
    at = np.full(len(doc) + len(texts), len(ids) - 1, np.int64)
    at[np.arange(len(doc)) + doc] = coded.indices.to_numpy()
    lengths = np.bincount(doc, minlength=len(texts)) + 1
    first = np.empty_like(at)
    first[1:], first[np.cumsum(lengths) - lengths] = at[:-1], len(ids) - 1
    return Tokens(ids, at, first, lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * _GOLD + (second ^ (second >> np.uint64(32))))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)


def counted(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct ids, the sums of their counts, and a place where each is."""
    order = np.argsort(ids, kind="stable")
    ids, counts = ids[order], counts[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.array([], np.int64)
    return ids[starts], np.add.reduceat(counts, starts) if len(ids) else counts, order[starts]


def levels(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9), 0).astype(np.int64)


def lower_end(level: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(level > 0, np.ceil(BASE ** np.maximum(0, level - 1.0) - 1e-9), 0.0)


def positions(h: np.ndarray, level: int, size: int) -> list[np.ndarray]:
    x = mixed(h + np.uint64(level * int(_LEVEL) % (1 << 64)))
    step = mixed(x ^ _GOLD) | np.uint64(1)
    return [(((x + np.uint64(i) * step) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) for i in range(HASHES)]


def segment(h: np.ndarray, counts: np.ndarray) -> bytes:
    """A bucket's part of the filter, KEY_BITS bits an entry."""
    level = levels(counts)
    size = 8 * (int(level.sum()) * KEY_BITS // 8 + 1)
    bits = np.zeros(size // 8, np.uint8)
    for j in range(1, int(level.max(initial=0)) + 1):
        for at in positions(h[level >= j], j, size):
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return bits.tobytes()


def probed(segment: bytes | None, h: np.ndarray) -> np.ndarray:
    """Levels that a segment holds for hashes."""
    found = np.zeros(len(h), np.int64)
    if not segment:
        return found
    bits, left, j = np.frombuffer(segment, np.uint8), np.arange(len(h)), 0
    while len(left) and j < MOST_LEVELS:
        j += 1
        hits = np.ones(len(left), bool)
        for at in positions(h[left], j, 8 * len(bits)):
            hits &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        left = left[hits]
        found[left] = j
    return found


class Top(NamedTuple):
    """The frequent words: ids in order with their codes; by code (0 is the most frequent) ids, counts and numbers of
    followers; frequent pairs (code of the history << 32 | code of the word) in order, with their levels."""

    sorted_ids: np.ndarray
    sorted_codes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    followers: np.ndarray
    pairs: np.ndarray
    pair_levels: np.ndarray

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Codes of words; -1 for those that aren't frequent."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        place = np.minimum(np.searchsorted(self.sorted_ids, ids), len(self.ids) - 1)
        return np.where(self.sorted_ids[place] == ids, self.sorted_codes[place], -1)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, bytes of its part of each column) for the buckets that are there; order is kept within each."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    bounds = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)] if len(bucket) else np.array([0])
    columns = [c[order] for c in columns]
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield int(bucket[i]), *(c[i:j].tobytes() for c in columns)


def _read(blobs: list, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in blobs if x), kind)


def bucket_count(*texts: DataFrame) -> int:
    """One bucket for BUCKET_BYTES of the largest of the tables (text)."""
    sizes = [t.agg(F.coalesce(F.sum(F.octet_length(whole_text()).cast("long") + 8), F.lit(0))).first()[0] for t in texts]
    return max(partitions(texts[0].sparkSession), -(-max(sizes) // BUCKET_BYTES))


def word_counts(train: DataFrame, buckets: int) -> DataFrame:
    """(bucket, ids, counts, n_distinct, n_total): the exact counts of all training tokens."""
    dealt = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())])
    out = pa.schema([*dealt, ("n_distinct", pa.int64()), ("n_total", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0, SLICE_BYTES):
            t = tokens(batch.column(0))
            n = np.bincount(t.at, minlength=len(t.ids)).astype(np.uint32)
            yield _table(list(_dealt(bucket_of(t.ids, buckets), t.ids, n)), dealt)

    def merge(group: pa.Table) -> pa.Table:
        ids, counts, _ = counted(_read(group["ids"].to_pylist(), np.uint64), _read(group["counts"].to_pylist(), np.uint32).astype(np.int64))
        return pa.Table.from_batches([_table([(group["bucket"][0].as_py(), ids.tobytes(), counts.tobytes(), len(ids), int(counts.sum()))], out)])

    counts = train.select(whole_text().alias("text")).mapInArrow(count, "bucket int, ids binary, counts binary")
    return counts.groupBy("bucket").applyInArrow(merge, "bucket int, ids binary, counts binary, n_distinct long, n_total long")


def frequent_words(words: DataFrame, least: int) -> Top:
    """Words with a count of at least least, which is N / FREQUENT or more: FREQUENT rows at most."""
    schema = pa.schema([("id", pa.int64()), ("c", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, counts = _read(b.column(0).to_pylist(), np.int64), _read(b.column(1).to_pylist(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[counts >= least]), pa.array(counts[counts >= least])], schema=schema)

    found = words.select("ids", "counts").mapInArrow(rows, "id long, c long").toArrow()
    ids, counts = found["id"].to_numpy().view(np.uint64), found["c"].to_numpy()
    order = np.lexsort((ids, -counts))
    ids, counts = ids[order], counts[order]
    by_id = np.argsort(ids)
    none = np.array([], np.int64)
    return Top(ids[by_id], by_id, ids, counts, none, none, none)


def pair_buckets(t: Tokens, codes: np.ndarray, first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    """Where pairs (places in t.ids) belong: with their word if it isn't frequent, else by their hash."""
    return np.where(codes[second] < 0, bucket_of(t.ids[second], buckets), bucket_of(pair_hash(t.ids[first], t.ids[second]), buckets))


PAIRS = "bucket int, u binary, w binary, n binary, u_id binary, w_id binary, n_id binary"


def pair_segments(train: DataFrame, top, least: int, buckets: int) -> DataFrame:
    """(bucket, segment, pairs, pair_levels, u, followers): the bucket's part of the filter, its frequent pairs, and how
    many of its distinct pairs each frequent history has."""
    dealt = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("u", "w", "n", "u_id", "w_id", "n_id"))])
    out = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("segment", "pairs", "pair_levels", "u", "followers"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = top.value
        for batch in sliced(batches, 0, SLICE_BYTES):
            t = tokens(batch.column(0))
            codes = frequent.codes(t.ids)
            key, n = np.unique(t.first * len(t.ids) + t.at, return_counts=True)
            u, w, n = key // len(t.ids), key % len(t.ids), n.astype(np.uint32)
            bucket, both = pair_buckets(t, codes, u, w, buckets), (codes[u] >= 0) & (codes[w] >= 0)
            other = ~both
            rows = [(b, *x, None, None, None) for b, *x in _dealt(bucket[both], codes[u[both]].astype(np.int32), codes[w[both]].astype(np.int32), n[both])]
            rows += [(b, None, None, None, *x) for b, *x in _dealt(bucket[other], t.ids[u[other]], t.ids[w[other]], n[other])]
            yield _table(rows, dealt)

    def merge(group: pa.Table) -> pa.Table:
        frequent = top.value
        u, w = (_read(group[c].to_pylist(), np.int32).astype(np.int64) for c in ("u", "w"))
        u_id = np.concatenate([frequent.ids[u], _read(group["u_id"].to_pylist(), np.uint64)])
        w_id = np.concatenate([frequent.ids[w], _read(group["w_id"].to_pylist(), np.uint64)])
        n = np.concatenate([_read(group[c].to_pylist(), np.uint32) for c in ("n", "n_id")]).astype(np.int64)
        h, n, place = counted(pair_hash(u_id, w_id), n)
        history = frequent.codes(u_id[place])
        often = np.flatnonzero(n >= least)
        pairs = history[often] << 32 | frequent.codes(w_id[place[often]])
        code, followers = np.unique(history[history >= 0], return_counts=True)
        row = (group["bucket"][0].as_py(), segment(h, n), pairs.tobytes(), levels(n[often]).tobytes(), code.astype(np.int64).tobytes(), followers.astype(np.int64).tobytes())
        return pa.Table.from_batches([_table([row], out)])

    counts = train.select(whole_text().alias("text")).mapInArrow(count, PAIRS)
    return counts.groupBy("bucket").applyInArrow(merge, "bucket int, segment binary, pairs binary, pair_levels binary, u binary, followers binary")


def _numbers(table: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of two columns of packed 64-bit numbers, one row each."""
    schema = pa.schema([(key, pa.int64()), (value, pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_read(b.column(i).to_pylist(), np.int64)) for i in range(2)], schema=schema)

    return table.select(key, value).mapInArrow(rows, f"{key} long, {value} long")


class Model(NamedTuple):
    """buckets (bucket, ids, counts, segment), what is broadcast, N, and N + 0.5 (V + 1)."""

    buckets: DataFrame
    n_buckets: int
    top: object
    n_train: int
    below: float


def learn(train: DataFrame, n_buckets: int, frequent: int = FREQUENT) -> Model:
    """The model of the texts of train (text)."""
    context = train.sparkSession.sparkContext
    words = materialize(word_counts(train, n_buckets), "lm-words")
    v, n = words.agg(F.coalesce(F.sum("n_distinct"), F.lit(0)), F.coalesce(F.sum("n_total"), F.lit(0))).first()
    least = max(1, -(-n // frequent))
    known = frequent_words(words, least)
    pairs = materialize(pair_segments(train, context.broadcast(known), least, n_buckets), "lm-pairs")
    followers = np.zeros(len(known.ids), np.int64)
    found = _numbers(pairs, "u", "followers").groupBy("u").agg(F.sum("followers").alias("n")).toArrow()
    followers[found["u"].to_numpy()] = found["n"].to_numpy()
    often = _numbers(pairs, "pairs", "pair_levels").toArrow()
    order = np.argsort(often["pairs"].to_numpy())
    top = context.broadcast(known._replace(followers=followers, pairs=often["pairs"].to_numpy()[order], pair_levels=often["pair_levels"].to_numpy()[order]))
    both = words.select("bucket", "ids", "counts").join(pairs.select("bucket", "segment"), "bucket", "full")
    return Model(both, n_buckets, top, n, n + 0.5 * (v + 1))


#: Rows on their way to a bucket and back. Of texts (bucket of any kind): uids, lengths, known, logs, score. Probes: codes or ids
#: of pairs, and refs, the texts' places in their slice. Answers: sums by ref.
_PROBE = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), *((c, pa.binary()) for c in ("uids", "lengths", "known", "logs", "score", "u", "w", "refs", "u_id", "w_id", "refs_id"))])
_ANSWER = pa.schema([("slice", pa.int64()), *((c, pa.binary()) for c in ("uids", "lengths", "refs", "known", "logs", "score"))])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def smoothed(level: np.ndarray, discounted: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Logarithms of the numerators: the count of a level, less DISCOUNT where it applies, and the rest."""
    return np.log10(np.maximum(lower_end(level) - np.where(discounted, DISCOUNT, 0.0), 0.0) + rest)


def probes(docs: DataFrame, model: Model) -> DataFrame:
    """What texts know by themselves, and probes to the buckets for the rest."""
    top, n_buckets, below = model.top, model.n_buckets, model.below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = top.value
        p_word = (known.counts + 0.5) / below
        word_logs, history_logs = np.log10(known.counts + 0.5), -np.log10(np.maximum(known.counts, 1))
        for batch in sliced(batches, 1, SLICE_BYTES):
            uids, t = batch.column(0).to_numpy(), tokens(batch.column(1))
            codes, starts = known.codes(t.ids), np.cumsum(t.lengths) - t.lengths
            u, w = codes[t.first], codes[t.at]
            sure = w >= 0
            logs = np.add.reduceat(np.where(sure, word_logs[w], 0.0) if len(known.ids) else np.zeros(len(w)), starts)
            scores = np.where(sure, history_logs[w], 0.0) if len(known.ids) else np.zeros(len(w))
            both = np.flatnonzero(sure & (u >= 0))
            pair = u[both] << 32 | w[both]
            if len(known.pairs):
                place = np.minimum(np.searchsorted(known.pairs, pair), len(known.pairs) - 1)
                hit = known.pairs[place] == pair
                at = both[hit]
                scores[at] += smoothed(known.pair_levels[place[hit]], True, DISCOUNT * known.followers[u[at]] * p_word[w[at]])
                both = both[~hit]
            refs = np.repeat(np.arange(len(uids), dtype=np.uint32), t.lengths)
            bucket = pair_buckets(t, codes, t.first, t.at, n_buckets)
            other = np.flatnonzero(~sure | (u < 0))
            slice_id = int(uids[0])
            own = (uids.tobytes(), t.lengths.astype(np.int64).tobytes(), np.add.reduceat(sure.astype(np.int64), starts).tobytes(), logs.tobytes(), np.add.reduceat(scores, starts).tobytes())
            rows = [(slice_id % n_buckets, slice_id, *own, *[None] * 6)]
            rows += [(b, slice_id, *[None] * 5, *x, None, None, None) for b, *x in _dealt(bucket[both], u[both].astype(np.int32), w[both].astype(np.int32), refs[both])]
            rows += [(b, slice_id, *[None] * 8, *x) for b, *x in _dealt(bucket[other], t.ids[t.first[other]], t.ids[t.at[other]], refs[other])]
            yield _table(rows, _PROBE)

    return docs.select("uid", whole_text().alias("text")).mapInArrow(run, _ddl(_PROBE))


def answers(asked: DataFrame, model: Model) -> DataFrame:
    """Probes met by their buckets: sums by slice and ref; what texts know by themselves goes along."""
    top, below = model.top, model.below

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        known = top.value
        part = {c: right[c][0].as_py() if right.num_rows else None for c in ("ids", "counts", "segment")}
        own_ids, own_counts = np.frombuffer(part["ids"] or b"", np.uint64), np.frombuffer(part["counts"] or b"", np.int64)
        columns = {c: left[c].to_pylist() for c in left.column_names}
        rows = [(s, uids, n, None, k, g, v) for s, uids, n, k, g, v in zip(*(columns[c] for c in ("slice", "uids", "lengths", "known", "logs", "score")), strict=True) if uids is not None]
        u, w = (_read(columns[c], np.int32).astype(np.int64) for c in ("u", "w"))
        u_id, w_id = (_read(columns[c], np.uint64) for c in ("u_id", "w_id"))
        place = [np.repeat(np.arange(left.num_rows, dtype=np.int64), [len(x) // 4 if x else 0 for x in columns[c]]) << 32 | _read(columns[c], np.uint32) for c in ("refs", "refs_id")]
        score = [smoothed(probed(part["segment"], pair_hash(known.ids[u], known.ids[w])), True, DISCOUNT * known.followers[u] * (known.counts[w] + 0.5) / below)]
        u, w = known.codes(u_id), known.codes(w_id)
        history, rare = u >= 0, w < 0
        counts = np.zeros(len(w_id), np.int64)
        counts[~rare] = known.counts[w[~rare]]
        if len(own_ids):
            at = np.minimum(np.searchsorted(own_ids, w_id), len(own_ids) - 1)
            counts = np.where(rare & (own_ids[at] == w_id), own_counts[at], counts)
        share = np.full(len(u), STRENGTH)
        share[history] = DISCOUNT * known.followers[u[history]]
        score.append(smoothed(probed(part["segment"], pair_hash(u_id, w_id)), history, share * (counts + 0.5) / below) - np.where(rare, np.log10(counts + STRENGTH), 0.0))
        keys, at = np.unique(np.concatenate(place), return_inverse=True)
        score = np.bincount(at, np.concatenate(score), len(keys))
        at = at[len(place[0]) :]
        seen = np.bincount(at, rare & (counts > 0), len(keys)).astype(np.int64)
        logs = np.bincount(at, np.where(rare, np.log10(counts + 0.5), 0.0), len(keys))
        source, ref = keys >> 32, (keys & 0xFFFFFFFF).astype(np.uint32)
        bounds = np.searchsorted(source, np.arange(left.num_rows + 1))
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b > a:
                coded = columns["u"][i] is not None
                rows.append((columns["slice"][i], None, None, ref[a:b].tobytes(), None if coded else seen[a:b].tobytes(), None if coded else logs[a:b].tobytes(), score[a:b].tobytes()))
        return pa.Table.from_batches([_table(rows, _ANSWER)])

    return asked.groupBy("bucket").cogroup(model.buckets.groupBy("bucket")).applyInArrow(meet, _ddl(_ANSWER))


def summed(found: DataFrame) -> DataFrame:
    """(uid, n_tokens, n_known, logs, score) from the answers of each slice."""
    out = pa.schema([("uid", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64())])

    def add(group: pa.Table) -> pa.Table:
        c = {k: group[k].to_pylist() for k in group.column_names}
        own = next((i for i, x in enumerate(c["uids"]) if x is not None), None)
        uids, lengths = (np.frombuffer(c[k][own], np.int64) for k in ("uids", "lengths"))
        known, logs, score = np.frombuffer(c["known"][own], np.int64).copy(), np.frombuffer(c["logs"][own], np.float64).copy(), np.frombuffer(c["score"][own], np.float64).copy()
        for i, refs in enumerate(c["refs"]):
            if refs is not None:
                at = np.frombuffer(refs, np.uint32)
                score[at] += np.frombuffer(c["score"][i], np.float64)
                if c["known"][i] is not None:
                    known[at] += np.frombuffer(c["known"][i], np.int64)
                    logs[at] += np.frombuffer(c["logs"][i], np.float64)
        return pa.table([pa.array(x) for x in (uids, lengths, known, logs, score)], schema=out)

    return found.groupBy("slice").applyInArrow(add, _ddl(out))


def score(docs: DataFrame, train: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(uid, n_tokens, n_known, train_tokens, base_score, score) for rows (uid, text) of docs; uids are distinct."""
    model = learn(train, bucket_count(docs, train), frequent)
    sums = summed(answers(probes(docs, model), model))
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(model.below))
    return sums.select("uid", "n_tokens", "n_known", F.lit(model.n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
