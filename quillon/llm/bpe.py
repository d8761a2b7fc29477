"""Operator 8: byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece exactly one vocabulary token can be the last token of its encoding: the token that
ends there, whose own start is the end of a prefix with a last token the pair agrees with. Two tokens agree if merging their bytes
gives back the two. The table of last tokens is all that is stored: reading it backwards gives the encoding, an
append only adds entries, and an edit works out entries from where it is to where they are again what they were.

Texts are cut into pieces by the tokenizer's pattern, each piece is encoded separately; a piece that is a token
is that token. Encodings of pieces are remembered, a bounded number for each task.

Defined results: null text is the empty text: no ids. Texts of any length are encoded whole. Repeated rows are encoded each.
An empty table gives no rows. Bytes of a piece that no token covers are an error: a byte-level vocabulary has all bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Remembered, sliced, whole_text

PIECES_KEPT, PAIRS_KEPT = 200_000, 300_000
#: Characters on which the classes of re and regex agree: Latin letters, ASCII, no superscripts, fractions or rare controls.
_PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for re, to which plain texts give the same pieces several times faster; None if it has other classes."""
    for a, b in ((r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"), (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d")):
        pattern = pattern.replace(a, b)
    return None if r"\p" in pattern or r"\P" in pattern else re.compile(pattern)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixTable:
    """Last tokens of the prefixes of a byte string. computed: how many entries were worked out so far."""

    def __init__(self, bpe: "Bpe", data: bytes = b"") -> None:
        self.bpe, self.data, self.last, self.computed = bpe, data, [], 0
        self._extend(len(data))

    def append(self, more: bytes) -> "PrefixTable":
        self.data += more
        self._extend(len(self.data))
        return self

    def _extend(self, stop: int) -> None:
        """Entries up to the prefix of stop bytes."""
        bpe, last, data = self.bpe, self.last, self.data
        rank, pair, longest = bpe.ranks.get, bpe._agree.get, bpe.longest
        self.computed += stop - len(last)
        for end in range(len(last) + 1, stop + 1):
            for start in range(max(0, end - longest), end):
                token = rank(data[start:end])
                if token is None:
                    continue
                if start:
                    before = last[start - 1]
                    fits = pair(before << 32 | token)
                    if fits is None:
                        fits = bpe.agree(before, token)
                else:
                    fits = bpe.reachable(token)
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}")

    def edit(self, start: int, stop: int, new: bytes) -> "PrefixTable":
        """Replace data[start:stop]. Entries of the prefixes before start stay. An entry depends on the bytes of the longest token
        before it and on the entries there; so once `longest` entries in a row behind the edit are what they were, all further ones
        are, and the old ones are taken over."""
        tail, kept = self.last[stop:], self.data[stop:]
        self.data, self.last = self.data[:start] + new + kept, self.last[:start]
        begin, longest = start + len(new), self.bpe.longest
        self._extend(begin)
        alike = 0
        for i, old in enumerate(tail):
            self._extend(begin + i + 1)
            alike = alike + 1 if self.last[-1] == old else 0
            if alike >= longest:
                self.last += tail[i + 1 :]
                break
        return self

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.bpe.bytes_of[out[-1]])
        return out[::-1]


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern, self.plain = ranks, regex.compile(pattern), plain_pattern(pattern)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._agree: dict[int, bool] = {}
        self._merged: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self.pieces = Remembered(PIECES_KEPT)

    def merge(self, data: bytes, stop: int = 1) -> list[int]:
        """Plain merging by lowest rank, down to `stop` parts: for single tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            ranks = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        """Merging a token's bytes gives the token."""
        known = self._merged.get(token)
        if known is None:
            known = self._merged[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that a token's last merge joins; a single byte twice itself."""
        known = self._halves.get(token)
        if known is None:
            data = self.bytes_of[token]
            known = (token, token)
            if len(data) > 1:
                two = self.merge(data, stop=2)
                known = (two[0], two[1]) if len(two) == 2 else known
            self._halves[token] = known
        return known

    def agree(self, first: int, second: int) -> bool:
        known = self._agree.get(first << 32 | second)
        if known is None:
            if len(self._agree) > PAIRS_KEPT:
                self._agree.clear()
            known = self._agree[first << 32 | second] = self._stay_apart(first, second)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging never joins bytes across the border of two tokens: undo the later of the two tokens' last merges
        again and again; at each step the pieces at the border would have joined if their join came before what was undone."""
        joined, bytes_of, limit = self.ranks.get, self.bytes_of, 1 << 60
        while True:
            both = joined(bytes_of[left] + bytes_of[right])
            if both is not None and both < limit:
                return False
            a, b = self.halves(left)[1], self.halves(right)[0]
            if a == left and b == right:
                return True
            if a != left and (left > right or b == right):
                limit, left = left, a
            else:
                limit, right = right + 1, b

    def piece(self, piece: str) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit numbers."""
        data = piece.encode()
        token = self.ranks.get(data)
        ids = [token] if token is not None else PrefixTable(self, data).tokens()
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        plain = self.plain is not None and _PLAIN.fullmatch(text)
        pieces = (self.plain if plain else self.pattern).findall(text)
        known, new = self.pieces.missing(set(pieces))
        for p in new:
            known[p] = self.piece(p)
        return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[str, str], Bpe] = {}


def load(path: str, pattern: str) -> Bpe:
    """The vocabulary at a path of the worker, read once for each Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(read_ranks(path), pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the token ids of their texts, array<long>."""

    @F.pandas_udf("array<long>")
    def ids(texts: pd.Series) -> pd.Series:
        bpe = load(path, pattern)
        return texts.map(lambda t: np.frombuffer(bpe.encode(t), "<u4").astype(np.int64))

    return docs.withColumn(into, ids(whole_text(text)))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with the bytes of their token ids; null ids give null."""

    @F.pandas_udf("binary")
    def texts(lists: pd.Series) -> pd.Series:
        bpe = load(path, pattern)
        return lists.map(lambda x: None if x is None else bpe.decode(np.asarray(x, "<u4").tobytes()))

    return rows.withColumn(into, texts(ids))


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text and decode its ids: number of tokens and digests of both (see RESULT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in sliced(batches):
            rows = []
            for text in b.column(1).to_pylist():
                ids = bpe.encode(text)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long"), whole_text().alias("text")).mapInArrow(run, RESULT)
