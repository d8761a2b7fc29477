r"""Operator 12: token counts by a whole-token shortcut.

Before any text is read, every string of the vocabulary is merged by itself: those that end as one token are proven, and a
pre-token that is one of them counts as one without another look. Only the rest is merged, by a heap of ranks, in n log n steps
for a pre-token of n letters, and remembered, a bounded number for each worker. What the proof gives is broadcast: it is as large
as the vocabulary file, at most MOST_TOKENS strings, whatever the input.

The tokenizers that this counts for are byte-level merges as `tokenizers` files describe them: special strings are cut out of
the raw text first, one token each; then NFC, white space, lower case; then the pattern cuts pre-tokens; then merges, with an end
of word if the model has one. A file that asks for anything else is refused.

Defined results: null text is the empty text, no tokens; white space alone gives none; texts of any length are counted whole;
repeated rows are counted each; a null doc_id stays null; columns but doc_id and the text aren't read, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import filterfalse
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quillon.llm.common import Remembered, sliced, whole_text

#: Tokens above which a text is over the limit.
LIMIT = 2048
MOST_TOKENS = 1 << 20
#: Pre-tokens that a worker remembers, and up to which length.
PIECES_KEPT, LONGEST_KEPT = 200_000, 256
#: White space of the normalizers: ASCII without the separators 1C to 1F, NEL, and Unicode's separators.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters on which the classes of re and regex agree: Latin letters, ASCII, no superscripts, fractions or rare controls.
_PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")
#: The pattern of a byte-level step that has none of its own (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable, else the next free one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Vocabulary(NamedTuple):
    """A tokenizer file as counting needs it. merges: rank by pair of parts; whole: texts proven to be one token."""

    specials: tuple[str, ...]
    nfc: bool
    lower: bool
    pattern: str
    suffix: str
    merges: dict[tuple[str, str], int]
    whole: frozenset[str]


def merged(parts: list[str], merges: dict[tuple[str, str], int]) -> int:
    """How many parts are left when pairs are joined by lowest rank, the leftmost first."""
    parts, n = list(parts), len(parts)
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    heap = [(r, i) + p for i, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := merges.get(p)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j >= n or parts[i] != a or parts[j] != b:
            continue  # one of the two has been joined with another
        parts[i], parts[j], left = a + b, "", left - 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for x, y in ((before[i], i), (i, k)):
            if x >= 0 and y < n and (r := merges.get((parts[x], parts[y]))) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return left


def proven(vocabulary: dict[str, int], merges: dict[tuple[str, str], int], suffix: str) -> frozenset[str]:
    """Texts that are one token when they are encoded alone: strings of the vocabulary whose own letters merge into them."""
    bytes_of = {c: b for b, c in enumerate(byte_letters())}
    out = set()
    for token in vocabulary:
        letters = token.removesuffix(suffix) if suffix else token
        if not letters or (suffix and letters == token) or not bytes_of.keys() >= set(letters):
            continue
        parts = list(letters)
        parts[-1] += suffix
        if merged(parts, merges) == 1:
            try:
                out.add(bytes(map(bytes_of.__getitem__, letters)).decode())
            except UnicodeDecodeError:
                pass  # part of a character: no text is that
    return frozenset(out)


def _normal(step: dict | None) -> tuple[bool, bool]:
    """Whether a normalizer composes and lowers; runs of white space made one don't change a count."""
    nfc = lower = False
    for s in [] if step is None else step["normalizers"] if step["type"] == "Sequence" else [step]:
        if s["type"] == "NFC" and not lower:
            nfc = True
        elif s["type"] == "Lowercase":
            lower = True
        elif (s["type"], s.get("pattern"), s.get("content")) != ("Replace", {"Regex": r"\s+"}, " "):
            raise ValueError(f"no counting with the normalizer {s}")
    return nfc, lower


def _pattern(step: dict, spaces: bool) -> str:
    """The pattern whose matches are the pre-tokens."""
    steps = step["pretokenizers"] if step["type"] == "Sequence" else [step]
    split = [s for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
    last = steps[-1]
    if last["type"] != "ByteLevel" or last.get("add_prefix_space") or len(steps) != len(split) + 1 or len(split) > 1:
        raise ValueError(f"no counting with the pre-tokenizer {step}")
    if bool(split) == last.get("use_regex", True):
        raise ValueError("no counting with two patterns or none")
    if split:
        return split[0]["pattern"]["Regex"]
    if spaces:
        raise ValueError("no counting of white space that the normalizer changes")
    return BYTE_LEVEL


def load(path: str) -> Vocabulary:
    """A tokenizer file, with the proof of its whole tokens."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model = d["model"]
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        raise ValueError("only plain byte-level merges are counted")
    if len(model["vocab"]) > MOST_TOKENS:
        raise ValueError(f"a vocabulary of more than {MOST_TOKENS} strings isn't broadcast")
    suffix = model.get("end_of_word_suffix") or ""
    if not {c + s for c in byte_letters() for s in {"", suffix}} <= model["vocab"].keys():
        raise ValueError("the vocabulary lacks bytes")
    pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
    merges = {p: i for i, p in enumerate(pairs)}
    if any(t.get("normalized") or t["single_word"] or t["lstrip"] or t["rstrip"] for t in d["added_tokens"]):
        raise ValueError("only added tokens that stand as they are in the raw text are counted")
    specials = tuple(sorted((t["content"] for t in d["added_tokens"]), key=len, reverse=True))
    (nfc, lower), replaced = _normal(d["normalizer"]), "Replace" in json.dumps(d["normalizer"])
    pattern = _pattern(d["pre_tokenizer"], replaced)
    return Vocabulary(specials, nfc, lower, pattern, suffix, merges, proven(model["vocab"], merges, suffix))


class Counter:
    """Token counts of texts, with what a worker remembers."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.pieces, self.letters = vocabulary, Remembered(PIECES_KEPT), byte_letters()
        one = vocabulary.pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
        exact, plain = one, one
        for old, new in ((r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]"), (r"\s", f"[{SPACE}]"), (r"\S", f"[^{SPACE}]")):
            exact = exact.replace(old, new)
        for old, new in ((r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"), (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d")):
            plain = plain.replace(old, new)
        self.exact, self.plain = regex.compile(exact), None if r"\p" in plain or r"\P" in plain else re.compile(plain)
        self.special = re.compile("|".join(map(re.escape, vocabulary.specials))) if vocabulary.specials else None

    def normal(self, text: str) -> str:
        if self.v.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.v.lower:
            text = text.replace("\u03a3", "\u03c3").lower()  # letter by letter: no form for the end of a word
        return text

    def rest(self, piece: str) -> int:
        """Tokens of a pre-token that isn't proven."""
        parts = [self.letters[b] for b in piece.encode()]
        parts[-1] += self.v.suffix
        return merged(parts, self.v.merges)

    def part(self, text: str) -> int:
        """Tokens of a text without special strings."""
        text = self.normal(text)
        plain = self.plain is not None and _PLAIN.fullmatch(text)
        pieces = (self.plain if plain else self.exact).findall(text)
        others = list(filterfalse(self.v.whole.__contains__, pieces))
        n = len(pieces) - len(others)
        known, new = self.pieces.missing(set(others))
        long: dict[str, int] = {}
        for p in new:
            (known if len(p) <= LONGEST_KEPT else long)[p] = self.rest(p)
        return n + sum(map({**known, **long}.__getitem__ if long else known.__getitem__, others))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.part(text)
        between = self.special.split(text)
        return len(between) - 1 + sum(map(self.part, between))


RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def counts(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, as the library of the file at path counts it."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary.value)
        for b in sliced(batches):
            n = pa.array([counter.count(t.as_py()) for t in b.column(1)], pa.int64())
            n_bytes = pc.cast(pc.binary_length(b.column(1)), pa.int64())
            columns = [b.column(0), n_bytes, n, pc.greater(n, limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long"), whole_text(text).alias("text")).mapInArrow(run, RESULT)
