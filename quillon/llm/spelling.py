r"""Operator 11: groups of spelling variants by blocked Gram matrices of letter counts.

Words that differ by one inserted, deleted or replaced letter have letter counts at a squared distance of 1 or 2. Blocks of words of
adjacent lengths are turned into matrices of letter counts; one NumPy product of two blocks gives all their inner products and so
all squared distances; pairs at most MOST_APART apart are kept, and their edit is verified.

Which words share a block. Of two near words, the shorter one of length L, either the first L // 2 letters agree or the last
L - L // 2 do. So a word of length L meets words of lengths L and L + 1 under its first and its last half, and those of L - 1 as
the longer one. A group of more than CELL words is dealt on in the same way: what its words don't share yet is halved again, until
groups are small or one letter is left, when the alphabet bounds them. No pair is lost and no group is compared that
grows with the square of the vocabulary; a pair found under several keys counts once.

A word's form is its near word with the largest count, if that is DOMINANT times its own or more; forms are followed to the last
one, the root, by doubling the steps: counts grow along the way, so there are no circles.

Defined results: null text has no words; a null doc_id counts as an empty string in the rule of deletions; rows that repeat
are counted each; words shorter than LEAST letters or seen less than twice are none; ties of forms go to the smaller word in code
points; runs of any length are compared; an empty table gives no rows. Columns but doc_id and the text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, partitions, whole_text
from quillon.llm.simhash import by_group

#: Letters of a run: ASCII and the upper half of Latin-1.
FIRST, LAST = 0xC0, 0xFF
RUN = rf"[A-Za-z\x{{{FIRST:X}}}-\x{{{LAST:X}}}]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, SEEN = 7, 2
#: One run in so many, by the hash of document and run, loses a letter.
DROPPED = 31
MOST_APART, DOMINANT = 2, 10
#: Words of a group before it is dealt on, and rows of a block of a product.
CELL, BLOCK = 2048, 256


def words(docs: DataFrame, text: str = "text", least: int = LEAST, seen: int = SEEN, dropped: int | None = DROPPED) -> DataFrame:
    """(word, n): runs of letters in lower case, with the deletions that the rule asks for, and their occurrences."""
    found = F.regexp_extract_all(whole_text(text), F.lit(f"{RUN}{{{least},}}"), F.lit(0))  # whole runs: a shorter one has no match
    run = F.translate("run", _UPPER, _LOWER)
    rows = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run")).select("doc", run.alias("run"))
    if dropped is None:
        counted = rows.select(F.col("run").alias("word"))
    else:
        h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        counted = rows.withColumn("h", h).select(F.when(F.col("h") % dropped == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = counted.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= seen)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes b of a; a isn't longer."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(b) - len(a) != 1:
        return False
    at = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[at:] == b[at + 1 :]


def letter_counts(some: list[str]) -> np.ndarray:
    """A row for each word: how often each letter of the alphabet is in it. Whole numbers, exact as doubles."""
    letters = np.frombuffer("".join(some).encode("latin-1"), np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(some)), [len(w) for w in some])
    column = np.where(letters >= FIRST, letters - FIRST + 26, letters - ord("a"))
    width = 26 + LAST - FIRST + 1
    return np.bincount(row * width + column, minlength=len(some) * width).reshape(len(some), width).astype(np.float64)


def near_pairs(some: list[str], group: np.ndarray) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart of words with one group number; rows in the order of groups. Blocks of rows meet the blocks further
    on for as long as a group goes on."""
    some_lengths = np.array([len(w) for w in some])
    ends = np.searchsorted(group, group, "right")
    for at in range(0, len(some), BLOCK):
        stop = min(len(some), at + BLOCK)
        x = letter_counts(some[at:stop])
        xx = (x * x).sum(1)
        for other in range(at, int(ends[stop - 1]), BLOCK):
            end = min(len(some), other + BLOCK)
            y = x if other == at else letter_counts(some[other:end])
            apart = xx[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
            fits = (apart <= MOST_APART) & (group[at:stop, None] == group[other:end])
            fits &= np.abs(some_lengths[at:stop, None] - some_lengths[other:end]) <= 1
            for i, j in zip(*(v.tolist() for v in np.nonzero(fits)), strict=True):
                if other + j > at + i:
                    a, b = sorted((some[at + i], some[other + j]), key=len)
                    if one_edit(a, b):
                        yield a, b


def _halved(rows: DataFrame) -> DataFrame:
    """Rows (word, short, head, tail) twice: what isn't shared yet, short - head - tail letters of the shorter word, is either shared
    in its first half, which joins the head, or in its second, which joins the tail."""
    free = F.col("short") - F.col("head") - F.col("tail")
    first = F.floor(free / 2).cast("int")
    cuts = F.array(F.struct((F.col("head") + first).alias("h"), F.col("tail").alias("t")), F.struct(F.col("head").alias("h"), (F.col("tail") + free - first).alias("t")))
    cut = rows.withColumn("cut", F.explode(cuts))
    return _keyed(cut.select("word", "short", F.col("cut.h").alias("head"), F.col("cut.t").alias("tail")))


def _keyed(rows: DataFrame) -> DataFrame:
    head, tail = F.substring(F.col("word"), F.lit(1), F.col("head")), F.substring(F.col("word"), F.length("word") - F.col("tail") + 1, F.col("tail"))
    return rows.withColumn("key", F.xxhash64("short", "head", "tail", head, tail))


def dealt(vocabulary: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, key): words by the groups in which they meet all near words."""
    lengths = F.explode(F.array(F.length("word"), F.length("word") - 1))
    rows = vocabulary.select("word", lengths.alias("short"), F.lit(0).alias("head"), F.lit(0).alias("tail"))
    rows, out = materialize(_halved(rows), "cells"), []
    while True:
        one = F.max(F.col("short") - F.col("head") - F.col("tail")).alias("free")  # keys that share a hash may differ in it
        large = rows.groupBy("key").agg(F.count("*").alias("n"), one).filter((F.col("n") > cell) & (F.col("free") > 1)).select("key")
        large = materialize(large, "large")
        if large.isEmpty():
            break
        out.append(rows.join(large, "key", "left_anti").select("word", "key"))
        deeper = rows.join(large, "key", "left_semi")
        free = F.col("short") - F.col("head") - F.col("tail") > 1
        done, rows = deeper.filter(~free), _halved(deeper.filter(free))
        rows = materialize(rows.unionByName(done).distinct(), "cells")
    out.append(rows.select("word", "key"))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def links(vocabulary: DataFrame, cell: int = CELL) -> DataFrame:
    """(a, b): all pairs of words of vocabulary (word) that one edit makes of each other, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in by_group(batches, ["key"]):
            sizes = np.diff(bounds)
            several = np.repeat(sizes > 1, sizes)
            some = t["word"].filter(pa.array(several)).to_pylist()
            found = list(near_pairs(some, np.repeat(np.arange(len(sizes)), sizes)[several]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["a", "b"])

    met = dealt(vocabulary, cell).repartition(partitions(vocabulary.sparkSession), "key").sortWithinPartitions("key")
    pairs = met.mapInArrow(run, "a string, b string")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last form that following leads to. Each round doubles the steps."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialize(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, text: str = "text", dominant: int = DOMINANT, **rule: int | None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text)."""
    vocabulary = materialize(words(docs, text, **rule), "vocabulary")
    pairs = materialize(links(vocabulary.select("word")), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    counted = both.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = F.min(F.struct((-F.col("other_n")).alias("down"), F.col("other").alias("form"))).alias("best")
    near = counted.groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = vocabulary.join(near, "word", "left").withColumn("form_n", -F.col("best.down"))
    taken: Column = F.col("form_n") >= dominant * F.col("n")
    rows = rows.select("word", F.when(taken, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("form_n")).alias("form_n"))
    rows = materialize(rows, "forms")
    named = rows.join(roots(rows.filter("form is not null")), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
