r"""Operator 13: importance resampling towards a target distribution, with segment deduplication.

Texts are cut into lines. Each distinct line, whatever number of documents shows it, has its features counted once: the buckets of
its runs of 1 to ORDER consecutive words. Times the occurrences these give the corpus's bucket counts; n-grams that run over the
end of a line are counted by document and added. A bucket's gain compares its share in the target with that in the corpus. A
line's gain is worked out once as well; a document's weight is the sum over its lines and over its n-grams across lines. Documents are
drawn without replacement by the largest weights with seeded Gumbel noise.

Size. Lines' texts are shuffled once, counted on the map side first. Documents then meet their lines by 16-byte keys: a line that makes
up one in FREQUENT of all or more is broadcast with its numbers (FREQUENT rows at most for that reason), so that no key is hot. The
gains are one number a bucket. Ranks go by ranges of the order, not through one task.

Defined results: null text is the empty text; a text without words has no features and weight 0; rows with one doc_id or
none are scored each by their own text; the noise of a null doc_id is that of the empty string and it comes last among ties; lines
are compared after lower-casing A-Z; an empty table gives no rows; without target texts T = 0. Columns but doc_id and the text
aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, meet, whole_text
from quillon.operators.ordering import numbered

#: Runs of digits, ASCII letters and whatever isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORDER, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def _gram(words: Column, n: int, buckets: int):
    """The bucket of n words from a place on; a function of the place alone."""
    return lambda i: bucket(F.array_join(F.slice(words, i, n), " "), buckets)


def runs(words: Column, order: int, buckets: int) -> Column:
    """Buckets of the runs of 2 to order words."""
    out = F.array().cast("array<int>")
    for n in range(2, order + 1):
        last = F.size(words) - n + 1
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), last))
        found = F.transform(starts, _gram(words, n, buckets))
        out = F.concat(out, F.when(last >= 1, found).otherwise(F.array().cast("array<int>")))
    return out


def features(words: Column, order: int, buckets: int) -> Column:
    """Buckets of all runs of 1 to order consecutive words of one line."""
    singles = F.transform(words, lambda w: bucket(w, buckets))
    return singles if order == 1 else F.concat(singles, runs(words, order, buckets))


def across(lines: Column, order: int, buckets: int) -> Column:
    """Buckets of the runs of 2 to order words that don't lie in one line; lines: arrays of words, none of them empty. A run belongs
    to the first end of a line in it, so it begins in the order - 1 words before that and ends in the order - 1 words after."""

    def at(i: Column) -> Column:
        line = F.get(lines, i - 1)
        head = F.slice(line, F.greatest(F.lit(1), F.size(line) - order + 2), order - 1)
        tail = F.slice(F.flatten(F.slice(lines, i + 1, order - 1)), 1, order - 1)
        found, joined = F.array().cast("array<int>"), F.concat(head, tail)
        for n in range(2, order + 1):
            first, last = F.greatest(F.lit(1), F.size(head) - n + 2), F.least(F.size(head), F.size(joined) - n + 1)
            grams = F.transform(F.sequence(first, F.greatest(first, last)), _gram(joined, n, buckets))
            found = F.concat(found, F.when(first <= last, grams).otherwise(F.array().cast("array<int>")))
        return found

    ends = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(lines) - 1))
    return F.when(F.size(lines) > 1, F.flatten(F.transform(ends, at))).otherwise(F.array().cast("array<int>"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _lines(docs: DataFrame, text: str) -> Column:
    return F.split(F.translate(whole_text(text), _UPPER, _LOWER), "\n")


class Corpus:
    """Texts by their distinct lines. lines: (key, n, words, buckets), n the occurrences; crossing: (buckets) by document, null
    for runs of single words, which never cross a line."""

    def __init__(self, docs: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> None:
        lines = docs.select(F.explode(_lines(docs, text)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
        words = lines.select(F.unhex(F.md5("line")).alias("key"), "n", _words(F.col("line")).alias("said")).filter(F.size("said") > 0)
        numbers = words.select("key", "n", F.size("said").alias("words"), features(F.col("said"), order, buckets).alias("buckets"))
        self.lines, self.crossing = materialize(numbers, "lines"), None
        if order > 1:
            by_line = F.filter(F.transform(_lines(docs, text), _words), lambda w: F.size(w) > 0)
            crossing = docs.select(across(by_line, order, buckets).alias("buckets")).filter(F.size("buckets") > 0)
            self.crossing = crossing

    def totals(self) -> DataFrame:
        """(bucket, n): features in each bucket."""
        counted = self.lines.select("n", F.explode("buckets").alias("bucket"))
        if self.crossing is not None:
            counted = counted.unionByName(self.crossing.select(F.lit(1).cast("long").alias("n"), F.explode("buckets").alias("bucket")))
        return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket: as many numbers as there are buckets."""
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").na.fill(0, ["s", "t"])
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t"))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = every.join(both, "bucket", "left").na.fill(0, ["s", "t"]).crossJoin(F.broadcast(sums))  # one row
    ratio = (F.col("t").cast("double") + 1) * (F.col("all_s") + buckets) / ((F.col("s").cast("double") + 1) * (F.col("all_t") + buckets))
    found = rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()  # buckets rows
    return [r.gain for r in found]


def summed(buckets: Column, gain: list[int]) -> Column:
    """The sum of the gains of an array of buckets."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")  # folded into one literal
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))


def weights(docs: DataFrame, corpus: Corpus, gain: list[int], text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of every row of docs."""
    lines = corpus.lines.select("key", "n", "words", F.size("buckets").alias("features"), summed(F.col("buckets"), gain).alias("gain"))
    lines = materialize(lines, "gains")
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    named = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), _lines(docs, text).alias("lines"))
    if order > 1:
        crossing = across(F.filter(F.transform("lines", _words), lambda w: F.size(w) > 0), order, buckets)
        named = named.withColumn("crossing", crossing)
        own = (F.size("crossing").alias("features"), summed(F.col("crossing"), gain).alias("gain"))
    else:
        own = (F.lit(0).alias("features"), F.lit(0).cast("long").alias("gain"))
    # the row itself, with what runs across its lines, and one row for each line
    parts = named.select("row", "doc_id", *own, F.explode(F.concat(F.array(F.lit(None).cast("binary")), F.transform("lines", lambda x: F.unhex(F.md5(x))))).alias("key"))
    parts = materialize(parts, "parts")
    numbers = ["row", "doc_id", "words", "features", "gain"]
    itself = parts.filter("key is null").withColumn("words", F.lit(0)).select(numbers)
    shown = parts.filter("key is not null").select("row", "doc_id", "key")
    every = itself.unionByName(meet(shown, lines, ["key"], total).select(numbers)).groupBy("row", "doc_id")
    return every.agg(F.sum("words").alias("n_words"), F.sum("features").cast("long").alias("n_features"), F.sum("gain").alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel number, rounded down, from the seed and the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    return F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text) against the texts of target (text): rank is
    the place among the floor(percent / 100 of all with least words or more) that are drawn, else null."""
    corpus = Corpus(docs, order=order, buckets=buckets)
    gain = gains(corpus.totals(), Corpus(target, order=order, buckets=buckets).totals(), buckets)
    found = weights(docs, corpus, gain, order=order, buckets=buckets)
    found = found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("short", F.col("n_words") < least)
    found = found.withColumns({"down": -F.col("score"), "nameless": F.col("doc_id").isNull()})
    found = materialize(found, "weights")
    drawn = found.filter("not short").count() * percent // 100
    ranked = numbered(found, ["short", "down", "nameless", "doc_id", "row"], "place")
    rank = F.when(~F.col("short") & (F.col("place") < drawn), F.col("place") + 1).cast("long")
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
