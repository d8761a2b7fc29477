"""Operator 6: toxicity by a weighted finite-state pattern grammar.

Learning. From at most SAMPLE labelled training documents (near copies count once, by their smallest shingle
hash), words and word beginnings get a weight if their document frequencies differ enough between the labels
(likelihood ratio of LEAST_RATIO or more, for toxic ones). The LEXICON strongest are the insult pattern.

Grammar. A clause, the words between two marks of punctuation, is read by five transducers composed into one: insults give
the weight of their pattern, more if another is near; threats, verbs in all their forms, give theirs, more after a word of intent;
a target near them adds to these, negation and reported speech before them take from these. Composed transitions are remembered.
A document's features are the sum and the largest of its clause scores and the share of matched clauses; a logistic fit on the
same sample turns them into a score of 0 to 1.

Defined results: null or empty texts match nothing and get the score of such texts; without labels of both kinds
the score is 0 for all; repeated rows are scored each; labels that are null or of unknown documents aren't used;
an empty table gives no rows. keep_clean leaves all columns as they are; score adds or replaces toxicity.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Remembered, boxed, materialize, sliced, unboxed, whole_text

SAMPLE, LEXICON = 20_000, 2_000
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
BEGINNINGS = (4, 5, 6, 7)
LEAST_RATIO, LEAST_WEIGHT = 24.0, 1.5
WORDS_KEPT = 120_000
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.,;:!?\n|]+")

# Fixed words of the grammar, by language: stems of threats with the endings that form their words, and whole words.
THREATS = {
    "en": ("kill hurt destroy burn beat smash murder", ("", "s", "es", "ed", "ing")),
    "de": ("töt verletz zerstör verbrenn schlag", ("e", "est", "st", "t", "et", "en", "te", "ten")),
    "fr": ("tu bless brûl frapp tabass", ("er", "e", "es", "ons", "ez", "ent", "erai", "era", "eront")),
    "es": ("mat quem golpe destroz machac", ("ar", "o", "as", "a", "amos", "an", "aré", "ará", "arán")),
}
INTENTS = {
    "en": "will shall gonna going should must ought",
    "de": "werde wird werden soll sollte sollten muss müssen",
    "fr": "vais va allons vont devrait devraient dois",
    "es": "voy va vamos van debería deberían debo",
}
TARGETS = {
    "en": "you your yours yourself they them he she him her these those",
    "de": "du dich dir dein ihr euch euer sie",
    "fr": "tu toi ton ta tes vous votre vos ils elles",
    "es": "tú ti tus usted ustedes vosotros ellos ellas",
}
NEGATIONS = {
    "en": "not no never don't isn't aren't wasn't won't nobody",
    "de": "nicht kein keine keinen nie niemals",
    "fr": "ne pas jamais aucun aucune",
    "es": "no nunca jamás ningún ninguna",
}
REPORTS = {
    "en": "said says wrote writes called calls quoted claimed reported",
    "de": "sagte sagt schrieb nannte behauptete",
    "fr": "dit disait écrit appelle affirme",
    "es": "dijo dice escribió llamó afirma",
}
#: Word: class. Forms that are words of another class aren't threats.
CLASSES = {stem + ending: "threat" for stems, endings in THREATS.values() for stem in stems.split() for ending in endings}
CLASSES |= {w: kind for kind, words in (("intent", INTENTS), ("target", TARGETS), ("report", REPORTS), ("negation", NEGATIONS)) for line in words.values() for w in line.split()}
THREAT_WEIGHT = 1.0
#: Words that a negation, a report, a target, an intent or an insult reaches.
REACH = 4
NEGATED, REPORTED, TARGETED, INTENDED, STACKED = 0.6, 0.7, 1.25, 1.5, 1.1


@dataclass(frozen=True)
class Transducer:
    """Its state is the number of words for which the last word of the class opens still counts. On a word of the classes takes it
    puts out a factor: near where the state is above 0, otherwise 1."""

    opens: str
    takes: frozenset[str]
    near: float

    def step(self, state: int, kind: str) -> tuple[int, float]:
        after = REACH if kind == self.opens else max(0, state - 1)
        return after, self.near if state and kind in self.takes else 1.0


_HITS = frozenset(("insult", "threat"))
INSULT, THREAT = Transducer("insult", frozenset(("insult",)), STACKED), Transducer("intent", frozenset(("threat",)), INTENDED)
TARGET, NEGATION, REPORT = Transducer("target", _HITS, TARGETED), Transducer("negation", _HITS, NEGATED), Transducer("report", _HITS, REPORTED)


class Grammar:
    """The composition of the transducers: states are tuples of theirs, the output of a word is its weight times their factors;
    transitions are made when first met."""

    def __init__(self, parts: tuple[Transducer, ...] = (INSULT, THREAT, TARGET, NEGATION, REPORT)) -> None:
        self.parts, self.moves = parts, {}

    def clause(self, symbols: list[tuple[str, float]]) -> float:
        """The score of a clause of (class, weight) symbols."""
        state, total = (0,) * len(self.parts), 0.0
        for kind, weight in symbols:
            move = self.moves.get((state, kind))
            if move is None:
                steps = [m.step(s, kind) for m, s in zip(self.parts, state, strict=True)]
                move = self.moves[state, kind] = tuple(s for s, _ in steps), math.prod(f for _, f in steps)
            state, factor = move
            total += weight * factor
        return total


_OTHER = ("other", 0.0)


class Reader:
    """Features of texts under a lexicon (pattern: weight), patterns being words or, with a star, their beginnings."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.words = {k: v for k, v in lexicon.items() if k[-1] != "*"}
        self.beginnings = {k[:-1]: v for k, v in lexicon.items() if k[-1] == "*"}
        self.grammar, self.known = Grammar(), Remembered(WORDS_KEPT)

    def symbol(self, word: str) -> tuple[str, float]:
        weight = max([self.words.get(word, 0.0), *(self.beginnings.get(word[:n], 0.0) for n in BEGINNINGS if len(word) >= n)])
        if weight:
            return "insult", weight
        kind = CLASSES.get(word)
        return (kind, THREAT_WEIGHT * (kind == "threat")) if kind else _OTHER

    def features(self, text: str) -> tuple[float, float, float]:
        low = text.lower()
        words = _WORD.findall(low)
        distinct = set(words)
        known, new = self.known.missing(distinct)
        for w in new:
            known[w] = self.symbol(w)
        if not any(known[w][1] for w in distinct):
            return 0.0, 0.0, 0.0
        scores = [self.grammar.clause([known.get(w) or self.symbol(w) for w in _WORD.findall(c)]) for c in _CLAUSE.split(low)]
        matched = [s for s in scores if s > 0]
        return math.log1p(sum(matched)), max(matched, default=0.0), len(matched) / max(1, len(scores))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic): most labelled training rows at most, by a hash of the id, near copies once."""
    own = labels.filter("toxic in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = own.count()
    own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, 0.95 * most / max(1, n)) * (1 << 30)))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", whole_text().alias("text")).join(own, "doc_id")

    @F.pandas_udf("long")
    def signature(texts: pd.Series) -> pd.Series:
        def one(text: str) -> int:
            words = text.lower().encode().split()
            shingles = zip(words, words[1:], words[2:], strict=False) if len(words) > 2 else [words]
            return min(xxhash.xxh64_intdigest(b" ".join(s)) for s in set(map(tuple, shingles))) - (1 << 63)

        return texts.map(one)

    return rows.withColumn("sig", signature("text")).groupBy("sig", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def learn_lexicon(sample: DataFrame, most: int = LEXICON) -> tuple[dict[str, float], tuple[int, int]]:
    """The strongest toxic patterns with their weights, and the number of documents by label."""
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return {}, (n0, n1)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 0):
            counts = {0: Counter(), 1: Counter()}
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall(text.lower()))
                counts[toxic].update(words | {f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) >= n})
            rows = [(k, v if y == 0 else 0, v if y == 1 else 0) for y in (0, 1) for k, v in counts[y].items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["pattern", "a0", "a1"])

    found = sample.mapInArrow(patterns, "pattern string, a0 long, a1 long").groupBy("pattern").agg(F.sum("a0").alias("a0"), F.sum("a1").alias("a1"))
    part = lambda k, e: F.when(k > 0, k * F.ln(k / e)).otherwise(0.0)
    both = F.col("a0") + F.col("a1")
    ratio = 2 * (part(F.col("a0"), both * n0 / (n0 + n1)) + part(F.col("a1"), both * n1 / (n0 + n1)))
    weight = F.ln((F.col("a1") + 0.5) / (n1 + 1)) - F.ln((F.col("a0") + 0.5) / (n0 + 1))
    top = found.filter((ratio >= LEAST_RATIO) & (weight >= LEAST_WEIGHT)).select("pattern", weight.alias("w"), ratio.alias("r")).orderBy(F.desc("r"), "pattern").limit(most)
    return {r.pattern: r.w for r in top.collect()}, (n0, n1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's method; the last coefficient is the constant."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    coefficients: tuple[float, ...] | None


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    sample = materialize(labelled_sample(docs, labels, most), "toxicity-sample")
    lexicon, (n0, n1) = learn_lexicon(sample)
    if not n0 or not n1:
        return Model({}, None)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for b in sliced(batches, 0):
            rows = [(*reader.features(t), y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows, strict=True)], ["a", "b", "c", "y"])

    rows = sample.mapInArrow(features, "a double, b double, c double, y double").toArrow()
    m = np.array(sorted(zip(*(rows[c].to_pylist() for c in "abcy"), strict=True)))
    return Model(lexicon, tuple(map(float, fit(m[:, :3], m[:, 3]))))


def scorer(docs: DataFrame, model: Model):
    """A function of texts: the score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        reader, w = Reader(model.lexicon), model.coefficients
        for texts in batches:
            yield texts.map(lambda t: 0.0 if w is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, (*reader.features(t), 1.0), strict=True)))))))

    return scores


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with their toxicity (0 to 1) in a column of that name."""
    rows = boxed(docs, "text").withColumn("score", scorer(docs, model)(whole_text()))
    return unboxed(rows, [c for c in docs.columns if c.lower() != "toxicity"], {"toxicity": F.col("score")})


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose toxicity is below the threshold, columns unchanged."""
    rows = boxed(docs, "text").withColumn("score", scorer(docs, model)(whole_text()))
    return unboxed(rows.filter(F.col("score") < threshold), docs.columns, {})
