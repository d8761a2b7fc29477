"""Operator 10: URL filters: rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from the URLs that rules decide, SAMPLE at most, chosen by a hash of the id. Features: lengths
of host and path, depth, digit ratio, character entropy, numbers of parameters and labels, and suffix
statistics: the smoothed share of blocked URLs among the training URLs with the same last one and two labels. While the trees
learn, a URL's own host and all hosts of its fold are left out of that share, so that no label is in its own feature.

Defined results: host and path of a null url, or of one without "://", are empty: no rule fits, the method judges it; a
rule needs its path as a prefix, the longest fitting rule wins, at equal length the first in order of text; without
training URLs of both kinds the verdict is that of the only kind, or allow; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 8_000
TREES, DEPTH, SEED = 20, 4, 7
SMOOTH = 20.0
#: Folds of hosts for the suffix statistics of training URLs.
FOLDS = 5
#: (verdict, host/path); the rules of the contract, as fixed values.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
FEATURES = ("n_host", "n_path", "n_url", "n_labels", "depth", "digits", "entropy", "n_params", "n_hyphens", "suffix1", "suffix2")


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def decided(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none does."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, path = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + path)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), verdict.otherwise(none))


def lexical(rows: DataFrame, url: str = "url") -> DataFrame:
    """rows (host, path, url) with the features that need no statistics, and the suffixes."""
    u = F.coalesce(F.col(url), F.lit(""))
    chars = F.filter(F.split(u, ""), lambda c: c != "")
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n)
    labels = F.split("host", r"\.")
    return rows.withColumns(
        {
            "n_host": F.length("host").cast("double"),
            "n_path": F.length("path").cast("double"),
            "n_url": F.length(u).cast("double"),
            "n_labels": F.size(labels).cast("double"),
            "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "digits": F.regexp_count(u, F.lit("[0-9]")) / n,
            "entropy": F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p)),
            "n_params": F.regexp_count(u, F.lit("[?&][^=&#]+=")).cast("double"),
            "n_hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "last1": F.substring_index("host", ".", -1),
            "last2": F.substring_index("host", ".", -2),
        }
    )


class UrlModel:
    """Suffix statistics (at most one row a level for each training URL) and the fitted trees; a constant where one kind is missing."""

    def __init__(self, trees, suffixes: DataFrame | None, mean: float) -> None:
        self.trees, self.suffixes, self.mean = trees, suffixes, mean

    def with_suffixes(self, rows: DataFrame, also: Sequence[str] = ()) -> DataFrame:
        for k in (1, 2):
            own = self.suffixes.filter(F.col("level") == k).select(*also, F.col("suffix").alias(f"last{k}"), F.col("share").alias(f"suffix{k}"))
            rows = rows.join(F.broadcast(own), [f"last{k}", *also], "left").withColumn(f"suffix{k}", F.coalesce(f"suffix{k}", F.lit(self.mean)))
        return rows

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """rows (host, path, url) with guess: block or allow."""
        if self.trees is None:
            return rows.withColumn("guess", F.lit("block" if self.mean > 0.5 else "allow"))
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(self.with_suffixes(lexical(rows)))
        return self.trees.transform(assembled).withColumn("guess", F.when(F.col("prediction") > 0.5, "block").otherwise("allow"))


def train(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, most: int = SAMPLE) -> UrlModel:
    spark = pages.sparkSession
    rule, verdict = decided(rules)
    rows = parts(pages.select("page_id", "url")).withColumn("label", (verdict == "block").cast("double")).filter("label is not null")
    drawn = F.xxhash64("page_id", "url")
    share = min(1.0, 1.1 * most / max(1, rows.count()))  # what is sorted at the driver is bounded too
    rows = rows.filter(F.pmod(drawn, F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = rows.orderBy(drawn, "page_id", "url").limit(most).select("host", "path", "url", "label").toArrow()
    labels = sample["label"].to_pylist()
    if len(set(labels)) < 2:
        return UrlModel(None, None, labels[0] if labels else 0.0)
    mean = sum(labels) / len(labels)
    sample = spark.createDataFrame(sample).coalesce(1)  # a bounded sample, in a fixed order: every run grows the same trees
    known = lexical(sample).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)))
    suffix = F.inline(F.array(*(F.struct(F.lit(k).alias("level"), F.col(f"last{k}").alias("suffix")) for k in (1, 2))))
    counts = known.select("fold", "label", suffix).groupBy("level", "suffix", "fold").agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
    share = lambda bad, n: (bad + SMOOTH * mean) / (n + SMOOTH)
    whole = Window.partitionBy("level", "suffix")
    both = counts.withColumns({"all_bad": F.sum("bad").over(whole), "all_n": F.sum("n").over(whole)})
    shares = spark.createDataFrame(both.toArrow())  # rows of the bounded sample
    suffixes = shares.select("level", "suffix", share(F.col("all_bad"), F.col("all_n")).alias("share")).distinct()
    others = shares.select("level", "suffix", "fold", share(F.col("all_bad") - F.col("bad"), F.col("all_n") - F.col("n")).alias("share"))
    model = UrlModel(None, suffixes, mean)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(UrlModel(None, others, mean).with_suffixes(known, ["fold"]))
    ready = ready.select("features", "label")
    model.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=SEED).fit(ready)
    return model


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, most: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page."""
    model = train(pages, rules, most)
    rule, verdict = decided(rules)
    rows = model.verdicts(parts(pages.select("page_id", "url")))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "guess").alias("verdict"))
