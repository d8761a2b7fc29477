"""The queries of the operators and of the pipeline, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, fingerprints, lines, lm, mixing, resampling, secrets, simhash, spelling, tokencounts, topk, toxicity, urls
from quillon.llm.common import table

VOCABULARY, COUNTED = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, "vec_id % 50 = 0", 5)


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumns({"uid": F.monotonically_increasing_id(), "held_out": lm.held_out()})
    scores = lm.score(docs.select("uid", "text"), docs.filter(~F.col("held_out")).select("text"))
    return docs.select("uid", "doc_id", "held_out").join(scores, "uid").drop("uid")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.strip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=64, distance=2)


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.counts(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNTED))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_mixing,
        op3_topk,
        op4_lm,
        op5_secrets,
        op6_toxicity,
        op7_lines,
        op8_bpe,
        op9_simhash,
        op10_urls,
        op11_spelling,
        op12_tokencounts,
        op13_resampling,
        pipeline,
    )
}

_OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(concat('0x', substr(md5(concat('17:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 15)) AS BIGINT) AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT source, source_size, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
         CAST(sum(source_size) OVER () AS DOUBLE) AS everything FROM w),
l AS (SELECT *, (everything - full_before) / weight_left AS level, cap / weight <= (everything - full_before) / weight_left AS is_full FROM r),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE max(CASE WHEN NOT is_full THEN level END) OVER () * weight END AS target FROM l),
m AS (SELECT z.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM sized z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(reps AS BIGINT) AS repetitions, CAST(reps * size AS BIGINT) AS taken
FROM (SELECT *, whole + CASE WHEN size > 0 AND 2 * ahead + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END AS reps FROM m)
"""

_OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP7 = """
WITH l AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
blank AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS chars),
spread AS (SELECT line FROM l, blank WHERE trim(line, chars) <> '' GROUP BY line HAVING count(DISTINCT site) >= 10),
m AS (SELECT l.doc_id, l.line, l.i, s.line IS NOT NULL AS bad FROM l LEFT JOIN spread s ON l.line = s.line),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad), '') AS kept FROM m GROUP BY doc_id),
o AS (SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_bad, 0) AS n_bad, coalesce(kept, '') AS kept FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_bad AS BIGINT) AS n_removed, CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256 FROM o
"""

#: The table of the crc32 by its rule, and the crc32 of a text's UTF-8 bytes, for SQL that has none.
_CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM range(256) t(i))"""


def _crc(text: str) -> str:
    at_byte = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: CAST(concat('0x', substr(hex({text}), i, 2)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {at_byte}), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP11 = rf"""
WITH RECURSIVE {_CRC_TABLE.strip()},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), {_AZ}) AS run
  FROM documents),
hashed AS (
  SELECT run, k, {_crc("key")} AS h
  FROM (SELECT run, concat(doc, ':', run) AS key, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY doc, run), crc_table),
cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
less AS (
  SELECT DISTINCT word, i, concat(substr(word, 1, i), substr(word, i + 2)) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT x.word AS a, y.word AS b FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word FROM words x JOIN less y ON x.word = y.rest
  UNION SELECT y.word, x.word FROM words x JOIN less y ON x.word = y.rest),
near AS (
  SELECT a AS word, count(*) AS n_near, max(w.n) AS best, arg_min(b, (-w.n, b)) AS form
  FROM pairs JOIN words w ON pairs.b = w.word GROUP BY a),
forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 10 * n THEN form END AS form, CASE WHEN best >= 10 * n THEN best END AS form_n
  FROM words LEFT JOIN near ON words.word = near.word),
steps AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN forms f ON s.next = f.word)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms f JOIN steps s ON f.word = s.word WHERE s.next IS NULL
"""


_OP13 = rf"""
WITH {_CRC_TABLE.strip()},
words AS (
  SELECT kind, id, row, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM (SELECT 's' AS kind, doc_id AS id, row_number() OVER () AS row, text FROM documents UNION ALL SELECT 't', NULL, NULL, text FROM benchmark)),
buckets AS (SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM words), crc_table),
placed AS (SELECT kind, id, row, bucket FROM words JOIN buckets ON words.word = buckets.word),
totals AS (SELECT bucket, CAST(count(*) FILTER (kind = 's') AS DOUBLE) AS s, CAST(count(*) FILTER (kind = 't') AS DOUBLE) AS t FROM placed GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM totals),
rows AS (SELECT doc_id, row_number() OVER () AS row FROM documents),
docs AS (SELECT row, count(*) AS n, sum(gain) AS weight FROM placed JOIN gains ON placed.bucket = gains.bucket WHERE kind = 's' GROUP BY row),
scored AS (
  SELECT doc_id, rows.row, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('2024:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 8)) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS noise
  FROM rows LEFT JOIN docs ON rows.row = docs.row),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST, row) AS place, count(*) FILTER (n_features >= 20) OVER () AS n_long
  FROM scored)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_features >= 20 AND place <= 10 * n_long // 100 THEN place END AS rank FROM ranked
"""

ORACLE = {"op2_mixing": _OP2, "op3_topk": _OP3, "op7_lines": _OP7, "op11_spelling": _OP11, "op13_resampling": _OP13}
