"""Adapter views: the driver tables seen as tracks, spots, pixels, reads, windows, SNPs, sequences, assays.

Each view is SQL with tables in braces. Where Spark and DuckDB write a thing differently, the two texts are given.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_TRACK = """
SELECT user_id AS track, event_id AS spot, frame, floor(value * 10) / 100.0D0 AS x, (k + (event_id % 97) / 97.0D0) / 10.0D0 AS y,
       CAST(event_id % 4 AS BIGINT) AS cell, event_type AS fov, value, k
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
             CAST(row_number() OVER w + sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS frame FROM {events}
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS e
"""
_READ = """
SELECT {0} AS read, qname, contig, start0, end0, reverse, mapq, sample, supp
FROM (SELECT l_orderkey AS qname, l_returnflag AS contig, l_partkey * 10 AS start0, l_partkey * 10 + CAST(l_quantity AS BIGINT) AS end0,
             l_linenumber % 2 = 1 AS reverse, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS mapq, l_linestatus AS sample, CAST(l_suppkey AS BIGINT) AS supp,
             md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(floor(l_quantity * 100) AS BIGINT), CAST(floor(l_extendedprice * 100) AS BIGINT),
                 CAST(floor(l_discount * 1000) AS BIGINT), CAST(floor(l_tax * 1000) AS BIGINT), l_returnflag, l_linestatus, CAST(l_shipdate AS DATE))) AS h FROM {{lineitem}}) AS r
"""
_WINDOW = """
SELECT p_partkey AS probe, CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS contig, p_partkey * 10 AS start1,
       p_partkey * 10 + p_size AS end1, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(p_size AS BIGINT) AS size, p_brand AS gene, p_type AS kind, p_retailprice AS price
FROM {part}
"""
_SNP = """
SELECT CASE s_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS contig, s_suppkey * 97 AS pos, s_suppkey AS snp,
       concat(substr('ACGT', CAST(s_suppkey % 4 AS INT) + 1, 1), '|', substr('ACGT', CAST(s_suppkey % 3 AS INT) + 1, 1)) AS genotype
FROM {supplier}
"""
_ASSAY = """
SELECT o_orderkey AS id, o_orderpriority AS Condition, substr(o_orderpriority, 3) AS Base, CAST(month(o_orderdate) AS BIGINT) AS Date, o_totalprice / 1000.0D0 AS value,
       o_orderstatus AS status, o_custkey AS cust, concat('rep', CAST(o_custkey % 5 AS STRING)) AS file
FROM {orders}
"""
_EXPR = "SELECT l_suppkey AS cell, l_partkey AS gene, CAST(l_quantity AS BIGINT) AS count FROM {lineitem}"
_META = "SELECT event_id, props AS json, event_type, value FROM {events}"

#: name: (Spark text, DuckDB text)
_SPOT = "SELECT vec_id AS spot, CAST(label AS BIGINT) AS fov, CAST(label AS BIGINT) + 1 AS nucleus, CAST(vec_id % 3 AS BIGINT) AS channel, CAST({0} AS DOUBLE) * 100 AS x, CAST({1} AS DOUBLE) * 100 AS y FROM {{embeddings}}"
_PIXEL = "SELECT fov, frame, label, CAST(p % 8 AS BIGINT) AS x, CAST(floor(p / 8) AS BIGINT) AS y, CAST(floor(v * 1000) AS BIGINT) AS value FROM ({0}) AS p"
_SEQ = "SELECT doc_id AS read, fov, source, s AS seq FROM (SELECT doc_id, lang AS fov, source, translate(lower(regexp_replace(text, '[^A-Za-z]', ''{0})), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM {{documents}}) AS q WHERE length(s) >= 26"
VIEWS = {
    "v_track": (_TRACK, _TRACK),
    "v_read": (_READ.format("CAST(conv(substr(h, 1, 15), 16, 10) AS BIGINT)"), _READ.format("CAST(concat('0x', substr(h, 1, 15)) AS BIGINT)")),
    "v_window": (_WINDOW, _WINDOW),
    "v_snp": (_SNP, _SNP),
    "v_assay": (_ASSAY, _ASSAY),
    "v_expr": (_EXPR, _EXPR),
    "v_meta": (_META, _META),
    "v_spot": (_SPOT.format("element_at(embedding, 1)", "element_at(embedding, 2)"), _SPOT.format("embedding[1]", "embedding[2]")),
    "v_pixel": (
        _PIXEL.format("SELECT CAST(label AS BIGINT) AS fov, vec_id AS frame, CAST(label AS BIGINT) + 1 AS label, pos AS p, CAST(col AS DOUBLE) AS v FROM (SELECT label, vec_id, posexplode(embedding) FROM {embeddings}) AS e"),
        _PIXEL.format("SELECT CAST(label AS BIGINT) AS fov, vec_id AS frame, CAST(label AS BIGINT) + 1 AS label, generate_subscripts(embedding, 1) - 1 AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM {embeddings}"),
    ),
    "v_seq": (_SEQ.format(""), _SEQ.format(", 'g'")),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Data:
    """Tables and views of one folder, read when asked for: d.orders, d.v_track."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = VIEWS[name][0].replace(".0D0", ".0D")
            used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
            return self.spark.sql(text, **used)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def sql(self):
        return self.spark.sql


def duck(sql: str, rounded: str = "") -> str:
    """A query over views as one DuckDB text; the named double columns are rounded to six places."""
    views = []
    for name, (_, text) in VIEWS.items():
        if name in sql:
            for t in TABLES:
                text = text.replace("{" + t + "}", t)
            views.append(f"{name} AS ({text.replace('.0D0', '.0::DOUBLE').replace('AS STRING', 'AS VARCHAR').strip()})")
    pick = "*" if not rounded else "* REPLACE (" + ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0::DOUBLE AS {c}" for c in rounded.split()) + ")"
    return (f"WITH {', '.join(views)} " if views else "") + f"SELECT {pick} FROM ({sql.strip()}) AS q"
