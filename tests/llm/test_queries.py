"""The operators' registered queries against their SQL."""

import pytest

from quillon.llm import queries
from tests.compare import connect, rows


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in queries.ORACLE:
        assert rows(got) == rows(connect(sf).sql(queries.ORACLE[name]).df())


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.01


def test_held_out_language_model(spark):
    got = queries.op4_lm(spark, "/root/testdata/sf0.01").filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_edited_texts_are_nearer_than_the_next(spark, sf):
    got = queries.op1_fingerprints(spark, sf).filter("n_chars > 100").toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.98


#: Queries that SQL can't express, with the test that holds them against brute force, the library or held-out rows.
TESTED = {
    "op1_fingerprints": "test_small_tables.py::test_edited_text_by_brute_force",
    "op4_lm": "test_small_tables.py::test_lm_score_by_exact_counts",
    "op5_secrets": "test_small_tables.py::test_secret_report_by_brute_force",
    "op6_toxicity": "test_small_tables.py::test_lexicon_by_counting",
    "op8_bpe": "test_small_tables.py::test_bpe_round_trip_and_library",
    "op9_simhash": "test_small_tables.py::test_simhash_by_brute_force",
    "op10_urls": "test_small_tables.py::test_url_verdicts_by_brute_force",
    "op12_tokencounts": "test_counted_tables.py::test_counts_are_the_librarys",
    "pipeline": "test_pipeline.py::test_near_duplicate_stage",
}


def test_queries_without_sql_have_a_test_of_their_own():
    import pathlib

    assert TESTED.keys() == queries.QUERIES.keys() - queries.ORACLE.keys()
    for name, where in TESTED.items():
        file, _, test = where.partition("::")
        assert f"def {test}(" in (pathlib.Path(__file__).parent / file).read_text(), name
