"""The driver's contract: queries against their SQL on the smallest tables, and a stream."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexaudit.streaming.ingest import stream_findings

DATA = "/root/testdata/sf0.001"
CHECKED = ["case_variants", "hyphenation_aug", "identifier_styles_aug", "glossary_hits_aug", "fuzzy_s1", "candidate_phrases", "cosine_pairs", "finding_contexts", "audit_zones", "audit_callouts", "audit_length_rules", "audit_citations", "audit_issues", "audit_verification"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda df: sorted(map(tuple, df[cols].astype(str).to_numpy().tolist()))
    assert key(got) == key(want)
    assert len(got) or name == "cosine_pairs"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "Send an e-mail, an email.")], "doc_id long, text string").write.parquet(str(source))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(source))
    for _ in range(2):  # a second run finds nothing new
        stream_findings(docs, str(tmp_path / "out"), str(tmp_path / "state"), checks={"hyphenation"}).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_letters_plan_reads_tables(spark):
    """The steps of a letter are tables: what is planned last is small and computes none of them anew."""
    letters = entry.queries()["audit_letters"](spark, DATA)
    plan = letters._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and not any(x in plan for x in ("InMemoryRelation", "Join", "Aggregate", "Window"))
    assert letters.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
