"""The pipeline's stages, each held against its own rule, and oracle SQL of the operators."""

import duckdb
import pytest

import corpus_pipeline
from heapspark.llm import neardup, quality, secrets
from heapspark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], sf).cache())
        assert steps[-1].columns == docs.columns
    kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    assert {r["doc_id"] for r in steps[1].collect()} == kept
    assert {r["doc_id"] for r in steps[2].collect()} == kept
    first = {r["doc_id"] for r in neardup.near_duplicates(steps[2]).where("kept").collect()}
    assert {r["doc_id"] for r in steps[3].collect()} == first
    left = secrets.digest(steps[4]).selectExpr("sum(n_assign + n_access + n_hex) n").first()["n"]
    assert not left
    out = corpus_pipeline.run(spark, sf)
    tokens = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r["doc_id"] for r in tokens} == first and all(r["sum(length)"] == r["max(doc_tokens)"] for r in tokens)


def test_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
