"""The pipeline's stages over nulls, repeats, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    found = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").limit(60)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where(F.size(F.split("text", " ")) > 12).first()["text"]
    odd = spark.createDataFrame([(None, "one row without an id", "en", "a"), (None, "and quite another one here", None, None), (None, "and quite another one here", None, None), (1, f"a row of a used id. {item}", "en", "a"), (900, None, None, None), (901, "", "en", None)], "doc_id long, text string, lang string, source string")
    both = found.unionByName(odd)
    return both.selectExpr("*", "7 AS shard", "'x' AS position", "lang AS row_key", "1 AS toxicity", "2 AS key", "3 AS `group`", "map('a', 1) AS more").cache()


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES[:-1]])
def test_columns_stay_and_nothing_is_made_up(spark, docs, stage):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = lambda df: {tuple(r)[:8] for r in df.drop("more").collect()}
    assert rows(out) <= rows(docs)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_decisions_are_for_rows(spark, docs):
    left = pipeline.drop_contaminated(spark, docs, SF)
    assert left.where("doc_id IS NULL").count() == 3 and left.where("doc_id = 1 AND text LIKE 'a row of a used id.%'").count() == 0
    assert left.where("doc_id = 1").count() == docs.where("doc_id = 1").count() - 1
    left = pipeline.drop_near_copies(spark, docs, SF)
    assert left.where("doc_id IS NULL").count() == 2 and left.where("doc_id IN (900, 901)").count() == 1


def test_last_stage(spark, docs):
    assert pipeline.write_tokens(spark, docs, SF).count() == docs.count()
    assert pipeline.write_tokens(spark, docs.limit(0), SF).count() == 0
