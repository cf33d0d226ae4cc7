"""The pipeline and every registered query of this part over the smallest tables."""

from pathlib import Path

import pytest
import test_joins
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import mixing, pii, queries, sentencepieces

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are not here")


def columns_and_rows(df):
    names = sorted(df.columns)
    return names, sorted(str([r[n] for n in names]) for r in df.collect())


@pytest.mark.parametrize("name", queries.ORACLES)
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    engine = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = engine.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    expected = sorted(str([row[names.index(n)] for n in sorted(names)]) for row in result.fetchall())
    assert columns_and_rows(queries.QUERIES[name](spark, str(FOLDER))) == (sorted(names), expected)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_queries_cover_all_documents(spark, name):
    ids = [r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in queries.QUERIES[name](spark, str(FOLDER)).collect()) == sorted(ids)


@pytest.mark.parametrize("name", ["op2_balanced_shards", "op3_pii", "op5_mixing", "op8_secrets"])
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_stages(spark):
    """Each stage on what the one before it kept, against plain code."""
    folder = str(FOLDER)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.materialize(stage(spark, frames[-1], folder), "stage"))
    assert all(f.columns == docs.columns for f in frames[:-1])
    toxic = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic = 1").select("doc_id")
    assert frames[1].join(toxic, "doc_id").count() == 0 and frames[1].count() > 0.8 * docs.count()
    data = [(r["doc_id"], r["text"], r["source"]) for r in frames[1].collect()]
    expected = sorted(d for d, _, c in test_joins.near_components(data) if d == c)
    assert sorted(r["doc_id"] for r in frames[2].collect()) == expected
    left = pii.with_pii(frames[3]).agg(F.sum(F.size("pii_spans"))).first()[0]
    assert left == 0 and frames[3].count() == frames[2].count()
    assert frames[3].filter("n_chars <> char_length(text)").count() == 0
    taken = mixing.mix(frames[3]).agg(F.sum("taken")).first()[0]
    assert frames[4].agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == taken
    back = sentencepieces.decoded(frames[5], sentencepieces.vocabulary(queries.PIECE_MODEL), ["doc_id"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, frames[4].select("doc_id", "text").collect()))
