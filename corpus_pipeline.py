"""Documents to training pieces: toxic ones go, near copies go, personal data is masked, sources are mixed, texts are segmented.

Every stage takes what the stage before it kept and returns the columns of ``documents``, but for the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, ngram_join, pii, sentencepieces, toxicity
from ledgerloom.llm.queries import PIECE_MODEL
from ledgerloom.llm.tables import materialize, read, small


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity the ordinal model does not reject. It is fitted on the labelled ones of ``documents``."""
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked documents: the one of least id. Rows with a null id stay."""
    found = materialize(ngram_join.ngram_components(docs).select("doc_id", "component_id"), "near-copies")
    gone = materialize(found.filter("doc_id <> component_id").select("doc_id").distinct(), "near-copies-gone")
    left = docs.join(small(gone), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    repeated = materialize(found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "near-copies-ids")
    if repeated.isEmpty():
        return left
    twice = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(repeated, "doc_id", "left_anti").unionByName(twice).select(*[f"`{c}`" for c in docs.columns])


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets; ``n_chars`` follows the text."""
    masked = pii.redacted(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix, each as often as it is taken."""
    return mixing.mixed(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    """Piece ids of every row with score and the second best path, beside its id, language and source."""
    return sentencepieces.encoded(
        docs, sentencepieces.vocabulary(model_path), ["doc_id", "lang", "source"], n_best=2, add=["ids", "n_pieces", "score", "alternatives"]
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("sentencepieces", segment),
]

# Fitted models and hashes take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
