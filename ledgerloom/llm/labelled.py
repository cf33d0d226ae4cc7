"""A bounded sample of labelled documents for fitting a model on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tables import materialize

MOST_BYTES = 64 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, allowed: Column | None = None, most_bytes: int = MOST_BYTES) -> pa.Table:
    """Text and label of at most ``most`` labelled documents of at most ``most_bytes`` together, the same in every run.

    They are the least by a hash of the id; ids of equal hash follow their own order. Documents are taken whole
    in that order until the bytes are used up; one that is larger than all of them is passed over. Rows whose label or text is
    null take no part; a document labelled twice counts with its least label. Of an id with several texts the
    least text counts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if allowed is not None:
        known = known.filter(allowed)
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = materialize(known.groupBy("doc_id").agg(F.min(label).alias("label")).orderBy(*first).limit(most), "labelled")
    # ``most`` rows of two numbers: a proven bound for the broadcast
    held = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    sizes = held.groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", F.octet_length("text").alias("bytes")).filter(F.col("bytes") <= most_bytes)
    # a running total over ``most`` short rows at most
    upto = Window.orderBy(*first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fitting = sizes.withColumn("total", F.sum("bytes").over(upto)).filter(F.col("total") <= most_bytes).select("doc_id")
    kept = held.join(F.broadcast(fitting), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return kept.orderBy("doc_id").toArrow()
