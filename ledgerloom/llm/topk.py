"""Exact top-k by inner product in three phases with a uniform threshold.

A vector's components are dealt to ``SHARES`` shares, so a score is the sum of its shares' partial scores;
each share of each block of candidates is one node of the search.

1. Every node sends the k best partial scores of every query. Their vectors are resolved exactly; the k-th
   best of these scores is a safe lower bound for the query.
2. The bound, divided by the number of shares, goes out with the query blocks: a candidate whose score
   reaches the bound has a partial score of at least that in one share. Nodes send the ids that do.
3. These are resolved exactly and ranked.

Equal vectors are searched once, with their k + 1 least ids: no more can be among the k best of a query.
Queries meet candidates in blocks of bounded size; the queries are a stated set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tables import materialize
from ledgerloom.llm.vectors import matrix, packed, selected

SHARES = 2
CANDIDATE_NUMBERS = 1 << 19  # numbers of one block of candidates
QUERY_ROWS = 512


def _codes(levels: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrix(batch, "v"):
                codes = np.floor(x * levels)
                yield pa.record_batch([batch.column("id").take(pa.array(rows)), packed(codes)], names=["id", "codes"])

    return run


def _shares(width: int, shares: int) -> list[tuple[int, int]]:
    cuts = [width * s // shares for s in range(shares + 1)]
    return list(zip(cuts, cuts[1:]))


def _pack(shares: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """A block of vectors of one width as one row for each share."""
        frame = frame.sort_values("id")
        x = np.frombuffer(b"".join(frame["codes"]), np.float64).reshape(len(frame), -1)
        ids = frame["id"].to_numpy().astype(np.int64).tobytes()
        rows = [(frame["width"].iloc[0], frame["block"].iloc[0], s, ids, np.ascontiguousarray(x[:, a:b]).tobytes()) for s, (a, b) in enumerate(_shares(x.shape[1], shares))]
        return pd.DataFrame(rows, columns=["width", "block", "share", "ids", "numbers"])

    return run


_PACKED = "width int, block int, share int, ids binary, numbers binary"


def _blocks(codes: DataFrame, rows_per_block: int, shares: int) -> DataFrame:
    total = codes.count()
    blocks = max(1, -(-total // rows_per_block))
    dealt = codes.withColumns({"width": (F.length("codes") / 8).cast("int"), "block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")})
    return dealt.groupBy("width", "block").applyInPandas(_pack(shares), _PACKED)


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    q, c = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.c_ids, np.int64)
    return q, c, np.frombuffer(row.q_numbers, np.float64).reshape(len(q), -1), np.frombuffer(row.c_numbers, np.float64).reshape(len(c), -1)


def _local_lists(k: int):
    """Of every node: the k best partial scores of each query, its own id aside."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                q, c, x, y = _unpack(row)
                partial = x @ y.T
                partial[q[:, None] == c[None, :]] = -np.inf
                best = np.argpartition(-partial, k - 1, axis=1)[:, :k] if len(c) > k else np.tile(np.arange(len(c)), (len(q), 1))
                yield pd.DataFrame({"query_id": np.repeat(q, best.shape[1]), "share": row.share, "vec_id": c[best.ravel()], "partial": np.take_along_axis(partial, best, axis=1).ravel()})

    return run


def _above_cutoff(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of every node: the ids whose partial score reaches the cutoff of the query."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            q, c, x, y = _unpack(row)
            cutoff = np.full(len(q), -np.inf)
            known = row.cutoffs or {}
            cutoff[:] = [known.get(int(i), -np.inf) for i in q]
            hit = (x @ y.T >= cutoff[:, None]) & (q[:, None] != c[None, :])
            i, j = np.nonzero(hit)
            yield pd.DataFrame({"query_id": q[i], "vec_id": c[j]})


def _resolve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        score = [float(np.frombuffer(a, np.float64) @ np.frombuffer(b, np.float64)) for a, b in zip(frame["q_codes"], frame["c_codes"])]
        yield pd.DataFrame({"query_id": frame["query_id"], "vec_id": frame["vec_id"], "score": np.array(score, dtype=np.float64)})


def _resolved(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    queries = codes.select(F.col("id").alias("query_id"), F.col("codes").alias("q_codes"))
    candidates = codes.select(F.col("id").alias("vec_id"), F.col("codes").alias("c_codes"))
    met = pairs.join(candidates, "vec_id").join(queries, "query_id").select("query_id", "vec_id", "q_codes", "c_codes")
    return met.mapInPandas(_resolve, "query_id long, vec_id long, score double")


def top_k(
    embeddings: DataFrame,
    is_query: Column,
    k: int = 5,
    levels: float = 256.0,
    shares: int = SHARES,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The k best of all other rows for every query: query_id, rank, vec_id, score; ties to the lesser vec_id.

    Components become floor(levels * x). ``is_query`` is a condition on the column ``id``. Vectors that
    are null, empty or hold null or non-finite numbers take no part; vectors of other lengths never meet.
    Rows that repeat an id count once, with their least vector. Fewer than k candidates give shorter lists.
    """
    codes = selected(embeddings, id_column, vector_column).mapInArrow(_codes(levels), "id long, codes binary")
    codes = materialize(codes.groupBy("id").agg(F.min("codes").alias("codes")), "topk-codes")
    width = (codes.agg(F.max(F.length("codes"))).first()[0] or 8) // 8
    # the k + 1 least ids of equal vectors; the limit is pushed below the shuffle
    alike = Window.partitionBy("codes").orderBy("id")
    candidates = materialize(codes.withColumn("nth", F.row_number().over(alike)).filter(F.col("nth") <= k + 1).drop("nth"), "topk-candidates")
    held = materialize(_blocks(candidates, max(k + 1, CANDIDATE_NUMBERS // width), shares), "topk-blocks")
    asked = materialize(_blocks(codes.filter(is_query), QUERY_ROWS, shares), "topk-queries")
    left = asked.select("width", "share", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("numbers").alias("q_numbers"))
    right = held.select("width", "share", F.col("block").alias("c_block"), F.col("ids").alias("c_ids"), F.col("numbers").alias("c_numbers"))
    # every query block goes to every candidate block of its width, by name of the block
    names = right.select("width", "share", "c_block").distinct()
    sent = left.join(names, ["width", "share"])
    nodes = sent.join(right, ["width", "share", "c_block"])
    lists = nodes.mapInPandas(_local_lists(k), "query_id long, share int, vec_id long, partial double").filter(F.col("partial") > float("-inf"))
    best = Window.partitionBy("query_id", "share").orderBy(F.desc("partial"), "vec_id")
    gathered = lists.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k).select("query_id", "vec_id").distinct()
    exact = _resolved(materialize(gathered, "topk-lists"), codes)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bounds = exact.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") == k).select("query_id", (F.col("score") / shares).alias("cutoff"))
    blocks = max(1, -(-codes.filter(is_query).count() // QUERY_ROWS))
    # QUERY_ROWS bounds the cutoffs of one block
    cutoffs = bounds.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("q_block")).agg(
        F.map_from_entries(F.collect_list(F.struct("query_id", "cutoff"))).alias("cutoffs")
    )
    cutoffs = materialize(cutoffs, "topk-cutoffs")
    sufficient = nodes.join(cutoffs, "q_block", "left").mapInPandas(_above_cutoff, "query_id long, vec_id long")
    sufficient = materialize(sufficient.distinct(), "topk-sufficient")
    ranked = _resolved(sufficient, codes).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))
