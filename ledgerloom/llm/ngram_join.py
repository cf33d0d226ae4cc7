"""Exact Jaccard self-join of documents on five-word shingles, as components of linked documents.

A document is the set of its distinct shingles; equal sets are one class and are joined once. Steps:

1. One scan gives every document its set size and a 64-bit class of its set, and counts shingles that
   repeat within a task's stretch of documents. The most frequent ones, at most ``FREQUENT``, get a rank.
2. Index lists by position: a set is ordered by (rank of frequency, hash); two sets with Jaccard at
   least t share one of their first n - ceil(t n) + 1 shingles. These go to lists with size and
   position. A list is cut into blocks of sizes within a factor t: blocks further apart than one are
   skipped, and within blocks the positions bound the overlap that is still possible. Lists of the
   frequent shingles are dealt to pairs of parts, so no task holds a long list.
3. Answers from a similar set: the set of least class in a list leads it. Every other one is compared
   with its leader first. What is linked to a leader has the leader's component as its answer; in lists
   that then still hold several components, only sets of different ones are compared with each other.
4. A pair must pass a bound from two bitmaps, half a byte to a byte for each shingle, before it is verified
   on the whole sets; in the second step lists are compared by bitmaps before any pair leaves them. Linked
   pairs are folded into components.

The order of shingles steers cost only; any order gives the same links. Classes and shingles are 64-bit
hashes: among a billion distinct sets a false match of two has a chance of about three in a hundred.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.graph import components
from ledgerloom.llm.tables import materialize, materialize_wide, small
from ledgerloom.llm.textops import MULTIPLIER, U64, Hasher, mix, pieces, shingles, signed, words

PERCENT = 80
SHINGLE = 5
FREQUENT = 1 << 18  # ranked shingles: 4 MB sent to every task, whatever the input
STRETCH = 2_000_000  # shingles that a task counts at a time
PART_ROWS = 4_000  # rows of a frequent shingle's list in one part
LIST_ROWS = 500_000  # target rows of a bucket of lists


def set_class(tokens: np.ndarray) -> np.uint64:
    """Hash of a set of shingles that does not depend on their order."""
    with np.errstate(over="ignore"):
        folded = mix(tokens).sum(dtype=U64) ^ mix(tokens * U64(MULTIPLIER) + U64(1)).sum(dtype=U64)
        return mix(np.array([folded * U64(MULTIPLIER) + U64(len(tokens))], dtype=U64))[0]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def _repeats(held: list[np.ndarray]) -> pa.RecordBatch | None:
    token, count = np.unique(np.concatenate(held), return_counts=True)
    token, count = token[count > 1], count[count > 1]
    if not len(token):
        return None
    none = pa.nulls(len(token), pa.int64())
    bits = pa.nulls(len(token), pa.binary())
    return pa.record_batch([none, none, none, bits, pa.array(signed(token)), pa.array(count.astype(np.int64))], names=_SCAN_NAMES)


_SCAN_NAMES = ["doc_id", "n", "cls", "bits", "token", "count"]


def bitmap(tokens: np.ndarray) -> bytes:
    """Which cells of a set's shingles are taken; four to eight cells for each shingle."""
    cells = max(64, 1 << (4 * len(tokens) - 1).bit_length())
    taken = np.zeros(cells, bool)
    taken[(tokens >> U64(20) & U64(cells - 1)).astype(np.int64)] = True
    return np.packbits(taken, bitorder="little").tobytes()


def may_link(na: int, nb: int, a: bytes, b: bytes) -> bool:
    """Whether two sets can be linked: a cell that only one has holds a shingle that the other lacks."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    least = -(-PERCENT * (na + nb) // (100 + PERCENT))
    common = x & y
    only_a, only_b = np.bitwise_count(x ^ common).sum(), np.bitwise_count(y ^ common).sum()
    return bool(na - only_a >= least and nb - only_b >= least)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document with its set size and class, and rows of repeated shingles with their counts."""
    held, rows, hasher = [], 0, Hasher()
    for batch in batches:
        for piece, data, offsets in pieces(batch, "text"):
            sizes, classes = np.zeros(piece.num_rows, np.int64), np.zeros(piece.num_rows, U64)
            bits: list[bytes | None] = [None] * piece.num_rows
            for r, tokens in shingles(words(data, offsets, hasher), SHINGLE):
                sizes[r] = len(tokens)
                if not len(tokens):
                    continue
                classes[r], bits[r] = set_class(tokens), bitmap(tokens)
                held.append(tokens)
                rows += len(tokens)
            none = pa.nulls(piece.num_rows, pa.int64())
            cls = pa.array(classes.view(np.int64), mask=sizes == 0)
            yield pa.record_batch([piece.column("doc_id").cast(pa.int64()), pa.array(sizes), cls, pa.array(bits, pa.binary()), none, none], names=_SCAN_NAMES)
            if rows >= STRETCH:
                if (found := _repeats(held)) is not None:
                    yield found
                held, rows = [], 0
    if held and (found := _repeats(held)) is not None:
        yield found


class Order:
    """Frequent shingles with their counts; the others count as rare."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        place = np.argsort(tokens)
        self.tokens, self.counts = tokens[place], counts[place]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.tokens & U64((1 << 20) - 1)).astype(np.int64)] = True

    def of(self, tokens: np.ndarray) -> np.ndarray:
        found = np.zeros(len(tokens), dtype=np.int64)
        ask = np.flatnonzero(self.maybe[(tokens & U64((1 << 20) - 1)).astype(np.int64)])
        if len(ask) and len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens[ask]), len(self.tokens) - 1)
            hit = self.tokens[at] == tokens[ask]
            found[ask[hit]] = self.counts[at[hit]]
        return found


def _order(repeats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of the corpus, as many as ``FREQUENT`` holds, chosen by a histogram of counts."""
    counts = materialize(repeats.groupBy("token").agg(F.sum("count").alias("count")).filter("count >= 4"), "ngram-counts")
    level = F.floor(F.log2("count") * 8).cast("int").alias("level")
    histogram = sorted(((r["level"], r["n"]) for r in counts.groupBy(level).agg(F.count("*").alias("n")).collect()), reverse=True)  # a few hundred rows
    least, total = None, 0
    for at, n in histogram:
        if total + n > FREQUENT:
            break
        least, total = at, total + n
    if least is None:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    table = counts.filter(F.floor(F.log2("count") * 8) >= least).toArrow()  # FREQUENT rows at most
    token = table["token"].to_numpy().astype(np.int64)
    return token.view(U64), table["count"].to_numpy().astype(np.int64)


def _size_block(n: np.ndarray) -> np.ndarray:
    """Block of a set size; sizes of sets that can be linked are in the same or in neighbouring blocks."""
    return np.floor(np.log(n) / -math.log(PERCENT / 100) + 1e-9).astype(np.int64)


_ENTRY = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("token", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _entries(order, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Order(*order.value)  # plain arrays travel; the class comes with the function
        seen: set[int] = set()
        hasher = Hasher()
        for batch in batches:
            for _, data, offsets in pieces(batch, "text"):
                columns: list[tuple] = []
                for _, tokens in shingles(words(data, offsets, hasher), SHINGLE):
                    if not len(tokens):
                        continue
                    cls = set_class(tokens)
                    if cls in seen:
                        continue
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(cls)
                    counts = known.of(tokens)
                    p = prefix_length(len(tokens))
                    place = np.argsort(counts, kind="stable")[:p]
                    columns.append((tokens[place], counts[place], np.full(p, cls, U64), np.full(p, len(tokens), np.int32), np.arange(p, dtype=np.int32)))
                if columns:
                    token, count, cls, n, pos = (np.concatenate(c) for c in zip(*columns))
                    yield from _dealt(token, count, cls, n, pos, buckets)

    return run


def _dealt(token, count, cls, n, pos, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries with their bucket. A long list is dealt to every pair of its parts, each entry to the pairs of its own."""
    parts = count // PART_ROWS + 1
    own = (mix(cls ^ token) % parts.astype(U64)).astype(np.int64)
    short = parts == 1
    part = np.zeros(len(token), np.int64)
    where = [np.flatnonzero(short)]
    keys = [part[short]]
    for s in np.unique(parts[~short]):
        at = np.flatnonzero(parts == s)
        for other in range(int(s)):
            low, high = np.minimum(own[at], other), np.maximum(own[at], other)
            where.append(at)
            keys.append(low * int(s) + high + 1)
    at, key = np.concatenate(where), np.concatenate(keys)
    bucket = (mix(token[at] + key.astype(U64) * U64(MULTIPLIER)) % U64(buckets)).astype(np.int32)
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket), pa.array(key), pa.array(signed(token[at])), pa.array(signed(cls[at])), pa.array(n[at]), pa.array(pos[at])], schema=_ENTRY
    )


def _possible(na, nb, pa_, pb) -> np.ndarray:
    """Whether sets of these sizes that share a shingle at these positions, and none before, can be linked."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    most = 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
    return (100 * small >= PERCENT * large) & (most * (100 + PERCENT) >= PERCENT * (na + nb))


def _runs(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of equal stretches of sorted keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)


def _leaders(frame: pa.Table) -> pa.Table:
    """Of one bucket of lists: pairs of each list's leader and its other sets, and the entries of lists of three or more.

    A pair of sets is one row however many lists hold it. A list of two needs no second step.
    """
    part, token, cls, n, pos = (frame[c].to_numpy() for c in ("part", "token", "cls", "n", "pos"))
    place = np.lexsort((cls, token, part))
    part, token, cls, n, pos = part[place], token[place], cls[place], n[place], pos[place]
    first = np.ones(len(cls), bool)  # a class that came from two tasks is one entry
    first[1:] = (cls[1:] != cls[:-1]) | (token[1:] != token[:-1]) | (part[1:] != part[:-1])
    part, token, cls, n, pos = part[first], token[first], cls[first], n[first], pos[first]
    starts, ends = _runs([part, token])
    length = ends - starts
    lead = np.repeat(starts, length)
    pair = (np.arange(len(cls)) != lead) & _possible(n[lead], n, pos[lead], pos)
    pairs = np.unique(np.stack([cls[lead[pair]], cls[pair]], axis=1), axis=0) if pair.any() else np.zeros((0, 2), np.int64)
    long = np.repeat(length > 2, length)
    k, m = len(pairs), int(long.sum())
    number = np.repeat(np.arange(1, len(starts) + 1), length)[long]  # from 1: pairs have 0
    bucket = frame["bucket"].to_numpy()[:1]
    return pa.table(
        {
            "a": pa.array(np.concatenate([pairs[:, 0], np.zeros(m, np.int64)])),
            "b": pa.array(np.concatenate([pairs[:, 1], cls[long]])),
            "bucket": pa.array(np.full(k + m, bucket[0] if len(bucket) else 0, np.int32)),
            "list": pa.array(np.concatenate([np.zeros(k, np.int64), number])),
            "n": pa.array(np.concatenate([np.zeros(k, np.int32), n[long]])),
            "pos": pa.array(np.concatenate([np.zeros(k, np.int32), pos[long]])),
        }
    )


def _pair_table(found: list[np.ndarray]) -> pa.Table:
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


class Bitmaps:
    """Bitmaps of the sets of one list by width, each with its fold to half the width."""

    def __init__(self, values: list[bytes]):
        self.width = np.array([len(v) for v in values])
        self.place = np.zeros(len(values), np.int64)
        self.own, self.folded = {}, {}
        for w in np.unique(self.width):
            rows = np.flatnonzero(self.width == w)
            self.place[rows] = np.arange(len(rows))
            self.own[w] = np.frombuffer(b"".join([values[r] for r in rows]), np.uint8).reshape(len(rows), w)
            self.folded[w] = self.own[w][:, : w // 2] | self.own[w][:, w // 2 :]

    def may_link(self, n: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
        """Which of the sets ``j`` can be linked to set ``i``; of widths more than twofold apart none is ruled out."""
        ok, wi = np.ones(len(j), bool), self.width[i]
        for w in np.unique(self.width[j]):
            at = np.flatnonzero(self.width[j] == w)
            rows = self.place[j[at]]
            if w == wi:
                x, y = self.own[w][self.place[i]], self.own[w][rows]
            elif w == 2 * wi:
                x, y = self.own[wi][self.place[i]], self.folded[w][rows]
            elif wi == 2 * w:
                x, y = self.folded[wi][self.place[i]], self.own[w][rows]
            else:
                continue
            common = x & y
            least = -(-PERCENT * (n[i] + n[j[at]]) // (100 + PERCENT))
            only_x = np.bitwise_count(x ^ common).sum(axis=1)
            only_y = np.bitwise_count(y ^ common).sum(axis=1)
            ok[at] = (n[i] - only_x >= least) & (n[j[at]] - only_y >= least)
        return ok


def _across(frame: pa.Table) -> pa.Table:
    """Of one bucket: pairs of sets of a list that are in different components, neighbouring size blocks only."""
    number, cls, n, pos, comp = (frame[c].to_numpy() for c in ("list", "b", "n", "pos", "component"))
    bits = frame["bits"].to_pylist()
    n = n.astype(np.int64)
    block = _size_block(n)
    place = np.lexsort((block, number))
    number, cls, n, pos, comp, block = (x[place] for x in (number, cls, n, pos, comp, block))
    starts, ends = _runs([number]) if len(number) else (np.zeros(0, int),) * 2
    found = []
    for s, e in zip(starts, ends):
        if e - s < 2 or (comp[s:e] == comp[s]).all():
            continue
        maps = Bitmaps([bits[p] for p in place[s:e]])
        last = np.searchsorted(block[s:e], block[s:e] + 2) + s  # blocks beyond the next one are skipped
        for i in range(s, e - 1):
            j = np.arange(i + 1, last[i - s])
            j = j[(comp[j] != comp[i]) & _possible(n[i], n[j], pos[i], pos[j])]
            if len(j):
                j = j[maps.may_link(n[s:e], i - s, j - s)]
            if len(j):
                found.append(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], axis=1))
    return _pair_table(found)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for _, data, offsets in pieces(batch, "text"):
            packed = [(int(signed(np.array([set_class(t)], U64))[0]), t.tobytes()) for _, t in shingles(words(data, offsets, hasher), SHINGLE) if len(t)]
            if packed:
                cls, tokens = zip(*packed)
                yield pa.record_batch([pa.array(cls, pa.int64()), pa.array(tokens, pa.binary())], names=["cls", "tokens"])


def _plausible(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        ok = [may_link(*row) for row in zip(frame["na"], frame["nb"], frame["bits_a"], frame["bits_b"])]
        yield frame.loc[ok, ["a", "b"]] if ok else frame[["a", "b"]]


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        linked = []
        for x, y in zip(frame["ta"], frame["tb"]):
            s, t = np.frombuffer(x, U64), np.frombuffer(y, U64)
            both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
            linked.append(100 * both >= PERCENT * (len(s) + len(t) - both))
        yield frame.loc[linked, ["a", "b"]] if linked else frame[["a", "b"]]


def _wanted(pairs: DataFrame, representatives: DataFrame) -> DataFrame:
    """Class and one document of every set that takes part in a pair."""
    classes = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    return materialize(representatives.join(classes, "cls", "left_semi").select("cls", "doc_id"), "ngram-wanted")


def _bitmaps(wanted: DataFrame, scanned: DataFrame) -> DataFrame:
    maps = scanned.join(small(wanted), ["cls", "doc_id"], "left_semi").select("cls", "n", "bits").dropDuplicates(["cls"])
    return materialize(maps, "ngram-bits")


def _plausible_pairs(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """Those of the pairs of classes that their bitmaps do not rule out."""
    left = maps.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    right = maps.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "bits_a", "bits_b")
    return materialize_wide(met.mapInPandas(_plausible, "a long, b long"), "ngram-plausible")


def _linked(pairs: DataFrame, docs: DataFrame, representatives: DataFrame) -> DataFrame:
    """Those of the pairs of classes whose whole sets are similar enough."""
    ids = small(_wanted(pairs, representatives).select("doc_id").distinct())
    texts = docs.join(ids, "doc_id", "left_semi").select("text")
    sets = materialize_wide(texts.mapInArrow(_sets, "cls long, tokens binary").dropDuplicates(["cls"]), "ngram-sets")
    left = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb"))
    return materialize_wide(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInPandas(_verify, "a long, b long"), "ngram-links")


def ngram_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Set size and component of every row: doc_id, n_shingles, component_id.

    Rows with Jaccard of 0.8 or more are linked; the component is the least id reachable. A null or empty
    text, or one of white space, has an empty set, no link and itself as component. Repeated rows are
    linked like any others; rows with a null id count in no component but get the id of theirs. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    scanned = materialize_wide(texts.mapInArrow(_scan, "doc_id long, n long, cls long, bits binary, token long, count long"), "ngram-scan")
    documents = scanned.filter("token IS NULL").select("doc_id", "n", "cls", "bits")
    rows = documents.drop("bits")
    order = spark.sparkContext.broadcast(_order(scanned.filter("token IS NOT NULL").select("token", "count")))
    volume = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), volume // LIST_ROWS)
    representatives = rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    entries = texts.mapInArrow(_entries(order, int(buckets)), "bucket int, part long, token long, cls long, n int, pos int")
    lists = materialize_wide(
        entries.groupBy("bucket").applyInArrow(_leaders, "a long, b long, bucket int, list long, n int, pos int"), "ngram-lists"
    )
    first = materialize(lists.filter("list = 0").select("a", "b").distinct(), "ngram-pairs")
    first = _plausible_pairs(first, _bitmaps(_wanted(first, representatives), documents))
    links = _linked(first, texts, representatives)
    answers = components(links).select(F.col("node").alias("b"), "component")
    entries = lists.filter("list > 0").select("bucket", "list", "b", "n", "pos")
    entries = entries.join(answers, "b", "left").withColumn("component", F.coalesce("component", "b"))
    several = entries.groupBy("bucket", "list").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most")
    entries = materialize(entries.join(several, ["bucket", "list"], "left_semi"), "ngram-open")
    maps = _bitmaps(_wanted(entries.select(F.col("b").alias("a"), "b"), representatives), documents).select(F.col("cls").alias("b"), "bits")
    pairs = entries.join(maps, "b").select("bucket", "list", "b", "n", "pos", "component", "bits").groupBy("bucket").applyInArrow(_across, "a long, b long")
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize_wide(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "ngram-pairs")
    links = links.unionByName(_linked(pairs, texts, representatives))
    comps = materialize(components(links).withColumnRenamed("node", "cls").withColumnRenamed("component", "root"), "ngram-components")
    classes = representatives.join(comps, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = materialize(classes.join(least, "root").select("cls", "component_id"), "ngram-classes")
    return rows.join(named, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
