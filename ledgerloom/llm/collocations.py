"""Phrases of two and three words that stand together, grown best first with bounds from prefix counts.

A phrase of ``a`` occurrences, cut after its first k words into parts of ``l`` and ``r`` occurrences, scores
floor(1000000 * a * a / (l * r)); the cut of least score counts. No occurrence of a phrase lies outside its
parts, so ``a <= r`` and ``a <= count(prefix)``. That bounds all growth of a prefix ``v w`` by
floor(1000000 * count(v w) / count(v)): the bound of the prefix, known before any longer phrase is counted.

1. Words are counted, then pairs of words that are frequent themselves.
2. The frontier holds all frequent pairs, ordered by bound. A floor per language opens its best part: as many
   pairs as a score level holds that ``HEADSTART`` times the wanted phrases reach.
3. One pass over the texts counts the triples that grow an open prefix, and those that end in a pair whose own
   score reaches the floor, which the rule of longer phrases may drop. Triples are looked for only where both
   of their pairs are frequent.
4. A language is settled once it has the wanted number of surviving phrases at or above its floor: a closed
   prefix has a bound below the floor, so nothing that is not counted can tie with them. The others open more
   of their frontier, and a floor of 0 opens all of it.

Membership in the frontier is tested in the tasks with Bloom filters of at most ``FILTER_BITS`` bits (16 MB);
a false member costs a count that nobody asks for and changes no result. Counts are added up in Spark. Scores
are compared as whole numbers; products run in decimals of 38 digits, exact for counts below 10^14.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tables import hash_slice, materialize, slices_for, small
from ledgerloom.llm.textops import U64, Hasher, give_back, mix

TOP = 2_000
LEAST = 10
SHARE = 50
HEADSTART = 2
WIDER = 4
UNIT = 1_000_000
NO_LANGUAGE = "und"
CHUNK_BYTES = 1 << 20
ROWS_AT_ONCE = 1_000
FILTER_BITS = 1 << 27
BROADCAST_BYTES = 32 << 20
# letters fold, separators of pieces become a mark that no word can hold, tabs part words like spaces
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 10)
_COUNTS = "lang string, phrase string, n long"


class Members:
    """A Bloom filter over 64-bit hashes with two probes; nothing is a member of one without bits."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.mask = U64(max(1, len(words) * 64) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), len(self.words) > 0)
        if len(self.words):
            for place in probes(hashes):
                place = place & self.mask
                found &= (self.words[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) == 1
        return found


def probes(hashes: np.ndarray) -> list[np.ndarray]:
    return [mix(hashes), mix(hashes ^ U64(0xA5A5A5A5A5A5A5A5))]


def _joint(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * U64(0x9E3779B97F4A7C15) + right)


def _hashes(words: pa.Array, hasher: Hasher) -> np.ndarray:
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return hasher.ranges(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0])


def _language_hash(lang: str, hasher: Hasher) -> np.uint64:
    return _hashes(pa.array([lang], pa.large_string()), hasher)[0]


def _filter_bits(size: int, pairs: bool):
    """Words of the filter that the rows' phrases set: (block, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, mask = Hasher(), U64(size - 1)
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            own = np.array([_language_hash(x, hasher) for x in langs.dictionary.to_pylist()], dtype=U64)
            own = own[langs.indices.to_numpy()] if batch.num_rows else own
            if pairs:
                h = _joint(own, _joint(_hashes(batch.column("first"), hasher), _hashes(batch.column("last"), hasher)))
            else:
                h = _joint(own, _hashes(batch.column("phrase"), hasher))
            place = np.concatenate([p & mask for p in probes(h)])
            block, at = np.unique(place >> U64(6), return_inverse=True)
            bits = np.zeros(len(block), dtype=U64)
            np.bitwise_or.at(bits, at, U64(1) << (place & U64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(block.view(np.int64)), pa.array(bits.view(np.int64))], names=["block", "bits"])

    return run


def _members(rows: DataFrame, pairs: bool) -> Members:
    """Filter over the rows of a table in the shared folder; at most ``FILTER_BITS`` bits reach the driver."""
    n = rows.count()
    if not n:
        return Members(np.zeros(0, dtype=U64))
    size = min(FILTER_BITS, 1 << max(16, (16 * n - 1).bit_length()))
    named = rows.select("lang", *(["first", "last"] if pairs else ["phrase"]))
    found = named.mapInArrow(_filter_bits(size, pairs), "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, dtype=U64)
    words[found["block"].to_numpy()] = found["bits"].to_numpy().view(U64)
    return Members(words)


def _chunks(whole: pa.RecordBatch) -> Iterator[tuple[str, pa.DictionaryArray]]:
    """Language and token stream of bounded parts of a batch; '.' stands between pieces."""
    for at in range(0, whole.num_rows, ROWS_AT_ONCE):
        yield from _parts(whole.slice(at, ROWS_AT_ONCE))
        give_back()


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.DictionaryArray]]:
    langs = batch.column("lang").dictionary_encode()
    codes = langs.indices.to_numpy()
    texts = batch.column("text").cast(pa.large_binary())
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        own = texts.take(pa.array(np.flatnonzero(codes == code)))
        sizes = np.cumsum(pc.binary_length(own).to_numpy())
        start = 0
        while start < len(own):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES, side="right")))
            data = b"\n".join(own.slice(start, end - start).to_pylist()).translate(_FOLD).replace(b"\n", b" . ")
            start = end
            offsets = pa.py_buffer(np.array([0, len(data)], dtype=np.int64).tobytes())
            stream = pa.LargeStringArray.from_buffers(1, offsets, pa.py_buffer(data))
            yield lang, pc.ascii_split_whitespace(stream).flatten().dictionary_encode()


def _counted(lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    names = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), dtype=np.int64)))
    return pa.RecordBatch.from_arrays([names, phrases.cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"])


def _phrases(dictionary: pa.Array, *parts: np.ndarray) -> pa.Array:
    words = [dictionary.take(pa.array(p)) for p in parts]
    return words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))


def _count(length: int, frequent: Members | None = None, opened: Members | None = None, ends: Members | None = None):
    """Counts of the words, the pairs of ``frequent`` words, or the triples of ``frequent`` pairs that the frontier asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for lang, tokens in _chunks(batch):
                word, dictionary = tokens.indices.to_numpy().astype(np.int64), tokens.dictionary
                width = len(dictionary)
                if not width:
                    continue
                marks = pc.is_in(dictionary, pa.array(["", "."], pa.large_string())).to_numpy(zero_copy_only=False)
                if length == 1:
                    n = np.bincount(word, minlength=width)
                    kept = np.flatnonzero(~marks & (n > 0))
                    yield _counted(lang, _phrases(dictionary, kept), n[kept])
                    continue
                hashes, own = _hashes(dictionary, hasher), _language_hash(lang, hasher)
                usable = ~marks
                if length == 2:
                    usable &= frequent.has(_joint(np.full(width, own), hashes))
                at = np.flatnonzero(usable[word[:-1]] & usable[word[1:]])
                pair, back, n = np.unique(word[at] * width + word[at + 1], return_inverse=True, return_counts=True)
                left, right = pair // width, pair % width
                if length == 2:
                    yield _counted(lang, _phrases(dictionary, left, right), n)
                    continue
                h = _joint(np.full(len(pair), own), _joint(hashes[left], hashes[right]))
                known, grows, finishes = frequent.has(h), opened.has(h), ends.has(h)
                # pairs that start one word apart make a triple
                near = np.flatnonzero(at[1:] == at[:-1] + 1) if len(at) else at
                first, second = back[near], back[near + 1]
                wanted = known[first] & known[second] & (grows[first] | finishes[second])
                triple, n = np.unique(first[wanted] * len(pair) + second[wanted], return_counts=True)
                first, second = triple // max(1, len(pair)), triple % max(1, len(pair))
                yield _counted(lang, _phrases(dictionary, left[first], right[first], right[second]), n)

    return run


def _totals(texts: DataFrame, counter, label: str) -> DataFrame:
    return materialize(texts.mapInArrow(counter, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n")), label)


def _sized(df: DataFrame) -> DataFrame:
    """``df`` of a table in the shared folder, marked for broadcast if its bytes are few; else Catalyst shuffles it."""
    text = [F.octet_length(f.name) for f in df.schema.fields if f.dataType.simpleString() == "string"]
    size = df.agg(F.sum(reduce(lambda a, b: a + b, text, F.lit(16)))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def score(a: Column, left: Column, right: Column, unit: int = UNIT) -> Column:
    """floor(unit * a * a / (left * right)), exact for counts below 10^14."""
    a, left, right = (c.cast("decimal(14,0)") for c in (a, left, right))
    top = (F.lit(unit).cast("decimal(7,0)") * (a * a).cast("decimal(29,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, left * right).cast("long")


def _pairs(words: DataFrame, counted: DataFrame, least: int) -> DataFrame:
    """Frequent pairs with the counts of their words, score and bound."""
    frequent = counted.filter(F.col("n") >= least).select(
        "lang", "phrase", F.substring_index("phrase", " ", 1).alias("first"), F.substring_index("phrase", " ", -1).alias("last"), F.col("n").alias("a")
    )
    left = words.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = words.select("lang", F.col("phrase").alias("last"), F.col("n").alias("r"))
    both = frequent.join(_sized(left), ["lang", "first"]).join(_sized(right), ["lang", "last"])
    # the bound is the score that a phrase of count a would have if its rest never occurred elsewhere
    return both.withColumns({"score": score(F.col("a"), F.col("l"), F.col("r")), "bound": score(F.col("a"), F.col("l"), F.col("a"))})


def _floors(pairs: DataFrame, wanted: int, settled: DataFrame | None) -> DataFrame:
    """(lang, floor): the score that ``wanted`` pairs reach, 0 where fewer exist; settled languages keep theirs.

    Scores are whole numbers up to a million, so a language is a histogram of at most that many rows.
    """
    levels = pairs.groupBy("lang", "score").agg(F.count("*").alias("n"))
    down = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = levels.withColumn("n", F.sum("n").over(down)).groupBy("lang").agg(
        F.coalesce(F.max(F.when(F.col("n") >= wanted, F.col("score"))), F.lit(0)).alias("floor")
    )
    if settled is None:
        return reached
    kept = settled.select("lang", F.col("floor").alias("kept"))
    return reached.join(kept, "lang", "left").select("lang", F.coalesce("kept", "floor").alias("floor"))


def _triples(words: DataFrame, pairs: DataFrame, counted: DataFrame, least: int) -> DataFrame:
    """Frequent triples with both cuts judged and the bound of their prefix."""
    place = F.split("phrase", " ")
    frequent = counted.filter(F.col("n") >= least).select(
        "lang", "phrase", F.col("n").alias("a"), place[0].alias("first"), place[2].alias("last"),
        F.concat_ws(" ", place[0], place[1]).alias("front"), F.concat_ws(" ", place[1], place[2]).alias("rear"),
    )
    front = pairs.select("lang", F.col("phrase").alias("front"), F.col("a").alias("l2"), F.col("l").alias("l1"), "bound")
    rear = pairs.select("lang", F.col("phrase").alias("rear"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    whole = frequent.join(front, ["lang", "front"]).join(rear, ["lang", "rear"])
    cuts = whole.withColumns({"s1": score(F.col("a"), F.col("l1"), F.col("r1")), "s2": score(F.col("a"), F.col("l2"), F.col("r2"))})
    early = F.col("s1") <= F.col("s2")
    return cuts.select(
        "lang", "phrase", "front", "rear", "a", "bound", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"),
    )


def _survivors(pairs: DataFrame, triples: DataFrame, floors: DataFrame, share: int) -> DataFrame:
    """Phrases at or above the floor that no longer phrase drops."""
    inside = triples.select("lang", F.explode(F.array_distinct(F.array("front", "rear"))).alias("phrase"), "a")
    longest = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    two = pairs.join(floors, "lang").filter(F.col("score") >= F.col("floor")).join(longest, ["lang", "phrase"], "left")
    two = two.filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    three = triples.join(floors, "lang").filter((F.col("score") >= F.col("floor")) & (F.col("bound") >= F.col("floor")))
    named = ["lang", "phrase", "a", "l", "r", "score"]
    return two.select(*named).unionByName(three.select(*named))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, share: int = SHARE, headstart: int = HEADSTART) -> DataFrame:
    """The ``top`` best phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    ``docs`` needs ``lang`` and ``text``; other columns play no part. Texts are taken whole and folded from A-Z
    to a-z. They part at ``. , ; : ! ?`` and 0x0A-0x0D into pieces, and those at spaces and tabs into words. A
    null language counts as ``und``, a null or empty text has no words, repeated rows count again. A phrase is a
    candidate from ``least`` occurrences on. It is dropped if a longer candidate that holds it occurs at least
    ``share`` percent as often. Equal scores go to the larger ``a``, then to the phrase that is less in UTF-8
    bytes. A language without a candidate has no row. ``n`` counts all words of the language.
    """
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = _totals(texts, _count(1), "phrase-words")
    sizes = materialize(counted.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    words = materialize(counted.filter(F.col("n") >= least), "phrase-frequent")
    pairs = materialize(_pairs(words, _totals(texts, _count(2, _members(words, False)), "phrase-pairs"), least), "phrase-scored")
    known = _members(pairs, True)
    wanted, settled = headstart * top, None
    while True:
        floors = small(materialize(_floors(pairs, wanted, settled), "phrase-floors"))
        open_pairs = pairs.join(floors, "lang").filter(F.col("bound") >= F.col("floor"))
        opened = _members(materialize(open_pairs.drop("floor"), "phrase-open"), True)
        ends = _members(materialize(open_pairs.filter(F.col("score") >= F.col("floor")).drop("floor"), "phrase-ends"), True)
        grown = _totals(texts, _count(3, known, opened, ends), "phrase-triples")
        triples = materialize(_triples(words, pairs, grown, least), "phrase-grown")
        found = materialize(_survivors(pairs, triples, floors, share), "phrase-found")
        enough = found.groupBy("lang").agg(F.count("*").alias("n"))
        state = floors.join(enough, "lang", "left").withColumn("settled", (F.col("floor") == 0) | (F.coalesce("n", F.lit(0)) >= top))
        state = materialize(state.select("lang", "floor", "settled"), "phrase-state")
        if not state.filter(~F.col("settled")).limit(1).count():
            break
        settled, wanted = state.filter("settled"), wanted * WIDER
    return _ranked(found, sizes, top)


def _ranked(found: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """The best ``top`` of each language: first within slices, so that no task holds a language with many ties."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    sliced = found.withColumn("slice", hash_slice(F.col("phrase"), slices_for(found.count())))
    local = sliced.withColumn("place", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("place") <= top)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = local.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(small(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
