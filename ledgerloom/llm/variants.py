"""Words that differ by one letter, found by pairs of trie nodes, and the spelling each one is a variant of.

The words are put into two tries: one of the words, one of the words read backwards. Every node has a number,
so the letters before a place of a word are one number and the letters after it another. Two words differ in
one replaced letter exactly if they share the pair (node before a place, node after it) around a skipped
letter; a word is another one with a letter taken out exactly if its pair around a gap is the other's pair
around a skipped letter. Of equal neighbouring letters only the last is skipped for that, so each pair of words
meets under one key. A key holds at most as many words as there are letters. Its words are sorted by count, so
each word learns the number of its neighbours and the best one without any pair being built.

**Numbering.** Words are sorted in ranges cut at sampled words. A task walks its range in order: the prefix
shared with the word before keeps its nodes, the rest gets new numbers of the range. A prefix can only lie in
two ranges if it is a proper prefix of a cut; those few have numbers of their own that every task knows. So no
task holds more than one word, and a prefix that a third of all words share is split over ranges.

The cuts are the only data on the driver: ``CUT_SAMPLE`` words for each range of ``RANGE_WORDS`` words, in
``MOST_RANGES`` ranges at most, cut to ``CUT_LETTERS`` letters. They steer the split only.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tables import materialize
from ledgerloom.llm.textops import give_back, pieces

LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
SLIP = 31
RANGE_WORDS = 10_000
MOST_RANGES = 20_000
CUT_SAMPLE = 20
CUT_LETTERS = 256
HELD_WORDS = 200_000
RANGE_SHIFT = 36
GAP, SKIPPED, LAST_SKIPPED = 0, 1, 2
_MEMBER = ("p", "s", "kind", "id", "n")


def _runs(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and letters of the runs of A-Z, a-z and U+00C0-U+00FF with ``least`` letters, and each row's first run."""
    lead = data == 0xC3  # the first of the two bytes of U+00C0-U+00FF
    small = data | 0x20
    inside = ((small >= 97) & (small <= 122) & (data < 128)) | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    changes = np.empty(len(data) + 1, dtype=bool)
    changes[0], changes[-1] = True, True
    changes[1:-1] = inside[1:] != inside[:-1]
    at = np.flatnonzero(changes | edge)
    own = inside[at[:-1]]
    starts, ends = at[:-1][own], at[1:][own]
    leads = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(lead, out=leads[1:])
    letters = ends - starts - (leads[ends] - leads[starts])
    long = letters >= least
    starts, ends, letters = starts[long], ends[long], letters[long]
    return starts, ends, letters, np.searchsorted(starts, offsets)


def _slipped(run: bytes, at: int) -> bytes:
    text = run.decode()
    return (text[:at] + text[at + 1 :]).encode()


def _words(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
            )
            held.clear()
            return rows

        for batch in batches:
            for piece, data, offsets in pieces(batch, "text"):
                if not len(data):
                    continue
                starts, ends, letters, first = _runs(data, offsets, least)
                folded = (data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)).tobytes()
                runs = [folded[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                ids = piece.column("doc_id").to_pylist()
                keys = [zlib.crc32(f"{i}:".encode()) for i in ids]
                seed = np.repeat(np.array(keys, dtype=np.int64), np.diff(first))
                hashes = np.array([zlib.crc32(w, k) for w, k in zip(runs, seed.tolist(), strict=True)], dtype=np.int64)
                for i in np.flatnonzero(hashes % SLIP == 0).tolist():
                    runs[i] = _slipped(runs[i], int(hashes[i] % letters[i])) if letters[i] > least else b""
                held.update(runs)
                held.pop(b"", None)
                if len(held) >= HELD_WORDS:
                    yield flushed()
        if held:
            yield flushed()
        give_back()

    return run


def spellings(docs: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of ``docs`` with ``least`` letters and ``least_count`` occurrences.

    A word is a maximal run of A-Z, a-z and U+00C0-U+00FF of a whole text, folded from A-Z to a-z. Let h be the
    crc32 of ``<doc_id>:<word>``; where 31 divides h the letter h % length (from 0) is left out, as a typist
    would. A null text has no words, a null id is written as nothing, and repeated rows count again.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    found = texts.mapInArrow(_words(least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= least_count)


class Ranges:
    """Cuts of a sorted dictionary, and numbers of the prefixes that may lie on both sides of one."""

    def __init__(self, cuts: list[str]) -> None:
        self.cuts = cuts
        self.shared = {q: i + 1 for i, q in enumerate(sorted({c[:d] for c in cuts for d in range(1, len(c))}))}

    def of(self, text: str) -> int:
        return bisect_right(self.cuts, text)


def _ranges(words: DataFrame, column: str, total: int, range_words: int) -> Ranges:
    parts = min(MOST_RANGES, max(1, -(-total // range_words)))
    if parts == 1:
        return Ranges([])
    every = max(1, total // (CUT_SAMPLE * parts))
    sample = words.filter(F.pmod(F.xxhash64(column), F.lit(every)) == 0).select(F.substring(column, 1, CUT_LETTERS).alias("cut"))
    found = sorted(sample.toArrow()["cut"].to_pylist())
    step = max(1, len(found) // parts)
    return Ranges(sorted(set(found[step::step])))


def _with_range(ranges: Ranges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.array([ranges.of(t) for t in batch.column("spelt").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, part], names=[*batch.schema.names, "part"])

    return run


def _nodes(ranges: Ranges):
    """Walks sorted ranges; a node's number is ``range << 36 | running number``, or below 2^36 if shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, path, nodes, place = -1, "", [0], 0, 0
        for batch in batches:
            flat, sizes, ids = [], [], []
            for text, own in zip(batch.column("spelt").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if own != part:
                    part, before, path, nodes, place = own, "", [0], 0, 0
                common, most = 0, min(len(text), len(before))
                while common < most and text[common] == before[common]:
                    common += 1
                del path[common + 1 :]
                base = (part + 1) << RANGE_SHIFT
                depth = common + 1
                while depth <= len(text) and depth <= CUT_LETTERS and (known := ranges.shared.get(text[:depth])):
                    path.append(known)
                    depth += 1
                fresh = len(text) - depth + 1
                path.extend(range(base + nodes, base + nodes + fresh))
                nodes += fresh
                flat.append(np.array(path, dtype=np.int64))
                sizes.append(len(path))
                ids.append(base + place)
                place += 1
                before = text
            if not ids:
                continue
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            path_lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat)))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ids, pa.int64()), path_lists], names=["word", "n", "id", "nodes"])

    return run


def trie(words: DataFrame, backwards: bool, range_words: int = RANGE_WORDS) -> DataFrame:
    """(word, n, id, nodes): the numbers of the trie nodes on the way to each word, from the root (0) on.

    Equal prefixes (read backwards: suffixes) have equal numbers, others different ones. ``id`` grows with the
    order of the words in the trie. ``words`` must lie in the shared folder, each word once.
    """
    spelt = words.select("word", "n", (F.reverse("word") if backwards else F.col("word")).alias("spelt"))
    total = spelt.count()
    ranges = _ranges(spelt, "spelt", total, range_words)
    placed = spelt.mapInArrow(_with_range(ranges), "word string, n long, spelt string, part int")
    dealt = placed.repartition(len(ranges.cuts) + 1, "part").sortWithinPartitions("part", "spelt")
    return dealt.mapInArrow(_nodes(ranges), "word string, n long, id long, nodes array<long>")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every pair (node before, node after) of a word: around each gap and around each skipped letter."""
    for batch in batches:
        if not batch.num_rows:
            continue
        before, after = batch.column("before"), batch.column("after")
        width = np.diff(before.offsets.to_numpy())  # letters and one
        head, tail = before.flatten().to_numpy(), after.flatten().to_numpy()
        first = np.concatenate([[0], np.cumsum(width)[:-1]])
        row = np.repeat(np.arange(len(width)), width)
        place = np.arange(len(head)) - first[row]
        length = width[row] - 1
        gaps = (head, tail[first[row] + length - place])
        letter = np.flatnonzero(place < length)
        codes = np.concatenate([np.frombuffer((w + "\0").encode("utf-32-le"), dtype=np.uint32) for w in batch.column("word").to_pylist()])
        last = codes[letter] != codes[letter + 1]
        skips = (head[letter], tail[first[row[letter]] + length[letter] - place[letter] - 1])
        kind = np.concatenate([np.full(len(head), GAP), np.where(last, LAST_SKIPPED, SKIPPED)]).astype(np.int8)
        rows = np.concatenate([row, row[letter]])
        columns = [np.concatenate([gaps[0], skips[0]]), np.concatenate([gaps[1], skips[1]]), kind, batch.column("id").to_numpy()[rows], batch.column("n").to_numpy()[rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(_MEMBER))


def _better(n1, id1, n2, id2):
    """The larger count, the smaller id where counts tie; count 0 stands for nothing."""
    second = (n2 > n1) | ((n2 == n1) & (id2 < id1))
    return np.where(second, n2, n1), np.where(second, id2, id1)


def _met(p, s, kind, ids, n) -> pa.RecordBatch | None:
    """What the members of whole keys, sorted by key, then count down, then id, learn from each other."""
    new = np.empty(len(p), dtype=bool)
    new[:1] = True
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    key = np.cumsum(new) - 1
    keys = int(key[-1]) + 1
    none = np.zeros(keys, dtype=np.int64)

    def leaders(at):
        """Best and second best of ``at`` in every key, as (count, id), and how many there are."""
        group = key[at]
        first = np.ones(len(at), dtype=bool)
        first[1:] = group[1:] != group[:-1]
        best_n, best_id, next_n, next_id = none.copy(), none.copy(), none.copy(), none.copy()
        best_n[group[first]], best_id[group[first]] = n[at[first]], ids[at[first]]
        second = np.zeros(len(at), dtype=bool)
        second[1:] = first[:-1] & ~first[1:]
        next_n[group[second]], next_id[group[second]] = n[at[second]], ids[at[second]]
        return best_n, best_id, next_n, next_id, np.bincount(group, minlength=keys)

    skip, gap, shorter = np.flatnonzero(kind != GAP), np.flatnonzero(kind == GAP), np.flatnonzero(kind == LAST_SKIPPED)
    skip_n, skip_id, next_n, next_id, skips = leaders(skip)
    gap_n, gap_id, _, _, gaps = leaders(gap)
    last_n, last_id, _, _, lasts = leaders(shorter)
    own = key[skip]
    me = skip_id[own] == ids[skip]
    best_n, best_id = np.where(me, next_n[own], skip_n[own]), np.where(me, next_id[own], skip_id[own])
    met = skips[own] - 1
    with_gap = (kind[skip] == LAST_SKIPPED) & (gaps[own] > 0)
    other_n, other_id = _better(best_n, best_id, gap_n[own], gap_id[own])
    best_n, best_id = np.where(with_gap, other_n, best_n), np.where(with_gap, other_id, best_id)
    met = met + with_gap
    columns = [
        np.concatenate([ids[skip], ids[gap]]),
        np.concatenate([met, lasts[key[gap]]]),
        np.concatenate([best_n, last_n[key[gap]]]),
        np.concatenate([best_id, last_id[key[gap]]]),
    ]
    useful = columns[1] > 0
    return pa.RecordBatch.from_arrays([pa.array(c[useful].astype(np.int64)) for c in columns], names=["id", "met", "best_n", "best_id"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys come whole and in order; the last key of a batch waits for the next batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy() for c in _MEMBER]
        if held is not None:
            now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
        p, s = now[0], now[1]
        open_from = int(np.flatnonzero((p != p[-1]) | (s != s[-1]))[-1]) + 1 if ((p != p[-1]) | (s != s[-1])).any() else 0
        held = [c[open_from:] for c in now]
        if open_from:
            yield _met(*[c[:open_from] for c in now])
    if held is not None:
        yield _met(*held)


def neighbours(words: DataFrame, range_words: int = RANGE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(words with ids, neighbours): how many words are one letter away from each word that has any, and the best of them.

    First: word, n, id. Second: id, n_near, best_n, best_id; the best has the largest count, ties go to the word
    that comes first in code-point order. ``words`` (word, n) must lie in the shared folder, each word once.
    """
    forward = materialize(trie(words, False, range_words), "spelling-before")
    backward = trie(words, True, range_words).select("word", F.col("nodes").alias("after"))
    both = forward.select("word", "n", "id", F.col("nodes").alias("before")).join(backward, "word")
    members = both.mapInArrow(_keys, "p long, s long, kind byte, id long, n long")
    dealt = members.repartition("p", "s").sortWithinPartitions("p", "s", F.desc("n"), "id")
    learnt = dealt.mapInArrow(_meet, "id long, met long, best_n long, best_id long")
    best = F.max(F.struct(F.col("best_n"), (-F.col("best_id")).alias("back"))).alias("best")
    near = learnt.groupBy("id").agg(F.sum("met").alias("n_near"), best)
    near = near.select("id", "n_near", F.col("best.best_n").alias("best_n"), (-F.col("best.back")).alias("best_id"))
    return forward.select("word", "n", "id"), materialize(near, "spelling-near")


def _roots(forms: DataFrame) -> DataFrame:
    """(id, form_id, root_id): forms followed to the last. Counts grow tenfold with every form, so paths are short; each round doubles them."""
    found = forms.select("id", "form_id", F.col("form_id").alias("root_id"))
    while True:
        on = found.select(F.col("id").alias("root_id"), F.col("root_id").alias("further"))
        step = materialize(found.join(on, "root_id", "left"), "spelling-roots")
        found = step.select("id", "form_id", F.coalesce("further", "root_id").alias("root_id"))
        if step.filter("further IS NOT NULL").isEmpty():
            return found


def variants(docs: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, range_words: int = RANGE_WORDS) -> DataFrame:
    """One row per word of :func:`spellings`: word, form, root, n, n_near, form_n.

    ``n_near`` counts the words that one inserted, deleted or replaced letter makes of the word. ``form`` is the
    most frequent of them (ties: first in code-point order) if it is at least ``ratio`` times as frequent,
    else null, with its count in ``form_n``. ``root`` is where following forms ends, the word itself without
    one. Only the columns doc_id and text are read. An empty table has no words.
    """
    words = materialize(spellings(docs, least, least_count), "spelling-words")
    numbered, near = neighbours(words, range_words)
    linked = near.filter("best_n > 0").join(numbered.select("id", "n"), "id").filter(F.col("best_n") >= ratio * F.col("n"))
    roots = _roots(materialize(linked.select("id", F.col("best_id").alias("form_id")), "spelling-forms"))
    form = numbered.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    root = numbered.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    named = roots.join(form, "form_id").join(root, "root_id").select("id", "form", "form_n", "root")
    found = numbered.join(near.select("id", "n_near"), "id", "left").join(named, "id", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
