"""SentencePiece segmentation of whole texts: best and N-best paths through the piece lattice, and decoding.

A text becomes code points with a leading space mark and marks for spaces. No piece holds a mark after
another character, and a character without a piece becomes its bytes, so the lattice falls into segments:
a document's best path is the best path of each. Forward Viterbi runs over all distinct segments of a
stretch of text side by side. A backward pass adds the second best score of each segment; only the
N - 1 segments that lose least can take part in a document's N best paths. Those are searched by A-star
from their end backwards, the forward scores being the exact cost still to come, and the lists of a
document's segments are merged best first. A text of one segment of any length works, in its own time.

The vocabulary comes from a model file; it is read once on the driver and travels with the task.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textops import MULTIPLIER, U64, mix, pieces

MARK = 0x2581
BYTE_PIECES = 256
UNKNOWN_PENALTY = 10.0
STRETCH_BYTES = 1 << 20
BLOCK_CELLS = 1 << 18
_RADIX = 0xD1342543DE82EF95


@dataclass
class Vocabulary:
    """Pieces of a model: text (None for bytes and control pieces), score, and the id of each byte."""

    pieces: list[str | None]
    scores: np.ndarray
    byte_ids: np.ndarray


def vocabulary(model_path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
    texts = [None if special[i] else model.id_to_piece(i) for i in range(n)]
    alone = {t for t in texts if t is not None and len(t) == 1}
    texts = [t if t is not None and all(c in alone for c in t) else None for t in texts]
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(BYTE_PIECES)], dtype=np.int32)
    return Vocabulary(texts, np.array([model.get_score(i) for i in range(n)]), byte_ids)


class Lattice:
    """Tables for segmenting; one per task."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.longest = max((len(t) for t in vocab.pieces if t), default=1)
        self.unknown = float(min((s for t, s in zip(vocab.pieces, vocab.scores) if t and len(t) == 1), default=0.0)) - UNKNOWN_PENALTY
        self.known = np.zeros(0x110000, bool)
        ids = [i for i, t in enumerate(vocab.pieces) if t]
        self.by_text = {vocab.pieces[i]: i for i in reversed(ids)}
        ids = sorted(self.by_text.values())
        for t in self.by_text:
            if len(t) == 1:
                self.known[ord(t)] = True
        span = 1 << 16
        up, down = np.full(span, _RADIX, U64), np.full(span, pow(_RADIX, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        hashes = np.array([self._hash(np.array([ord(c) for c in vocab.pieces[i]], np.int64)) for i in ids], U64)
        place = np.argsort(hashes)
        self.hashes, self.ids = hashes[place], np.array(ids, np.int32)[place]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes & U64(0xFFFFF)).astype(np.int64)] = True

    @staticmethod
    def _values(codes: np.ndarray) -> np.ndarray:
        return mix((codes.astype(U64) + U64(1)) * U64(MULTIPLIER))

    def _hash(self, codes: np.ndarray) -> np.uint64:
        return mix(np.array([(self._values(codes) * self.up[: len(codes)]).sum(dtype=U64)], U64))[0]

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, STRETCH_BYTES)
            up, down = np.full(n, _RADIX, U64), np.full(n, pow(_RADIX, -1, 1 << 64), U64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 for none."""
        found = np.full(len(hashes), -1, np.int32)
        ask = np.flatnonzero(self.maybe[(hashes & U64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[ask]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[ask]
        found[ask[hit]] = self.ids[at[hit]]
        return found

    def segment(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool) -> Segments:
        """Best path, and on request the loss of the second best one, of every segment of known characters."""
        n = len(starts)
        score, gap, count = np.zeros(n), np.full(n, np.inf), np.zeros(n, np.int64)
        length = ends - starts
        order = np.argsort(length, kind="stable")
        flats, at = [np.zeros(0, np.int32)], 0
        while at < n:
            size = max(int(length[order[at]]), 4)
            width = size + size // 4
            most = max(1, BLOCK_CELLS // width)
            stop = min(n, at + most, int(np.searchsorted(length[order], width, side="right")))
            own = order[at:stop]
            score[own], gap[own], count[own], flat = self._block(codes, starts[own], length[own], second)
            flats.append(flat)
            at = stop
        begin = np.zeros(n, np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        return Segments(score, gap, begin, count, np.concatenate(flats))

    def _block(self, codes: np.ndarray, starts: np.ndarray, length: np.ndarray, second: bool):
        """The same for segments of similar lengths, in order of length."""
        n, width = len(starts), int(length.max())
        self.reach(width + 1)
        grid = codes[np.minimum(starts[None, :] + np.arange(width)[:, None], len(codes) - 1)]
        total = np.zeros((width + 1, n), U64)
        np.cumsum(self._values(grid) * self.up[:width, None], axis=0, out=total[1:])
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0.0
        back, back_id = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        scores = self.vocab.scores
        edges = []
        for j in range(1, width + 1):
            live = int(np.searchsorted(length, j, side="left"))  # shorter ones come first
            for k in range(1, min(j, self.longest) + 1):
                found = self.find(mix((total[j, live:] - total[j - k, live:]) * self.down[j - k]))
                hit = np.flatnonzero(found >= 0)
                if not len(hit):
                    continue
                at, ids = hit + live, found[hit]
                gain = scores[ids]
                if second:
                    edges.append((j, k, at, gain))
                value = best[j - k, at] + gain
                # of equal scores the longer last piece wins
                better = value >= best[j, at]
                at, ids, value = at[better], ids[better], value[better]
                best[j, at], back[j, at], back_id[j, at] = value, k, ids
        rows = np.arange(n)
        score = best[length, rows]
        end, count = length.copy(), np.zeros(n, np.int64)
        steps, visited = [], np.zeros((width + 1, n), bool)
        open_rows = rows
        while open_rows.size:
            at = end[open_rows]
            visited[at, open_rows] = True
            steps.append((open_rows, back_id[at, open_rows]))
            end[open_rows] = at - back[at, open_rows]
            count[open_rows] += 1
            open_rows = open_rows[end[open_rows] > 0]
        last = np.cumsum(count) - 1
        flat = np.zeros(int(count.sum()), np.int32)
        for t, (r, ids) in enumerate(steps):
            flat[last[r] - t] = ids
        gap = np.full(n, np.inf)
        if second:
            left = np.full((width + 1, n), -np.inf)
            left[length, rows] = 0.0
            runner_up = np.full(n, -np.inf)
            for j, k, at, gain in reversed(edges):
                onward = left[j, at] + gain
                left[j - k, at] = np.maximum(left[j - k, at], onward)
                through = np.where(visited[j, at] & (back[j, at] == k), -np.inf, best[j - k, at] + onward)
                runner_up[at] = np.maximum(runner_up[at], through)
            gap = score - runner_up
        return score, gap, count, flat

    def nbest(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best paths of a text of known characters, best first; ties by ids. Forward Viterbi, then backward A-star."""
        size, scores = len(text), self.vocab.scores
        ends: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
        best = [float("-inf")] * (size + 1)
        best[0] = 0.0
        for j in range(1, size + 1):
            for i in range(max(0, j - self.longest), j):
                k = self.by_text.get(text[i:j])
                if k is not None:
                    ends[j].append((i, k))
                    best[j] = max(best[j], best[i] + scores[k])
        heap, found = [(-best[size], (), size, 0.0)], []
        while heap and len(found) < n:
            bound, tail, j, done = heapq.heappop(heap)
            if j == 0:
                found.append((-bound, list(tail)))
                continue
            for i, k in ends[j]:
                # exact: what lies before i costs best[i]
                heapq.heappush(heap, (-(best[i] + scores[k] + done), (k, *tail), i, scores[k] + done))
        return found


@dataclass
class Segments:
    """Scores and losses of segments, and where the ids of each lie in ``flat``."""

    scores: np.ndarray
    gaps: np.ndarray
    begin: np.ndarray
    count: np.ndarray
    flat: np.ndarray


def merge_best(lists: list[list[tuple[float, list[int]]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best ways to pick one entry of each list: loss against all firsts, and the picks."""
    start = tuple(0 for _ in lists)
    heap, seen, out = [(0.0, start)], {start}, []
    while heap and len(out) < n:
        loss, picks = heapq.heappop(heap)
        out.append((loss, picks))
        for s, options in enumerate(lists):
            if picks[s] + 1 < len(options):
                following = (*picks[:s], picks[s] + 1, *picks[s + 1 :])
                if following not in seen:
                    seen.add(following)
                    heapq.heappush(heap, (loss + options[picks[s]][0] - options[picks[s] + 1][0], following))
    return out


@dataclass
class Encoded:
    ids: list[np.ndarray]
    scores: np.ndarray
    alternatives: list[list[dict]]


class Encoder:
    def __init__(self, vocab: Vocabulary, n_best: int):
        self.lattice, self.n_best = Lattice(vocab), n_best
        self.bytes_of = [t.replace("▁", " ").encode() if t else b"" for t in vocab.pieces]
        for b, i in enumerate(vocab.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.nbest_of: dict[str, list[tuple[float, list[int]]]] = {}

    def _search(self, text: str) -> list[tuple[float, list[int]]]:
        if text not in self.nbest_of:
            if len(self.nbest_of) > 20_000:
                self.nbest_of.clear()
            self.nbest_of[text] = self.lattice.nbest(text, self.n_best)
        return self.nbest_of[text]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Encoded:
        lattice, rows = self.lattice, len(offsets) - 1
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # of each row's start
        filled = chars[1:] > chars[:-1]
        codes = np.insert(codes, chars[:-1][filled], MARK)
        bounds = chars + np.concatenate([[0], np.cumsum(filled)])
        codes[codes == 0x20] = MARK
        known = lattice.known[codes]
        cut = np.zeros(len(codes), bool)
        if len(codes):
            cut[1:] = ((codes[1:] == MARK) & (codes[:-1] != MARK)) | ~known[1:] | ~known[:-1]
            cut[bounds[:-1][filled]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(codes)).astype(np.int64)
        lattice.reach(len(codes) + 1)
        total = np.concatenate([[U64(0)], np.cumsum(lattice._values(codes) * lattice.up[: len(codes)], dtype=U64)])
        hashes = mix((total[ends] - total[starts]) * lattice.down[starts] + (ends - starts).astype(U64)) if len(starts) else np.zeros(0, U64)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        plain = known[starts[first]] if len(first) else np.zeros(0, bool)
        score, gap = np.full(len(first), lattice.unknown), np.full(len(first), np.inf)
        good, lone = np.flatnonzero(plain), np.flatnonzero(~plain)
        found = lattice.segment(codes, starts[first[good]], ends[first[good]], self.n_best > 1)
        score[good], gap[good] = found.scores, found.gaps
        as_bytes = [np.frombuffer(chr(int(codes[starts[first[u]]])).encode("utf-8", "replace"), np.uint8) for u in lone]
        begin, size = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        begin[good], size[good] = found.begin, found.count
        size[lone] = [len(b) for b in as_bytes]
        begin[lone] = len(found.flat) + np.cumsum(size[lone]) - size[lone]
        flat = np.concatenate([found.flat, *[lattice.vocab.byte_ids[b] for b in as_bytes]])
        own = size[which]
        upto = np.concatenate([[0], np.cumsum(own)])
        ids = flat[np.repeat(begin[which] - upto[:-1], own) + np.arange(upto[-1])] if len(which) else np.zeros(0, np.int32)
        segment_first = np.searchsorted(starts, bounds, side="left")
        summed = np.concatenate([[0.0], np.cumsum(score[which])]) if len(which) else np.zeros(1)
        out, alternatives = [], []
        for r in range(rows):
            a, b = int(segment_first[r]), int(segment_first[r + 1])
            out.append(ids[upto[a] : upto[b]])
            alternatives.append(self._alternatives(codes, starts, ends, gap[which[a:b]], a, upto) if self.n_best > 1 else [])
        return Encoded(out, summed[segment_first[1:]] - summed[segment_first[:-1]], alternatives)

    def _alternatives(self, codes, starts, ends, gaps, a: int, upto) -> list[dict]:
        """The second to n-th best paths of a row: loss against the best and what changes in its ids."""
        wanted = min(self.n_best - 1, int(np.isfinite(gaps).sum()))
        if not wanted:
            return []
        least = np.argpartition(gaps, wanted - 1)[:wanted] if wanted < len(gaps) else np.flatnonzero(np.isfinite(gaps))
        least = np.sort(least)
        lists = [self._search("".join(map(chr, codes[starts[a + s] : ends[a + s]]))) for s in least]
        out = []
        for loss, picks in merge_best(lists, self.n_best)[1:]:
            changes = [
                {"at": int(upto[a + s] - upto[a]), "removed": int(upto[a + s + 1] - upto[a + s]), "ids": options[p][1]}
                for s, options, p in zip(least, lists, picks)
                if p
            ]
            out.append({"loss": float(loss), "changes": changes})
        return out

    def decode(self, ids) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")[1:]


ALTERNATIVES = "array<struct<loss:double,changes:array<struct<at:int,removed:int,ids:array<int>>>>>"
_ALTERNATIVES = pa.list_(
    pa.struct(
        [
            ("loss", pa.float64()),
            ("changes", pa.list_(pa.struct([("at", pa.int32()), ("removed", pa.int32()), ("ids", pa.list_(pa.int32()))]))),
        ]
    )
)


def _encode(vocab: Vocabulary, n_best: int, kept: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab, n_best)
        for batch in batches:
            for piece, data, offsets in pieces(batch, "__text", STRETCH_BYTES):
                done = encoder.encode(data, offsets)
                size = np.array([len(x) for x in done.ids], np.int64)
                flat = pa.array(np.concatenate(done.ids) if len(done.ids) else np.zeros(0, np.int32), pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat)
                raw = data.tobytes()
                same = [
                    encoder.decode(x.tolist()).encode() == raw[offsets[r] : offsets[r + 1]] for r, x in enumerate(done.ids)
                ]
                crc = np.array([zlib.crc32(x.astype("<i4").tobytes()) for x in done.ids], np.int64)
                columns = {
                    "ids": ids,
                    "n_pieces": pa.array(size),
                    "score": pa.array(done.scores),
                    "alternatives": pa.array(done.alternatives, _ALTERNATIVES),
                    "ids_crc32": pa.array(crc),
                    "round_trip": pa.array(same, pa.bool_()),
                }
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], *[columns[n] for n in names]], names=[*kept, *names])

    return run


KINDS = {"ids": "array<int>", "n_pieces": "long", "score": "double", "alternatives": ALTERNATIVES, "ids_crc32": "long", "round_trip": "boolean"}


def encoded(docs: DataFrame, vocab: Vocabulary, keep: list[str], n_best: int = 1, text_column: str = "text", add: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of every row and its segmentation.

    Added: ids, n_pieces, score, alternatives (loss and changes of the second to n-th best path),
    ids_crc32 (of the ids as little-endian 32-bit numbers) and round_trip (decoding gives the text back);
    ``add`` picks some of them. A null or empty text has no pieces, score 0, no alternatives. Repeated
    rows get equal results; a kept column with an added name is replaced.
    """
    add = list(KINDS) if add is None else add
    kept = [c for c in keep if c not in add]
    plain = docs.select(*[f"`{c}`" for c in kept], F.col(text_column).alias("__text"))
    schema = ", ".join([f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in kept] + [f"{n} {KINDS[n]}" for n in add])
    return plain.mapInArrow(_encode(vocab, n_best, kept, add), schema)


def decoded(rows: DataFrame, vocab: Vocabulary, keep: list[str], ids_column: str = "ids", out: str = "text") -> DataFrame:
    """The ``keep`` columns of every row and the text of its ids; null ids give null."""
    kept = [c for c in keep if c != out]
    plain = rows.select(*[f"`{c}`" for c in kept], F.col(ids_column).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab, 1)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())], names=[*kept, out])

    schema = ", ".join([f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in kept] + [f"`{out}` string"])
    return plain.mapInArrow(run, schema)
