"""Quality of a document from a linear-chain conditional random field over its lines.

Every line is good or bad. A line's features are shares of its characters and words, and those of the
lines before and after it. Forward-backward gives each line's probability of being good; the mean of
these, weighted by the lines' bytes and scaled to a probability, is the document's score.

Labels belong to documents, so the lines' states are latent in training: a bad document has at least one
bad line, a good one has few. The first is exact, by leaving the all-good path out of the document's chain;
the second is a pull of ``FEW`` in log-odds that a good document's lines get towards good, so that a line
that looks clearly bad stays bad inside a good document; a bad document's lines get one of ``MANY`` towards
bad, since they are bad more often than not. Training starts from lines that carry their
document's label and uses at most ``MOST_LABELLED`` documents. Scoring covers every line of every text,
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.labelled import sample
from ledgerloom.llm.textops import Hasher, pieces, words

MOST_LABELLED = 3_000
PREDICT_FROM = 0.3
FEW = 3.0
MANY = 2.0
STARTING_ROUNDS = 100  # in which a line has its document's label
TIES = 0.1  # penalty of neighbours' features and transitions, so that what a line shows by itself comes first
OWN = 12  # features of a line by itself
WIDTH = 3 * OWN + 1


@dataclass
class Crf:
    """Weights of the good state against the bad one, the transition scores [from, to], and the scale of scores."""

    weights: np.ndarray
    transitions: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)  # of the document's mean in log-odds


@dataclass
class Lines:
    features: np.ndarray
    lengths: np.ndarray
    first: np.ndarray  # index of each row's first line; one more entry at the end


def lines(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> Lines:
    """Non-empty lines of a piece with their features, neighbours included."""
    n = len(data)
    inside = data != 10
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets, side="left")

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int32)
        np.cumsum(mask, out=total[1:], dtype=np.int32)
        return (total[ends] - total[starts]).astype(np.float64)

    length = (ends - starts).astype(np.float64)
    upper, lower = share((data >= 65) & (data <= 90)), share((data >= 97) & (data <= 122))
    digit, blank, wide = share((data >= 48) & (data <= 57)), share(data == 32), share(data >= 128)
    plain_marks = share((data == 46) | (data == 44) | (data == 39) | (data == 45))
    symbol = np.maximum(length - upper - lower - digit - blank - wide - plain_marks, 0)
    w = words(data, offsets, hasher)
    line_of = np.searchsorted(starts, w.starts, side="right") - 1
    count = np.bincount(line_of, minlength=len(starts)).astype(np.float64) if len(starts) else np.zeros(0)
    again = np.zeros(len(w.hashes), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (line_of[1:] == line_of[:-1])
    repeated = np.bincount(line_of, weights=again, minlength=len(starts)) if len(starts) else np.zeros(0)
    alternating = np.zeros(len(w.hashes), bool)
    alternating[2:] = (w.hashes[2:] == w.hashes[:-2]) & (line_of[2:] == line_of[:-2])
    swinging = np.bincount(line_of, weights=alternating, minlength=len(starts)) if len(starts) else np.zeros(0)
    letters = np.maximum(upper + lower + wide, 1)
    row = np.searchsorted(offsets, starts, side="right") - 1
    whole = hasher.ranges(data, starts, ends)
    place = np.lexsort((np.arange(len(starts)), whole, row))
    copy = np.zeros(len(starts))
    copy[place[1:]] = (whole[place[1:]] == whole[place[:-1]]) & (row[place[1:]] == row[place[:-1]])
    last = data[ends - 1] if len(starts) else np.zeros(0, np.uint8)
    own = np.stack(
        [
            symbol / np.maximum(length, 1),
            (symbol > 0.05 * length).astype(float),
            upper / letters,
            (upper > 0.5 * letters).astype(float),
            digit / np.maximum(length, 1),
            repeated / np.maximum(count, 1),
            (repeated > 0.2 * count).astype(float),
            swinging / np.maximum(count, 1),
            copy,
            (last == 46).astype(float),
            np.minimum(length / np.maximum(count, 1), 40) / 20,
            np.log1p(length) / 8,
        ],
        axis=1,
    )
    starts_row, ends_row = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    filled = first[1:] > first[:-1]
    starts_row[first[:-1][filled]] = True
    ends_row[first[1:][filled] - 1] = True
    earlier, later = np.zeros_like(own), np.zeros_like(own)
    earlier[1:], later[:-1] = own[:-1], own[1:]
    earlier[starts_row], later[ends_row] = 0, 0
    return Lines(np.concatenate([own, earlier, later, np.ones((len(starts), 1))], axis=1), length, first)


@dataclass
class Chains:
    """P(good) and expected transitions into each line (zero at a row's first), and log partition functions by row."""

    good: np.ndarray
    pairs: np.ndarray  # [line, from, to]
    log_z: np.ndarray


def chains(emission: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> Chains:
    """Forward-backward over all rows side by side, longest first: step t holds the t-th line of every row that has one."""
    size = np.diff(first)
    by_row = np.zeros(len(size))
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    begin, size = first[:-1][order], size[order]
    if not len(size):
        return Chains(np.zeros(0), np.zeros((0, 2, 2)), by_row)
    score = np.stack([np.zeros_like(emission), emission], axis=1)
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alive = np.searchsorted(-size, -np.arange(size[0]), side="left")  # rows with more than t lines
    alpha[begin] = score[begin]
    for t in range(1, size[0]):
        at = begin[: alive[t]] + t
        prev = alpha[at - 1]
        for k in (0, 1):
            alpha[at, k] = np.logaddexp(prev[:, 0] + transitions[0, k], prev[:, 1] + transitions[1, k]) + score[at, k]
    for t in range(size[0] - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        following = beta[at + 1] + score[at + 1]
        for k in (0, 1):
            beta[at, k] = np.logaddexp(following[:, 0] + transitions[k, 0], following[:, 1] + transitions[k, 1])
    last = begin + size - 1
    by_row[order] = np.logaddexp(alpha[last, 0], alpha[last, 1])
    z = np.repeat(by_row, np.diff(first))
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - z, 0.0))
    inner = np.ones(len(emission), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    pairs = np.zeros((len(emission), 2, 2))
    for i in (0, 1):
        for k in (0, 1):
            pairs[at, i, k] = np.exp(np.minimum(alpha[at - 1, i] + transitions[i, k] + score[at, k] + beta[at, k] - z[at], 0.0))
    return Chains(good, pairs, by_row)


def marginals(emission: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions summed over all rows, and the sum of log partition functions."""
    found = chains(emission, first, transitions)
    return found.good, found.pairs.sum(axis=0), float(found.log_z.sum())


def with_a_bad_line(found: Chains, emission: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and expected transitions into it, given that its row has at least one bad line.

    The all-good path is one path of the chain: its share of the row's probability is taken out.
    """
    size = np.diff(first)
    total = np.concatenate([[0.0], np.cumsum(emission)])
    path = total[first[1:]] - total[first[:-1]] + np.maximum(size - 1, 0) * transitions[1, 1]
    all_good = np.repeat(np.minimum(path - found.log_z, 0.0), size)
    rest = np.maximum(-np.expm1(all_good), 1e-9)
    all_good = np.exp(all_good)
    inner = np.ones(len(emission))
    inner[first[:-1][size > 0]] = 0
    pairs = found.pairs / rest[:, None, None]
    pairs[:, 1, 1] = np.clip((found.pairs[:, 1, 1] - all_good * inner) / rest, 0, 1)
    return np.clip((found.good - all_good) / rest, 0, 1), pairs


def _latent(x: np.ndarray, params: np.ndarray, first: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient parts: by line, P(good) less what the documents' labels leave of it; by transition, likewise."""
    emission, transitions = x @ params[:WIDTH], params[WIDTH:].reshape(2, 2)
    of_good = np.repeat(label, np.diff(first)) > 0.5
    free = chains(emission, first, transitions)
    pulled_emission = emission + np.where(of_good, FEW, -MANY)
    pulled = chains(pulled_emission, first, transitions)
    bad_good, bad_pairs = with_a_bad_line(pulled, pulled_emission, first, transitions)
    good = np.where(of_good, pulled.good, bad_good)
    pairs = np.where(of_good[:, None, None], pulled.pairs, bad_pairs)
    return free.good - good, (free.pairs - pairs).sum(axis=0)


def fit(table: pa.Table, rounds: int = 300, penalty: float = 1e-4) -> Crf:
    """Fit on rows of text and label (0 or 1) by Adam. Without rows every line is as likely good as bad."""
    hasher, features, counts, lengths = Hasher(), [], [], []
    label = table["label"].to_numpy().astype(np.float64)
    for batch in table.combine_chunks().to_batches():
        for _, data, offsets in pieces(batch, "text"):
            found = lines(data, offsets, hasher)
            features.append(found.features)
            counts.append(np.diff(found.first))
            lengths.append(found.lengths)
    params = np.zeros(WIDTH + 4)
    if not features or not sum(map(len, features)):
        return Crf(params[:WIDTH], params[WIDTH:].reshape(2, 2))
    x, size, weight = np.concatenate(features), np.concatenate(counts), np.concatenate(lengths)
    y, first = np.repeat(label, size), np.concatenate([[0], np.cumsum(size)])
    penalties = np.full(len(params), penalty)
    penalties[OWN : 3 * OWN], penalties[WIDTH:] = TIES, TIES
    one, two = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        if t <= STARTING_ROUNDS:
            good = 1 / (1 + np.exp(-np.clip(x @ params[:WIDTH], -60, 60)))
            by_line, by_transition = good - y, np.zeros((2, 2))
        else:
            by_line, by_transition = _latent(x, params, first, label)
        gradient = np.concatenate([x.T @ by_line, by_transition.ravel()]) / len(y) + penalties * params
        one, two = 0.9 * one + 0.1 * gradient, 0.999 * two + 0.001 * gradient**2
        params = params - 0.1 * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.999**t)) + 1e-9)
    model = Crf(params[:WIDTH], params[WIDTH:].reshape(2, 2))
    mean, filled = _weighted(chains(x @ model.weights, first, model.transitions).good, weight, size), size > 0
    model.scale = _scale(mean[filled], label[filled])
    return model


def _weighted(good: np.ndarray, lengths: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean of P(good) by row, weighted by the lines' bytes; 0 for a row without lines."""
    row = np.repeat(np.arange(len(size)), size)
    total = np.bincount(row, weights=lengths, minlength=len(size))
    return np.bincount(row, weights=good * lengths, minlength=len(size)) / np.maximum(total, 1)


def _log_odds(mean: np.ndarray) -> np.ndarray:
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def _scale(mean: np.ndarray, label: np.ndarray, rounds: int = 50, penalty: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of the log-odds of a document's mean that make it a probability, by Newton's steps; the slope is not negative."""
    x = np.stack([_log_odds(mean), np.ones(len(mean))], axis=1)
    slope_shift = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ slope_shift, -60, 60)))
        gradient = x.T @ (p - label) / len(x) + penalty * slope_shift
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        slope_shift = slope_shift - step / max(1.0, float(np.abs(step).max()))
    return max(float(slope_shift[0]), 0.1), float(slope_shift[1])


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Crf:
    return fit(sample(docs, labels, "quality", most, ~held_out()))


def line_scores(data: np.ndarray, offsets: np.ndarray, model: Crf, hasher: Hasher) -> tuple[Lines, np.ndarray]:
    found = lines(data, offsets, hasher)
    return found, marginals(found.features @ model.weights, found.first, model.transitions)[0]


def _score(model: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for piece, data, offsets in pieces(batch, "text"):
                found, good = line_scores(data, offsets, model, hasher)
                size = np.diff(found.first)
                row = np.repeat(np.arange(piece.num_rows), size)
                slope, shift = model.scale
                score = 1 / (1 + np.exp(-(slope * _log_odds(_weighted(good, found.lengths, size)) + shift)))
                score = np.where(size > 0, score, 0.0)
                kept = [piece.column(c) for c in piece.schema.names if c != "text"]
                names = [c for c in piece.schema.names if c != "text"]
                bad = np.bincount(row, weights=(good < 0.5).astype(float), minlength=piece.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(np.clip(score, 0, 1)), pa.array(size.astype(np.int64)), pa.array(bad)],
                    names=[*names, "score", "n_lines", "n_bad_lines"],
                )

    return run


def quality(docs: DataFrame, model: Crf, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Score of every row: id, score from 0 to 1, n_lines, n_bad_lines.

    Empty lines count for nothing. A null or empty text, or one of line breaks only, has no line and score
    0. Repeated rows score alike; other columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text_column).alias("text")).mapInArrow(_score(model), f"`{id_column}` {kind}, score double, n_lines long, n_bad_lines long")


def _each_line(model: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for piece, data, offsets in pieces(batch, "text"):
                found, good = line_scores(data, offsets, model, hasher)
                size = np.diff(found.first)
                row = np.repeat(np.arange(piece.num_rows), size)
                line = np.arange(len(row)) - found.first[:-1][row]
                ids = piece.column("id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(line.astype(np.int64)), pa.array(found.lengths.astype(np.int64)), pa.array(good)],
                    names=["id", "line", "bytes", "good"],
                )

    return run


def line_quality(docs: DataFrame, model: Crf, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """P(good) of every line that is not empty: id, line (from 0, empty ones not counted), bytes, good.

    Null and empty texts have no line, repeated rows give theirs again, an empty table gives none.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    asked = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return asked.mapInArrow(_each_line(model), f"id {kind}, line long, bytes long, good double").withColumnRenamed("id", id_column)
