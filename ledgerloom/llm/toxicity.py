"""Severity of toxic language by cumulative-link ordinal regression over sparse word features.

A document has the features of its words and of their beginnings of 4 and 5 bytes, by log2(1 + count). One weight vector serves all ordered thresholds:
P(grade >= k) = sigmoid(w.x - theta_k) with theta_1 < theta_2 < ...; the expected severity is the sum of
these probabilities. The labels say toxic or not; a toxic document of the training rows gets grade 1, 2
or 3 by how many distinct marked words it holds, a marked word being one that occurs in toxic documents
far more often than chance. The model is fitted on at most ``MOST_LABELLED`` labelled documents and
scored over every whole text, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.labelled import sample
from ledgerloom.llm.textops import U64, Hasher, mix, pieces, words

MOST_LABELLED = 4_000
FEATURES = 1_024
GRADES = 3
BEGINNINGS = (4, 5)
GRADE_BOUNDS = (3, 6)  # distinct marked words from which a toxic document has grade 2 and 3
REJECT = 0.3


@dataclass
class Ordinal:
    """Words (sorted hashes), their weights, and the ordered thresholds."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _features(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word and of every beginning of a longer word."""
    w = words(data, offsets, hasher)
    folded = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    rows, hashes = [w.row], [w.hashes]
    for size in BEGINNINGS:
        at = np.flatnonzero(w.ends - w.starts > size)
        rows.append(w.row[at])
        hashes.append(mix(hasher.ranges(folded, w.starts[at], w.starts[at] + size) + U64(size)))
    return np.concatenate(rows), np.concatenate(hashes)


def _matches(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every feature that a row has."""
    rows, hashes = _features(data, offsets, hasher)
    if not len(vocabulary) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocabulary & U64(0xFFFF)).astype(np.int64)] = True
    ask = np.flatnonzero(maybe[(hashes & U64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, hashes[ask]), len(vocabulary) - 1)
    hit = vocabulary[at] == hashes[ask]
    both, count = np.unique(rows[ask[hit]] * len(vocabulary) + at[hit], return_counts=True)
    return both // len(vocabulary), both % len(vocabulary), _value(count)


def _value(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1.0 + count), 3.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def cumulative(eta: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ... by column."""
    return _sigmoid(eta[:, None] - thresholds[None, :])


def _labelled_pieces(table: pa.Table, label: np.ndarray) -> Iterator[tuple]:
    at = 0
    for batch in table.combine_chunks().to_batches():
        for piece, data, offsets in pieces(batch, "text"):
            yield piece, data, offsets, label[at : at + piece.num_rows]
            at += piece.num_rows


def fit(table: pa.Table, features: int = FEATURES, rounds: int = 600, penalty: float = 1e-5) -> Ordinal:
    """Fit on rows of text and label (0 or 1). Without rows of both labels nothing is toxic."""
    toxic = table["label"].to_numpy().astype(np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return Ordinal(np.zeros(0, U64), np.zeros(0), np.arange(1.0, GRADES + 1) * 20)
    hasher, seen = Hasher(), []
    for piece, data, offsets, own in _labelled_pieces(table, toxic):
        rows, hashes = _features(data, offsets, hasher)
        at = np.flatnonzero(own[rows] == 1)
        pair = np.unique(np.stack([rows[at].astype(U64), hashes[at]], axis=1), axis=0)
        seen.append(pair[:, 1])
    # only features of two or more toxic documents can mark toxicity; the others are not held
    vocabulary, count = np.unique(np.concatenate(seen), return_counts=True)
    vocabulary = vocabulary[count > 1]
    row_of, column_of, values, start = [], [], [], 0
    for piece, data, offsets, _ in _labelled_pieces(table, toxic):
        rows, columns, value = _matches(data, offsets, vocabulary, hasher)
        row_of.append((rows + start).astype(np.int32))
        column_of.append(columns.astype(np.int32))
        values.append(value.astype(np.float32))
        start += piece.num_rows
    row, column, value = np.concatenate(row_of), np.concatenate(column_of), np.concatenate(values)
    n, positives = len(toxic), int(toxic.sum())
    document_count = np.bincount(column, minlength=len(vocabulary))
    in_toxic = np.bincount(column, weights=toxic[row], minlength=len(vocabulary))
    expected = document_count * positives / n
    surprise = (in_toxic - expected) / np.sqrt(expected + 1)
    chosen = np.sort(np.argsort(-np.abs(surprise), kind="stable")[:features])
    marked = surprise[chosen] > max(4.0, 0.25 * surprise.max())
    place = np.full(len(vocabulary), -1)
    place[chosen] = np.arange(len(chosen))
    use = place[column] >= 0
    x = np.zeros((n, len(chosen)), dtype=np.float32)
    x[row[use], place[column[use]]] = value[use]
    held = (x[:, marked] > 0).sum(axis=1)
    grade = toxic * (1 + sum((held >= b).astype(np.int64) for b in GRADE_BOUNDS))
    return Ordinal(vocabulary[chosen], *_descend(x, grade, rounds, penalty))


def _descend(x: np.ndarray, grade: np.ndarray, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least mean loss, by Adam. Thresholds stay ordered: steps between them are exponentials."""
    n, width = x.shape
    params = np.zeros(width + GRADES)
    params[width], params[width + 1 :] = 2.0, 0.0
    first, second = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        w, theta = params[:width], params[width] + np.concatenate([[0.0], np.cumsum(np.exp(params[width + 1 :]))])
        upper = np.concatenate([np.ones((n, 1)), cumulative(x @ w.astype(np.float32), theta), np.zeros((n, 1))], axis=1)
        likely = np.maximum(upper[np.arange(n), grade] - upper[np.arange(n), grade + 1], 1e-12)
        slope = upper * (1 - upper)
        d_eta = -(slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / likely / n
        d_theta = np.zeros(GRADES)
        for k in range(1, GRADES + 1):
            d_theta[k - 1] = ((slope[:, k] / likely / n) * ((grade == k).astype(float) - (grade == k - 1))).sum()
        tail = np.cumsum(d_theta[::-1])[::-1]
        gradient = np.concatenate([x.T @ d_eta.astype(np.float32) + penalty * w, [tail[0]], tail[1:] * np.exp(params[width + 1 :])])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        params = params - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return params[:width], params[width] + np.concatenate([[0.0], np.cumsum(np.exp(params[width + 1 :]))])


SCORES = {"__toxic_probability": "double", "__expected_severity": "double", "__grade": "int"}


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Ordinal:
    return fit(sample(docs, labels, "toxic", most))


def _score(model: Ordinal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for piece, data, offsets in pieces(batch, "text"):
                row, feature, value = _matches(data, offsets, model.words, hasher)
                eta = np.bincount(row, weights=model.weights[feature] * value, minlength=piece.num_rows)
                p = cumulative(eta, model.thresholds)
                names = [*piece.schema.names, *SCORES]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array((p >= 0.5).sum(axis=1).astype(np.int32))], names=names
                )

    return run


def _scored(docs: DataFrame, model: Ordinal) -> DataFrame:
    """Rows of ``docs`` as they are, with the three scores under private names."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(_score(model), ", ".join([*fields, *[f"{name} {kind}" for name, kind in SCORES.items()]]))


def with_severity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """Rows of ``docs`` with toxic_probability, expected_severity (0 to 3) and grade (0 to 3).

    A null or empty text has no features: it gets the model's base rate, which is grade 0. A long text is scored
    whole. Repeated rows score alike, an empty table gives none. Columns that are already named so are replaced
    in the result (:func:`accepted` keeps them); other columns stay.
    """
    shown = {name: name.strip("_") for name in SCORES}
    return _scored(docs.drop(*shown.values()), model).withColumnsRenamed(shown)


def accepted(docs: DataFrame, model: Ordinal) -> DataFrame:
    """Rows of ``docs`` that are not toxic, untouched: also columns that are named like a score keep their values."""
    return _scored(docs, model).filter(f"__toxic_probability < {REJECT}").select(*[f"`{c}`" for c in docs.columns])
