"""N-gram join, components, cover trees, top-k and shards against brute force."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import tricky
from pyspark.sql import functions as F

from ledgerloom.llm import cover_dedup, graph, ngram_join, sharding, topk


def shingle_set(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", folded)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_components(data):
    """Least id of each row's component, by row number."""
    sets = [shingle_set(t) for _, t, _ in data]
    union = tricky.Union(range(len(data)))
    for a, b in itertools.combinations(range(len(data)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            union.join(a, b)
    least = {}
    for i, (d, _, _) in enumerate(data):
        if d is not None:
            least[union.root(i)] = min(d, least.get(union.root(i), d))
    return [(d, len(sets[i]), least.get(union.root(i))) for i, (d, _, _) in enumerate(data)]


def near_rows():
    """Chains of edits around the bound, from sets of few shingles to many."""
    rng = random.Random(9)
    data = [(d, t, s) for d, t, s in tricky.rows() if d is not None]
    at = 1000
    for length in (6, 9, 14, 30, 80):
        words = tricky.sentence(rng, length).split()
        for step in range(8):
            data.append((at, " ".join(words), "s"))
            at += 1
            words[rng.randrange(length)] = f"w{step}"
    return data


def by_row(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("part_rows", [None, 2])
def test_ngram_components(spark, monkeypatch, part_rows):
    if part_rows:  # every ranked list is dealt to pairs of parts
        monkeypatch.setattr(ngram_join, "PART_ROWS", part_rows)
    data = near_rows()
    got = [tuple(r) for r in ngram_join.ngram_components(tricky.docs(spark, data)).collect()]
    assert by_row(got) == by_row(near_components(data))


def test_ngram_edges(spark):
    assert ngram_join.ngram_components(tricky.empty(spark)).count() == 0
    got = ngram_join.ngram_components(tricky.docs(spark, [(None, "a b c d e", "s"), (4, "A b c d e", "s"), (5, None, None)])).collect()
    assert by_row([tuple(r) for r in got]) == by_row([(None, 1, 4), (4, 1, 4), (5, 0, 5)])


def test_prefix_lengths_are_safe():
    for n in range(1, 300):
        least = -(-n * 80 // 100)
        assert ngram_join.prefix_length(n) == n - least + 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(200, x) for x in range(201, 260)] + [(None, 3), (7, 7)]
    union = tricky.Union(range(300))
    for a, b in edges:
        if a is not None:
            union.join(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a is not None and a != b for n in (a, b)}
    assert got == {n: union.root(n) for n in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    data = [(i, (base[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2])).tolist()) for i in range(150)]
    data += [(500 + i, data[3][1]) for i in range(20)] + [(600, [2 * x for x in data[3][1]]), (601, [-x for x in data[3][1]])]
    data += [(700, None), (701, []), (702, [0.0] * 16), (703, [float("nan")] * 16), (704, [None] + [1.0] * 15), (705, [float("inf")] * 16)]
    data += [(706, [1.0] * 5), (707, [1.0, 1.0, 1.0, 1.0, 1.1]), (708, [1e-200] * 16), (709, [1e200] * 16), (710, [1.0] * 16)]
    return data


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.createDataFrame([(i, v, 1, 5) for i, v in vectors()], "vec_id long, embedding array<double>, id int, n_links int")


def test_cover_tree_links(embeddings):
    data = vectors()
    units = {}
    for i, v in data:
        if usable(v) and any(v):
            x = np.array(v) / max(map(abs, v))
            units[i] = x / np.linalg.norm(x)
    union, links = tricky.Union([i for i, _ in data]), {i: 0 for i, _ in data}
    for a, b in itertools.combinations(units, 2):
        if len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9:
            union.join(a, b)
            links[a] += 1
            links[b] += 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cover_dedup.cosine_components(embeddings).collect()}
    assert got == {i: (links[i], union.root(i), union.root(i) == i) for i, _ in data}


@pytest.mark.parametrize("cosine", [0.9, 0.3])
def test_cover_tree_covers(cosine):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x = np.concatenate([x, x[:100] + rng.normal(size=(100, 8)) * 0.01])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    levels = cover_dedup.cover_tree(x, 0.1)
    assert len(levels[0].centre) == 1 and sorted(levels[-1].centre) == list(range(len(x)))
    for upper, lower in zip(levels, levels[1:]):
        assert sorted(np.concatenate(upper.children)) == list(range(len(lower.centre)))
    below = [{int(c)} for c in levels[-1].centre]
    for level in levels[-2::-1]:
        below = [set().union(*[below[c] for c in own]) if len(own) else set() for own in level.children]
        for c, r, own in zip(level.centre, level.radius, below):
            assert all(np.linalg.norm(x[c] - x[m]) <= r + 1e-9 for m in own)
    a, b = np.nonzero(np.triu(x @ x.T >= cosine, 1))
    expected = sorted(zip(a, b))
    found = []
    for whole, p, q in cover_dedup.dual_pairs(x, x, levels, levels, cosine, True):
        pairs = itertools.combinations(p, 2) if whole and p is q else itertools.product(p, q) if whole else zip(p, q)
        found += [(min(a, b), max(a, b)) for a, b in pairs]
    assert sorted(found) == expected  # every pair once
    y = x[::-1][:150]
    other = cover_dedup.cover_tree(y, 0.1)
    found = [t for whole, p, q in cover_dedup.dual_pairs(x, y, levels, other, cosine) for t in (itertools.product(p, q) if whole else zip(p, q))]
    assert sorted(found) == sorted(zip(*np.nonzero(x @ y.T >= cosine)))


@pytest.mark.parametrize("k", [1, 5, 400])
def test_top_k(embeddings, k):
    codes = {i: [math.floor(256 * x) for x in v] for i, v in vectors() if usable(v) and max(map(abs, v)) < 1e100}
    expected = []
    for q in (i for i in codes if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(codes[q], c)), i) for i, c in codes.items() if i != q and len(c) == len(codes[q]))
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    got = topk.top_k(embeddings.filter("vec_id <> 709"), F.col("id") % 50 == 0, k).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_empty_vectors(spark, embeddings):
    none = embeddings.limit(0)
    assert cover_dedup.cosine_components(none).count() == 0 == topk.top_k(none, F.col("id") % 50 == 0).count()
    assert [tuple(r) for r in cover_dedup.cosine_components(embeddings.filter("vec_id = 700")).collect()] == [(700, 0, 700, True)]


@pytest.mark.parametrize("case", ["mixed", "one group", "only pairs"])
def test_shards(spark, case):
    data = {
        "mixed": tricky.rows(),
        "one group": [(i, "same" if i < 70 else f"t{i}", "s") for i in range(203)],
        "only pairs": [(i, f"pair {i // 2}", "s") for i in range(160)],
    }[case]
    rows = sharding.balanced_shards(tricky.docs(spark, data), 8).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in data
    )
    counts = [sum(r["shard"] == j for r in rows) for j in range(8)]
    assert max(counts) - min(counts) <= 1
    for j in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == j) == list(range(counts[j]))
    spread = {}
    for r in rows:
        spread.setdefault(r["text_crc32"], []).append(r["shard"])
    for shards in spread.values():
        if case != "only pairs":
            # groups that fit a shard are whole; a larger one takes no more shards than it must, and one
            assert len(set(shards)) <= -(-len(shards) // max(1, min(counts))) + (len(shards) > min(counts))
    if case == "only pairs":
        # without a free document to make room only exchanges between two shards can mend a pair
        assert sum(len(set(shards)) == 1 for shards in spread.values()) >= 0.4 * len(spread)


def test_shards_of_nothing(spark):
    assert sharding.balanced_shards(tricky.empty(spark)).count() == 0
