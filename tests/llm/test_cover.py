"""Cover trees over many blocks against plain products, and the disk they take."""

import os

import numpy as np
import pytest
import tricky

from ledgerloom.llm import cover_dedup
from ledgerloom.session import shared_folder


def clustered(rng, rows, width):
    """Scattered vectors, some in pairs, a tight group, a wide group and copies."""
    x = rng.normal(size=(rows, width))
    x[: rows // 10] = x[rows // 10 : 2 * (rows // 10)] + rng.normal(size=(rows // 10, width)) * 0.3
    x[-rows // 4 :] = rng.normal(size=width) + rng.normal(size=(len(x[-rows // 4 :]), width)) * 0.02
    x[-rows // 8 :] = rng.normal(size=width) + rng.normal(size=(len(x[-rows // 8 :]), width)) * 0.28
    x[rows // 2 : rows // 2 + 40] = x[rows // 2]
    return x.astype(np.float32)


@pytest.mark.parametrize("sizes", [{}, {"GROUP_NUMBERS": 4_096, "LEAST_GROUP": 200, "BLOCK_ROWS": 64, "LOW_FROM": 64, "LARGE_FAN": 32, "RUNS": 8, "HELD_BYTES": 2_000}])
def test_blocks_meet_once(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(cover_dedup, name, value)
    x = clustered(np.random.default_rng(7), 1_200, 32)
    rows = [(5 * i + 3, v.tolist()) for i, v in enumerate(x)] + [(9_000 + i, [1.0, float(i)]) for i in range(30)]
    rows += [rows[10], rows[700]] + [(None, rows[3][1])]
    units = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    pairs = np.array([r[1] for r in rows[1_200:1_230]])
    pairs /= np.linalg.norm(pairs, axis=1, keepdims=True)
    copies = np.ones(1_230, int)
    copies[[10, 700]] = 2
    near = np.zeros((1_230, 1_230), bool)
    near[:1_200, :1_200], near[1_200:, 1_200:] = units @ units.T >= 0.9, pairs @ pairs.T >= 0.9
    union = tricky.Union([r[0] for r in rows[:1_230]])
    for a, b in np.argwhere(np.triu(near, 1)):
        union.join(rows[a][0], rows[b][0])
    expected = {(r[0], int(near[i] @ copies) - 1, union.root(r[0])) for i, r in enumerate(rows[:1_230])} | {(None, 0, None)}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = [tuple(r)[:3] for r in cover_dedup.cosine_components(table).collect()]
    assert len(got) == 1_233 and set(got) == expected


@pytest.mark.parametrize("sizes", [{"BLOCK_ROWS": 32, "LARGE_FAN": 1, "LOW_FROM": 1}, {"LARGE_FAN": 1 << 40}])
def test_low_products_lose_nothing(monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(cover_dedup, name, value)
    x = cover_dedup.scaled(clustered(np.random.default_rng(3), 500, 48).astype(np.float64))[1]
    x = np.unique(x, axis=0)
    low = cover_dedup.lowered(x, cover_dedup.principal(x[:100]))
    assert (low @ low.T >= x @ x.T - cover_dedup.LOW_SLACK).all()
    tree = cover_dedup.grown_tree(*cover_dedup.flat_tree(cover_dedup.cover_tree(x, 0.1)))
    found = []
    for whole, p, q in cover_dedup.dual_pairs(x, x, tree, tree, 0.9, False, low, low):
        found += [(int(a), int(b)) for a in p for b in q] if whole else list(zip(p.tolist(), q.tolist()))
    assert sorted(found) == [tuple(t) for t in np.argwhere(x @ x.T >= 0.9).tolist()]


def written(folders):
    return sum(os.path.getsize(os.path.join(d, f)) for folder in folders for d, _, names in os.walk(folder) for f in names)


def test_vectors_move_once(spark):
    """Files and shuffles together stay below four times the vectors, whatever the number of pairs of blocks."""
    x = np.random.default_rng(2).normal(size=(16_000, 64)).astype(np.float32)
    x[:500] = x[500:1_000] * 2
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    path = f"{shared_folder(spark)}/cover-input"
    table.write.mode("overwrite").parquet(path)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders = [shared_folder(spark).removeprefix("file://"), *(d.getAbsolutePath() for d in local)]
    before = written(folders)
    linked = cover_dedup.cosine_components(spark.read.parquet(path)).filter("n_links > 0").count()
    assert linked == 1_000
    assert written(folders) - before < 4 * x.nbytes
