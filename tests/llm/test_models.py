"""Toxicity, line quality, mixing and pieces: accuracy, gradients, budgets, round trips, and the pipeline."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import tricky
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, quality_crf, sentencepieces, toxicity
from ledgerloom.llm.labelled import sample
from ledgerloom.llm.queries import PIECE_MODEL
from ledgerloom.llm.textops import Hasher, pieces, words


def arrow(texts):
    return pa.record_batch([pa.array(texts, pa.string())], names=["text"])


def test_words_follow_the_pattern():
    texts = ["  A b\tc ", None, "", "one", "ü\x0bÄ\x0c", "x\x1cy z\xa0w"]
    for piece, data, offsets in pieces(arrow(texts), "text", 8):
        w = words(data, offsets, Hasher())
        for r, t in enumerate(piece.column("text").to_pylist()):
            own = [data[a:b].tobytes().decode() for a, b, row in zip(w.starts, w.ends, w.row) if row == r]
            assert own == re.findall("[^\x20\x09-\x0d]+", t or "")


def labelled(spark, n=400):
    rng = random.Random(8)
    bad, docs, labels = ["vilefool", "dreadoaf", "grimlout"], [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = tricky.sentence(rng, 40).split()
        for _ in range(rng.randint(1, 9) if toxic else 0):
            text[rng.randrange(40)] = rng.choice(bad)
        docs.append((i, " ".join(text), "s"))
        labels.append((i, 1, int(toxic)))
    return tricky.docs(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels, 200)
    assert (np.diff(model.thresholds) > 0).all()
    rows = toxicity.with_severity(docs, model).join(labels, "doc_id").collect()
    assert np.mean([(r["toxic_probability"] >= toxicity.REJECT) == (r["toxic"] == 1) for r in rows]) > 0.98
    assert all(0 <= r["expected_severity"] <= 3 and 0 <= r["grade"] <= 3 for r in rows)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns
    edge = toxicity.with_severity(tricky.docs(spark), model).collect()
    assert len(edge) == len(tricky.rows()) and all(r["grade"] == 0 for r in edge)
    assert toxicity.with_severity(tricky.empty(spark), model).count() == 0
    assert toxicity.accepted(docs, toxicity.train(docs, labels.limit(0))).count() == docs.count()


def plain_severity(text, model, vocabulary):
    """P(grade >= k) of one text, feature by feature; ``vocabulary`` gives the place of a word or beginning."""
    counts = {}
    for word in re.findall(b"[^\x20\x09-\x0d]+", (text or "").encode().lower()):
        for feature in [(0, word), *[(size, word[:size]) for size in toxicity.BEGINNINGS if len(word) > size]]:
            counts[feature] = counts.get(feature, 0) + 1
    eta = sum(model.weights[vocabulary[f]] * min(math.log2(1 + n), 3) for f, n in counts.items() if f in vocabulary)
    return [1 / (1 + math.exp(theta - eta)) for theta in model.thresholds]


def test_severity_equals_plain_code(spark):
    features = [(0, b"alpha"), (0, b"beta"), (4, b"alph"), (5, b"gamma"), (4, b"gamm"), (0, b"\xc3\xbcber"), (0, b"eta")]
    hasher, codes = Hasher(), []
    for size, word in features:
        text = word.decode() + ("xx" if size else "")
        for _, data, offsets in pieces(arrow([text]), "text"):
            rows, hashes = toxicity._features(data, offsets, hasher)
            # a word comes first, its beginnings of 4 and 5 bytes follow
            codes.append(int(hashes[0 if not size else 1 + toxicity.BEGINNINGS.index(size)]))
    order = np.argsort(np.array(codes, np.uint64))
    vocabulary = {features[k]: i for i, k in enumerate(order)}
    assert len(set(codes)) == len(features)
    model = toxicity.Ordinal(np.array(codes, np.uint64)[order], np.linspace(-1.5, 2.5, len(features)), np.array([0.2, 1.1, 2.4]))
    texts = ["Alpha alpha BETA", "gammas gamma gammon gam", "über Über eta", None, "", "alphabet " * 40, "beta" * 30, "alpha\nalpha\tbeta\x0beta", "none at all"]
    docs = tricky.docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = {r["doc_id"]: r for r in toxicity.with_severity(docs, model).collect()}
    kept = {r["doc_id"] for r in toxicity.accepted(docs, model).collect()}
    for i, t in enumerate(texts):
        p = plain_severity(t, model, vocabulary)
        assert found[i]["toxic_probability"] == pytest.approx(p[0]) and found[i]["expected_severity"] == pytest.approx(sum(p))
        assert found[i]["grade"] == sum(x >= 0.5 for x in p) and (i in kept) == (p[0] < toxicity.REJECT)


def test_ordinal_gradient():
    """Weights fitted by the code are a minimum: a step in any direction costs more."""
    rng = np.random.default_rng(0)
    x = (rng.random((200, 3)) < 0.5).astype(np.float32)
    grade = np.clip(np.round(x @ [1.0, 1.0, -1.0] + rng.normal(size=200) * 0.5 + 0.5), 0, 3).astype(int)
    w, theta = toxicity._descend(x, grade, 3000, 1e-3)

    def loss(w, theta):
        upper = np.concatenate([np.ones((200, 1)), toxicity.cumulative(x @ w, theta), np.zeros((200, 1))], axis=1)
        return -np.log(upper[np.arange(200), grade] - upper[np.arange(200), grade + 1]).mean() + 1e-3 / 2 * w @ w

    best = loss(w, theta)
    for k in range(3):
        for step in (-0.1, 0.1):
            assert loss(w + step * np.eye(3)[k], theta) > best
            assert loss(w, theta + step * np.eye(3)[k]) > best


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    sizes = [4, 0, 1, 3]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emission, transitions = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
    good, pairs, total = quality_crf.marginals(emission, first, transitions)
    expected, expected_pairs, log_z = np.zeros(first[-1]), np.zeros((2, 2)), 0.0
    for a, b in zip(first, first[1:]):
        weights = {}
        for path in itertools.product((0, 1), repeat=int(b - a)) if b > a else []:
            score = sum(emission[a + i] * s for i, s in enumerate(path)) + sum(transitions[s, t] for s, t in zip(path, path[1:]))
            weights[path] = math.exp(score)
        z = sum(weights.values())
        for path, weight in weights.items():
            for i, s in enumerate(path):
                expected[a + i] += s * weight / z
            for s, t in zip(path, path[1:]):
                expected_pairs[s, t] += weight / z
        log_z += math.log(z) if weights else 0.0
    assert good == pytest.approx(expected) and pairs == pytest.approx(expected_pairs) and total == pytest.approx(log_z)


def enumerated(emission, transitions):
    """Every path of one row with its weight."""
    for path in itertools.product((0, 1), repeat=len(emission)):
        score = sum(e * s for e, s in zip(emission, path)) + sum(transitions[s, t] for s, t in zip(path, path[1:]))
        yield path, math.exp(score)


def test_a_bad_line_is_given_equals_enumeration():
    rng = np.random.default_rng(9)
    sizes = [3, 1, 0, 4]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emission, transitions = rng.normal(size=first[-1]) + 1, rng.normal(size=(2, 2))
    found = quality_crf.chains(emission, first, transitions)
    good, pairs = quality_crf.with_a_bad_line(found, emission, first, transitions)
    for a, b in zip(first, first[1:]):
        paths = [(p, w) for p, w in enumerated(emission[a:b], transitions) if 0 in p]
        z = sum(w for _, w in paths)
        for i in range(b - a):
            assert good[a + i] == pytest.approx(sum(w for p, w in paths if p[i]) / z)
            for s, t in itertools.product((0, 1), repeat=2):
                expected = sum(w for p, w in paths if i and (p[i - 1], p[i]) == (s, t)) / z
                assert pairs[a + i, s, t] == pytest.approx(expected)


def plain_line(line, earlier):
    """Features of one line by itself, in plain code over its bytes."""
    raw, split = line.encode(), re.findall(b"[^\x20\x09-\x0d]+", line.encode().lower())
    n, marks = len(raw), sum(c in b".,'-" for c in raw)
    upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    digit, wide = sum(48 <= c <= 57 for c in raw), sum(c >= 128 for c in raw)
    symbol = n - upper - lower - digit - wide - marks - raw.count(b" ")
    again = sum(x == y for x, y in zip(split, split[1:]))
    swing = sum(x == y for x, y in zip(split, split[2:]))
    count, letters = max(len(split), 1), max(upper + lower + wide, 1)
    return [
        symbol / n, symbol > 0.05 * n, upper / letters, upper > 0.5 * letters, digit / n, again / count, again > 0.2 * len(split),
        swing / count, line in earlier, raw[-1:] == b".", min(n / count, 40) / 20, math.log1p(n) / 8,
    ]


def plain_quality(text, model):
    """Score and P(good) of the lines by listing all paths."""
    held = [x for x in (text or "").split("\n") if x]
    own = [[float(v) for v in plain_line(x, held[:i])] for i, x in enumerate(held)]
    none = [0.0] * quality_crf.OWN
    rows = [o + (own[i - 1] if i else none) + (own[i + 1] if i + 1 < len(own) else none) + [1.0] for i, o in enumerate(own)]
    paths = list(enumerated([float(np.dot(r, model.weights)) for r in rows], model.transitions))
    z = sum(w for _, w in paths)
    good = [sum(w for p, w in paths if p[i]) / z for i in range(len(rows))]
    if not rows:
        return 0.0, good
    sizes = [len(x.encode()) for x in held]
    mean = min(max(sum(g * n for g, n in zip(good, sizes)) / sum(sizes), 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(model.scale[0] * math.log(mean / (1 - mean)) + model.scale[1]))), good


def test_document_score_equals_plain_code(spark):
    rng = np.random.default_rng(2)
    model = quality_crf.Crf(rng.normal(size=quality_crf.WIDTH), rng.normal(size=(2, 2)), (0.7, -0.2))
    texts = [
        "One two. \nTWO two TWO!\n\nOne two. \nx y x y x", "a b", "a b", "b a b", "same\nsame\nsame", None, "", "\n\n", " ", "ÄÖ 12,5 ü.\r\n$$$ ### a-b\tc",
    ]
    docs = tricky.docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).coalesce(1)
    scores = {r["doc_id"]: r for r in quality_crf.quality(docs, model).collect()}
    by_line = {(r["doc_id"], r["line"]): r["good"] for r in quality_crf.line_quality(docs, model).collect()}
    listed = 0
    for i, t in enumerate(texts):
        score, good = plain_quality(t, model)
        assert scores[i]["score"] == pytest.approx(score) and scores[i]["n_lines"] == len(good)
        assert scores[i]["n_bad_lines"] == sum(g < 0.5 for g in good)
        assert [by_line[i, k] for k in range(len(good))] == pytest.approx(good)
        listed += len(good)
    assert len(by_line) == listed and quality_crf.line_quality(tricky.empty(spark), model).count() == 0


def test_bad_lines_are_found_inside_good_documents(spark):
    """Training documents are labelled as a whole; a bad one has good lines too. Lines are told apart all the same."""
    rng = random.Random(12)
    good_line = lambda: tricky.sentence(rng, rng.randint(8, 14)) + "."
    bad_line = lambda: " | ".join(rng.sample(tricky.WORDS, 6)) + " $$$ ###"
    data, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        data.append((i, "\n".join(bad_line() if bad and rng.random() < 0.6 else good_line() for _ in range(6)), "s"))
        labels.append((i, int(not bad), 0))
    model = quality_crf.train(tricky.docs(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 300)
    planted, fresh = {}, []
    for i in range(80):
        held = [good_line() for _ in range(8)]
        planted[i] = rng.randrange(8)
        held[planted[i]] = bad_line()
        fresh.append((i, "\n".join(held), "s"))
    found = quality_crf.line_quality(tricky.docs(spark, fresh), model).collect()
    assert len(found) == 640
    assert np.mean([(r["good"] < 0.5) == (planted[r["doc_id"]] == r["line"]) for r in found]) > 0.99
    assert all(r["score"] >= quality_crf.PREDICT_FROM for r in quality_crf.quality(tricky.docs(spark, [(0, "\n".join(good_line() for _ in range(8)), "s")]), model).collect())


def test_quality(spark):
    rng = random.Random(6)
    data, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        lines = [tricky.sentence(rng, 12) + "." for _ in range(5)]
        if not good:
            lines[1:4] = [" | ".join(rng.sample(tricky.WORDS, 6)) + " $$$ ###" for _ in range(3)]
        data.append((i, "\n".join(lines), "s"))
        labels.append((i, int(good), 0))
    docs = tricky.docs(spark, data)
    model = quality_crf.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 200)
    rows = quality_crf.quality(docs, model).select("doc_id", "score", quality_crf.held_out().alias("held_out")).collect()
    apart = [r for r in rows if r["held_out"]]
    assert apart and np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in apart]) > 0.95
    edge = quality_crf.quality(tricky.docs(spark), model).collect()
    assert len(edge) == len(tricky.rows()) and all(0 <= r["score"] <= 1 for r in edge)
    assert {r["score"] for r in edge if r["doc_id"] in (300, 301)} == {0.0}
    assert quality_crf.quality(tricky.empty(spark), model).count() == 0


def targets(sizes, shares=(1, 2, 3), most=3):
    """Targets by sharing the excess again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: shares[i % len(shares)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = rest / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > most * sizes[s] + 1e-9}
        if not above:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= above


def test_mixing(spark):
    rng = random.Random(1)
    data = tricky.rows() + [(5000 + i, tricky.sentence(rng, rng.randint(1, 40)), rng.choice(["s0", "s0", "s0", "big", None, "é", "z"])) for i in range(600)]
    rows = mixing.mix(tricky.docs(spark, data)).collect()
    assert len(rows) == len(data)
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    expected = targets(sizes)
    taken = {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]])
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        own = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, name in data if name == s]
        # nearer than half of the largest document, and near where documents are small
        assert abs(n - expected[s]) <= max(own) / 2 + 1 and (max(own) > 100 or abs(n - expected[s]) <= 0.05 * expected[s] + 3)
    again = mixing.mix(tricky.docs(spark, data[::-1]).repartition(5)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    copies = mixing.mixed(tricky.docs(spark, data))
    assert copies.columns == tricky.docs(spark, []).columns
    assert copies.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.mix(tricky.empty(spark)).count() == 0 == mixing.mixed(tricky.empty(spark)).count()


@pytest.mark.parametrize("weights", [[0.32], [1.0], [0.05], [0.06, 0.3, 0.99]])
def test_mixing_slices_follow_the_weights(spark, weights):
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("id") % len(weights) + 1).cast("int"))
    drawn = spark.range(100_000).select(mixing.sampling_key(F.col("id"), weight, 29).alias("key"), mixing.weight_level(weight).alias("level"))
    shares = drawn.agg(mixing.level_shares(F.col("level"))).first()[0]
    assert sum(shares) == pytest.approx(1) and len(shares) == len(mixing.LEVELS)
    slices = drawn.groupBy(mixing.key_slice(F.col("key"), F.lit(shares), 256).alias("slice")).agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
    found = sorted(slices.collect())
    assert max(r.n for r in found) < 2.5 * 100_000 / 256 and 0 <= found[0].slice and found[-1].slice < 256
    assert all(a.most < b.least for a, b in zip(found, found[1:]))


def test_heavier_documents_come_first(spark):
    data = [(i, ("word " * 10 if i % 2 else "### $$$ &&& word " * 2), "s") for i in range(2000)] + [(9000 + i, "w " * 2000, "t") for i in range(2)]
    rows = [r for r in mixing.mix(tricky.docs(spark, data)).collect() if r["source"] == "s"]
    plain, junk = ([r["picked"] for r in rows if r["doc_id"] % 2 == k] for k in (1, 0))
    assert np.mean(plain) > 2 * np.mean(junk) > 0


@pytest.fixture(scope="module")
def vocab():
    return sentencepieces.vocabulary(PIECE_MODEL)


def test_n_best_equals_enumeration(vocab):
    encoder = sentencepieces.Encoder(vocab, 4)
    lattice = encoder.lattice

    def all_paths(text):
        if not text:
            return [(0.0, [])]
        out = []
        for j in range(1, min(len(text), lattice.longest) + 1):
            k = lattice.by_text.get(text[:j])
            if k is not None:
                out += [(s + vocab.scores[k], [k, *rest]) for s, rest in all_paths(text[j:])]
        return out

    for text in ["▁hello", "▁▁the", "▁éauou", "a", "▁thinking"]:
        paths = sorted(all_paths(text), key=lambda p: (-p[0], p[1]))
        found = lattice.nbest(text, 6)
        assert [s for s, _ in found] == [s for s, _ in paths[:6]]
        assert all((s, p) in paths for s, p in found)
        codes = np.array([ord(c) for c in text], np.int64)
        block = lattice.segment(codes, np.array([0]), np.array([len(codes)]), True)
        assert block.scores[0] == paths[0][0]
        assert block.gaps[0] == (paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf)


def test_merge_best():
    lists = [[(5.0, [1]), (4.0, [2]), (1.0, [3])], [(2.0, [4]), (1.5, [5])]]
    losses = [loss for loss, _ in sentencepieces.merge_best(lists, 5)]
    assert losses == sorted(5.0 + 2.0 - a[0] - b[0] for a in lists[0] for b in lists[1])[:5]


def test_encode_and_decode(spark, vocab):
    docs = tricky.docs(spark)
    done = sentencepieces.encoded(docs, vocab, docs.columns, n_best=3)
    rows = done.collect()
    assert len(rows) == len(tricky.rows()) and all(r["round_trip"] for r in rows)
    texts = sentencepieces.decoded(done, vocab, ["doc_id"]).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in texts)) == sorted((d is None, d or 0, t or "") for d, t, _ in tricky.rows())
    processor = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECE_MODEL)
    for r, (_, text, _) in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(tricky.rows(), key=lambda r: (r[0] is None, r[0] or 0))):
        assert processor.decode(r["ids"]) == (text or "")
        assert r["n_pieces"] == len(r["ids"])
        losses = [a["loss"] for a in r["alternatives"]]
        assert losses == sorted(losses) and all(x >= 0 for x in losses) and len(losses) <= 2
        for a in r["alternatives"]:
            ids = list(r["ids"])
            for c in sorted(a["changes"], key=lambda c: -c["at"]):
                ids[c["at"] : c["at"] + c["removed"]] = c["ids"]
            assert processor.decode(ids) == (text or "")
    assert sentencepieces.encoded(tricky.empty(spark), vocab, ["doc_id"]).count() == 0


def test_accepted_rows_are_untouched(spark):
    """Columns named like the scores keep their own values through the stage; the scored form replaces them."""
    model = toxicity.Ordinal(np.array([], dtype=np.uint64), np.array([]), np.array([20.0, 40.0, 60.0]))
    docs = tricky.docs(spark).withColumns({"grade": F.lit(42), "toxic_probability": F.lit("mine"), "expected_severity": F.lit(None).cast("date")})
    kept = toxicity.accepted(docs, model)
    assert kept.dtypes == docs.dtypes
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert {r["grade"] for r in toxicity.with_severity(docs, model).collect()} == {0}
    assert toxicity.accepted(tricky.empty(spark), model).count() == 0


def test_sample_keeps_to_its_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(50)] + [(7, "a"), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    whole = sample(docs, labels, "toxic", 30)
    assert whole.num_rows == 30 and "a" in sample(docs, labels, "toxic", 50)["text"].to_pylist()
    few = sample(docs, labels, "toxic", 30, most_bytes=1_000)
    assert 0 < sum(len(t) for t in few["text"].to_pylist()) <= 1_000
    assert few["doc_id"].to_pylist() == sample(docs, labels, "toxic", 30, most_bytes=1_000)["doc_id"].to_pylist()
    assert sample(docs, labels, "toxic", 30, most_bytes=0)["text"].to_pylist() in ([], [""])
