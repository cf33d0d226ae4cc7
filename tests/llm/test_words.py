"""Spelling variants and phrases against plain code."""

import random
import re
import zlib
from collections import Counter, defaultdict

import tricky
from pyspark.sql import functions as F

from ledgerloom.llm import collocations, variants
from ledgerloom.llm.tables import materialize

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- spelling variants ---


def plain_spellings(rows, least=7):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if n >= 2 and len(w) >= least}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows, least=7, ratio=10):
    count = plain_spellings(rows, least)
    near = {w: [v for v in count if one_apart(w, v)] for w in count}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-count[v], v), default=None)
        if best is not None and count[best] >= ratio * count[w]:
            form[w] = best
    out = []
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, count[w], len(near[w]), count.get(form.get(w))))
    return sorted(out, key=str)


def noisy_words(rng, words, n):
    """Words with letters replaced, dropped or doubled, some rare and some frequent."""
    out = []
    for _ in range(n):
        word = rng.choice(words)
        i = rng.randrange(len(word))
        kind = rng.random()
        if kind < 0.05:
            word = word[:i] + rng.choice("abcdéÿ×") + word[i + 1 :]
        elif kind < 0.1:
            word = word[:i] + word[i + 1 :]
        elif kind < 0.15:
            word = word[:i] + word[i] + word[i:]
        out.append(word)
    return out


def check_variants(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, variants.variants(docs, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    assert got == plain_variants(rows)
    return got


def test_variants_equal_plain_code(spark):
    rng = random.Random(3)
    words = ["aaaaaaaa", "aaaabbbb", "overflow", "overflown", "Ünderéstimate", "abcabcabc", "straightforward", "straightforwards", "mmmmmmm"]
    rows = [(i, " ".join(noisy_words(rng, words, 40))) for i in range(60)]
    got = check_variants(spark, rows)
    assert any(r[1] for r in got) and any(r[4] > 3 for r in got)
    # many small ranges whose cuts fall inside shared prefixes give the same
    assert check_variants(spark, rows, range_words=8) == got


def test_variants_follow_chains(spark):
    words = ["letterbox"] * 900 + ["letterbax"] * 60 + ["letturbax"] * 4
    rows = [(i, w) for i, w in enumerate(words)]
    got = {r[0]: r for r in check_variants(spark, rows)}
    assert got["letturbax"][1:3] == ("letterbax", "letterbox")


def test_variants_of_tricky_rows(spark):
    rows = [(d, t) for d, t, _ in tricky.rows()] + [(400, "q" * 3000 + "w"), (401, "q" * 3000 + "w"), (402, "q" * 3001 + "w"), (403, "q" * 3001 + "w")]
    check_variants(spark, rows)
    wide = variants.variants(tricky.docs(spark))
    assert wide.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert variants.variants(tricky.empty(spark)).count() == 0


def test_trie_numbers_are_prefixes(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 12))) for _ in range(300)} | {"a" * 7, "a" * 300})
    frame = materialize(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), "trie-test")
    for backwards in (False, True):
        for range_words in (10_000, 20):
            number, seen = {}, {}
            for r in variants.trie(frame, backwards, range_words).collect():
                text = r.word[::-1] if backwards else r.word
                assert len(r.nodes) == len(text) + 1
                for d, node in enumerate(r.nodes):
                    assert number.setdefault(text[:d], node) == node and seen.setdefault(node, text[:d]) == text[:d]


# --- phrases ---


def plain_phrases(rows, top, least, share):
    count, size = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(FOLD)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            size[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    count[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, own in count.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in candidates.items() if len(p) == 3 for q in (p[:2], p[1:]) if q in candidates and 100 * a >= share * candidates[q]}
        judged = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                judged.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(judged)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, size[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(11)
    common = [f"w{i}" for i in range(30)] + ["ü x", "\x1cy", "Ź"]
    fixed = ["New York city", "of course", "in the end", "a a a a", "Stock market", "x\ty  z"]
    rows = []
    for i in range(400):
        words = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(common) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice(["en", "en", "de", None, "und"]), rng.choice([" ", " ", "  "]).join(words) + rng.choice([".", "!", "", "\n", ", and"])))
    return rows + [("fr", None), ("fr", ""), ("es", " . "), ("en", "one. New York, city"), ("en", "of course " * 3000)]


def test_phrases_equal_plain_code(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit(5)).withColumn("phrase", F.lit("x"))
    for top, headstart in ((2000, 2), (7, 1), (1, 1), (30, 5)):
        got = sorted(map(tuple, collocations.collocations(docs, top=top, headstart=headstart).collect()))
        assert got == plain_phrases(rows, top, 10, 50)
    assert any(len(r[2].split(" ")) == 3 for r in got)


def test_frontier_opens_until_settled(spark):
    """Pairs that longer phrases drop leave too few survivors at the first floor, so more has to be opened."""
    rows = [("en", f"a{i} b{i} c{i}.") for i in range(40) for _ in range(10 + i)] + [("en", f"p{i} q{i}. p{i} r{i}. q{i} s.") for i in range(40) for _ in range(12)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for top in (5, 45, 80):
        got = sorted(map(tuple, collocations.collocations(docs, top=top, headstart=1).collect()))
        assert got == plain_phrases(rows, top, 10, 50)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 9_999_999_999_999, 99_999_999_999_998, 99_999_999_999_989
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).first()
    assert row[0] == 1_000_000 * a * a // (left * right)


def test_phrases_of_tricky_rows(spark):
    rows = [("en", t) for _, t, _ in tricky.rows()]
    assert sorted(map(tuple, collocations.collocations(tricky.docs(spark)).collect())) == plain_phrases(rows, 2000, 10, 50)
    assert collocations.collocations(tricky.empty(spark)).count() == 0
