"""Documents with nulls, empty and long texts, repeated rows and extra columns, and plain reference code."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, key double, grade int, score double, text_crc32 long, ids string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows():
    """(doc_id, text, source) with copies, near copies, short, empty and null texts."""
    rng = random.Random(5)
    out = []
    base = [sentence(rng, 60) for _ in range(6)]
    for i, text in enumerate(base):
        out.append((i * 10, text, f"s{i % 3}"))
        words = text.split()
        words[30] = "changed"
        out.append((i * 10 + 1, " ".join(words), "s0"))
        out.append((i * 10 + 2, text.upper() + " ", "s1"))
    out += [(200 + i, base[0], "s0") for i in range(25)]
    out += [(300, None, "s0"), (301, "", None), (302, " \n\t ", None), (303, "one two", "s9"), (304, "One\ntwo", "s9"), (305, "one two three four five", "")]
    out += [(306, "long " * 3000 + "ü😀 end", "s2"), (307, "x" * 5000, "s2"), (None, "no id at all here", "s1"), (308, base[1], None)]
    out += [(303, "one two", "s9")] * 2  # repeated rows
    return out


def docs(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame(
        [(d, t, "en", s, None if t is None else len(t), 7, 3, 0.5, 1, 0.1, 9, "x") for d, t, s in data], SCHEMA
    )


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


class Union:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def root(self, n):
        while self.parent[n] != n:
            n = self.parent[n]
        return n

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.parent[b] = a
