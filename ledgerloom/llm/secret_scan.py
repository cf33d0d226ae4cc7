"""Secrets in texts: known shapes, and random-looking strings by sliding-window entropy.

Known shapes are assignments to names such as password, access keys and long lower-case hex strings.
Beyond those, a candidate is a run of 20 or more characters of the base64 alphabets with letters and
digits. A window slides over it; the counts of the characters in the window change by the one that
leaves and the one that enters, and with them the Shannon entropy. The largest entropy must reach the
bound of the run's character class. An allow-list drops such candidates (examples, identifiers, plain
sequences); it never drops a known shape. Only DataFrame functions run, row by row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.spans import SPANS, find

BASE_KINDS = ["assign", "access", "hex"]
ALL_KINDS = [*BASE_KINDS, "entropy"]

# The patterns of the contract
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="
# least entropy in bits a character, of a window of 20: the most possible is 4.32, for hex 4.0
CLASS_BOUNDS = {"hex": 3.0, "lower": 3.4, "upper": 3.4, "mixed": 3.6}
ALLOWED = [
    r"(?i)example|sample|placeholder|changeme|dummy|redacted|xxxx",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)abcdefgh|12345678|qwertyui",
    r"(?i)^(sha|md)[0-9]+-",
    r"^[A-Za-z]+([-_/][A-Za-z]+)*[-_/]?[0-9]{1,4}$",
]


def window_entropy(text: Column, size: int = WINDOW) -> Column:
    """Largest Shannon entropy of any window of ``size`` characters, from counts kept as the window slides.

    A text of fewer characters is one window. Characters outside the alphabet count as one.
    """
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    n = F.least(F.char_length(text), F.lit(size))
    pairs = F.transform(codes, lambda c, i: F.struct(c.alias("enters"), i.alias("i")))
    leaving = F.concat(F.array_repeat(F.lit(-1), size), codes)
    steps = F.zip_with(pairs, leaving, lambda p, out: F.struct(p["enters"].alias("enters"), out.alias("leaves"), p["i"].alias("i")))

    def weigh(count: Column) -> Column:
        return F.when(count > 1, count * F.log2(count)).otherwise(F.lit(0.0))

    def step(state: Column, x: Column) -> Column:
        changed = F.transform(
            state["counts"],
            lambda c, k: c + F.when(k == x["enters"], 1).otherwise(0) - F.when(k == x["leaves"], 1).otherwise(0),
        )
        # of the two counts that changed only; equal characters change nothing
        entering = F.element_at(state["counts"], x["enters"] + 1).cast("double")
        leaving_now = F.element_at(state["counts"], F.greatest(x["leaves"], F.lit(0)) + 1).cast("double")
        delta = F.when(x["enters"] == x["leaves"], F.lit(0.0)).otherwise(
            weigh(entering + 1) - weigh(entering) + F.when(x["leaves"] >= 0, weigh(leaving_now - 1) - weigh(leaving_now)).otherwise(0.0)
        )
        total = state["sum"] + delta
        full = x["i"] + 1 >= state["n"]
        entropy = F.log2(state["n"].cast("double")) - total / state["n"]
        return F.struct(
            changed.alias("counts"),
            total.alias("sum"),
            state["n"].alias("n"),
            F.when(full, F.greatest(state["most"], entropy)).otherwise(state["most"]).alias("most"),
        )

    first = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"), n.alias("n"), F.lit(0.0).alias("most")
    )
    return F.aggregate(steps, first, step, lambda state: state["most"])


def character_class(text: Column) -> Column:
    return (
        F.when(F.rlike(text, F.lit("^[0-9A-Fa-f]+=*$")), "hex")
        .when(F.rlike(text, F.lit("^[0-9a-z_-]+=*$")), "lower")
        .when(F.rlike(text, F.lit("^[0-9A-Z_-]+=*$")), "upper")
        .otherwise("mixed")
    )


def _random_looking(m: Column) -> Column:
    kind, bound = character_class(m), F.lit(0.0)
    for name, least in CLASS_BOUNDS.items():
        bound = F.when(kind == name, F.lit(least)).otherwise(bound)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | F.rlike(m, F.lit(pattern))
    return ~allowed & (window_entropy(m) >= bound)


def secret_spans(text: Column) -> Column:
    """All spans by start, then kind as listed: kind, start, end (code points, end exclusive), text."""
    found = {
        "assign": find(text, "assign", ASSIGN, lambda m: F.char_length(F.regexp_replace(m, ASSIGN_HEAD, "")) >= 8),
        "access": find(text, "access", ACCESS, lambda m: F.lit(True), F.contains(text, F.lit("AKIA"))),
        "hex": find(text, "hex", HEX, lambda m: F.lit(True)),
        "entropy": find(text, "entropy", CANDIDATE, _random_looking),
    }
    all_spans = F.concat(*found.values())
    keyed = F.transform(
        all_spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.array_position(F.array(*[F.lit(k) for k in ALL_KINDS]), s["kind"]).alias("place"),
            s["end"].alias("end"),
            s["kind"].alias("kind"),
            s["text"].alias("text"),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")),
    ).cast(SPANS)


def with_secrets(docs: DataFrame, text_column: str = "text", out: str = "secret_spans") -> DataFrame:
    """Every row of ``docs`` with its spans in ``out``. A null or empty text has none; repeated rows get equal spans.

    A column named ``out`` that is already there is replaced; all other columns stay.
    """
    return docs.withColumn(out, secret_spans(F.coalesce(F.col(text_column), F.lit(""))))
