"""Mixing sources to target weights: exponential keys over quality weights, cut at word budgets.

Each source gets a target of words: a share of all words by weight, at most ``most_epochs`` times its own
size, the excess shared anew. A source is taken whole as often as its target allows (complete epochs);
what is left is a sample without replacement: every document draws the key -ln(u) / weight, with u from a
hash of its id, documents are ordered by key within their source, and the prefix that fits the budget is
taken (Efraimidis and Spirakis). A few more passes fill the gap before the first document that did not
fit with later ones that do, and one document may overshoot where that comes nearer. A pass leaves one cut key per source, so whether a row is taken depends on
the row and its source alone: reruns agree, and texts never cross the network for it.

Only DataFrame functions run. A source may hold any share of the rows: prefix sums run over slices of the
key range, never over a source. Slices follow the spread of the keys under the source's own weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tables import materialize, prefix, slices_for

WORD = r"[^\x20\x09-\x0D]+"
PASSES = 3
ALL = PASSES + 1
LEAST_WEIGHT = 0.05
LEVELS = tuple(LEAST_WEIGHT * 2**i for i in range(5))  # weights from 0.05 to 1, doubling
NULL_SOURCE = "\U0010ffff\U0010ffff null source"  # sorts after every other name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Weight from 0.05 to 1: how little of the text is made of symbols."""
    n = F.greatest(F.char_length(text), F.lit(1))
    plain = F.char_length(F.translate(text, "#$%&*+/<=>@\\^_`{|}~!", "")) / n
    return F.coalesce(F.lit(LEAST_WEIGHT) + F.lit(1 - LEAST_WEIGHT) * F.pow(plain, F.lit(4.0)), F.lit(LEAST_WEIGHT))


def sampling_key(id_column: Column, weight: Column, seed: int) -> Column:
    uniform = (F.pmod(F.xxhash64(id_column, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(uniform) / weight


def weight_level(weight: Column) -> Column:
    """Number of the greatest of LEVELS that the weight reaches."""
    return sum((weight >= F.lit(bound)).cast("int") for bound in LEVELS[1:])


def level_shares(level: Column) -> Column:
    """Aggregate: the share of rows on each level."""
    return F.array(*[F.count_if(level == i) / F.count("*") for i in range(len(LEVELS))])


def key_slice(key: Column, shares: Column, slices: int) -> Column:
    """Slice of a key, rising with the key, none with more than about twice the rows of an even share.

    A key of weight w lies below k with probability 1 - exp(-k * w). The sum over the levels' least weights, each
    with its share of the source's rows, has a slope of at least half the true one, whatever the weights.
    """
    below = sum(F.get(shares, F.lit(i)) * (F.lit(1.0) - F.exp(-key * F.lit(w))) for i, w in enumerate(LEVELS))
    return F.floor(below * slices)


def source_targets(sources: DataFrame, shares: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """Rows of (src, source_size) with ``target`` added.

    Sources by name in code points, null last, take the shares in turn. The targets that stop at their cap
    are those with the least cap per share, so one order and two running sums give the level of the rest.
    One row per source: its windows hold no document rows.
    """
    turn = Window.orderBy("src")
    least = Window.orderBy("ratio", "src")
    ranked = sources.withColumn("share", F.element_at(F.array(*[F.lit(float(s)) for s in shares]), ((F.row_number().over(turn) - 1) % len(shares)) + 1))
    ranked = ranked.withColumns({"cap": F.col("source_size") * float(most_epochs), "ratio": F.col("source_size") * float(most_epochs) / F.col("share")})
    earlier = least.rowsBetween(Window.unboundedPreceding, -1)
    later = least.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = ranked.withColumns(
        {
            "full": F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)),
            "open": F.sum("share").over(later),
            "total": F.sum("source_size").over(everything).cast("double"),
        }
    ).withColumn("level", F.max((F.col("total") - F.col("full")) / F.col("open")).over(everything))
    return levels.select(*sources.columns, F.least(F.col("cap"), F.col("level") * F.col("share")).alias("target"))


def _source(column: Column) -> Column:
    return F.coalesce(column, F.lit(NULL_SOURCE))


def _pass(rows: DataFrame, cuts: DataFrame, slices: int, k: int) -> DataFrame:
    """``cuts`` with the key up to which pass ``k`` takes rows, and what is then left of the budget."""
    waiting = rows.join(cuts, "src").filter(_waiting(k)).filter((F.col("size") <= F.col(f"left{k}")) & (F.col(f"left{k}") > 0))
    place = key_slice(F.col("key"), F.col("levels"), slices)
    sliced = waiting.select("src", "size", "key", F.col(f"left{k}").alias("budget"), place.alias("slice"))
    summed = prefix(sliced, ["src"], "slice", ["key"], "size", "upto").filter(F.col("upto") <= F.col("budget"))
    cut = summed.groupBy("src").agg(F.max("key").alias(f"cut{k}"), F.sum("size").alias("__got"))
    return materialize(
        cuts.join(cut, "src", "left")
        .withColumn(f"cut{k}", F.coalesce(f"cut{k}", F.lit(-1.0)))
        .withColumn(f"left{k + 1}", F.col(f"left{k}") - F.coalesce("__got", F.lit(0)))
        .drop("__got"),
        "mix-cuts",
    )


def _waiting(k: int) -> Column:
    """Whether no pass before ``k`` took the row."""
    return ~_picked(k)


def _overshoot(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``cuts`` with the key of the one document that overshoots what is left by less than it falls short, or -1."""
    left = F.col(f"left{PASSES}")
    waiting = rows.join(cuts, "src").filter(_waiting(PASSES) & (F.col("size") > left) & (F.col("size") < 2 * left))
    alike = waiting.groupBy("src", "key", left.alias("left")).agg(F.sum("size").alias("total")).filter("total < 2 * left")
    best = alike.groupBy("src").agg(F.min_by("key", F.struct(F.col("total") - F.col("left"), "key")).alias("extra"))
    return materialize(cuts.join(best, "src", "left").withColumn("extra", F.coalesce("extra", F.lit(-1.0))), "mix-cuts")


def _picked(passes: int) -> Column:
    taken = F.lit(False)
    if passes == ALL:
        taken, passes = (F.col("key") == F.col("extra")) & (F.col("size") > F.col(f"left{PASSES}")), PASSES
    for k in range(passes):
        taken = taken | ((F.col("key") <= F.col(f"cut{k}")) & (F.col("size") <= F.col(f"left{k}")) & (F.col(f"left{k}") > 0))
    return taken


def _narrow(docs: DataFrame, id_column: str, text_column: str, source_column: str, seed: int) -> list[Column]:
    weight = quality_weight(F.col(text_column))
    return [
        _source(F.col(source_column)).alias("src"),
        word_count(F.col(text_column)).alias("size"),
        sampling_key(F.col(id_column), weight, seed).alias("key"),
        weight_level(weight).alias("level"),
    ]


def _cuts(rows: DataFrame, shares: tuple[int, ...], most_epochs: int) -> DataFrame:
    sized = rows.groupBy("src").agg(F.sum("size").alias("source_size"), level_shares(F.col("level")).alias("levels"))
    sources = materialize(sized, "mix-sources")
    slices = slices_for(rows.count()) * 4
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    cuts = source_targets(sources, shares, most_epochs).withColumn("epochs", epochs)
    cuts = cuts.withColumn("left0", F.greatest(F.round(F.col("target") - F.col("epochs") * F.col("source_size")), F.lit(0.0)).cast("long"))
    cuts = materialize(cuts, "mix-cuts")
    for k in range(PASSES):
        cuts = _pass(rows, cuts, slices, k)
    return _overshoot(rows, cuts)


def mix(
    docs: DataFrame,
    shares: tuple[int, ...] = (1, 2, 3),
    most_epochs: int = 3,
    seed: int = 29,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """Words taken of every row: id, source, size, source_size, target, epochs, picked, taken.

    A null text has size 0; null sources are one source, the last. Repeated rows share their fate. Rows
    with a null id draw equal keys and are picked together. An empty table gives no rows.
    """
    rows = materialize(docs.select(F.col(id_column), F.col(source_column), *_narrow(docs, id_column, text_column, source_column, seed)), "mix-rows")
    cuts = _cuts(rows.select("src", "size", "key", "level"), shares, most_epochs)
    taken = F.col("size") * (F.col("epochs") + F.col("picked").cast("long"))
    return (
        rows.join(cuts, "src")
        .withColumn("picked", _picked(ALL))
        .select(id_column, source_column, "size", "source_size", "target", "epochs", "picked", taken.alias("taken"))
    )


def mixed(
    docs: DataFrame,
    shares: tuple[int, ...] = (1, 2, 3),
    most_epochs: int = 3,
    seed: int = 29,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with the columns of ``docs``."""
    narrow = _narrow(docs, id_column, text_column, source_column, seed)
    rows = materialize(docs.select(*narrow), "mix-rows")
    cuts = _cuts(rows, shares, most_epochs)
    plain = [f"`{c}`" for c in docs.columns]
    marked = docs.select(F.struct(*plain).alias("row"), *narrow).join(cuts, "src").withColumn("times", F.col("epochs") + _picked(ALL).cast("long"))
    return marked.filter("times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
