"""Even shards that keep equal texts together: balanced label propagation with capacity quotas.

Documents are nodes and equal texts are links. Every document starts with a shard dealt evenly. In each
round a group of equal texts asks for the shard where most of its members already lie; moves are granted
by gain, most first, up to a quota per pair of shards: free room in the target, plus what comes back the
other way. Members of one group are interchangeable, so a group is one row with its counts per shard: a
group of any size weighs a few numbers, and links are never listed. Documents without an equal text have
no link; they fill what is left, so the counts of two shards differ by one at most.

Only DataFrame functions run here. A group larger than a shard is cut where the quotas force it; where
hardly any document is without a link, room comes from exchanges alone and smaller groups may stay cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tables import hash_slice, materialize, number, prefix, slices_for

MAX_ROUNDS = 16


def _best(counts: Column, gid: Column, open_shards: list[bool], shards: int) -> Column:
    """Shard with most members among the open ones; ties by a rotation that depends on the group."""
    turn = F.pmod(F.xxhash64(gid), F.lit(shards)).cast("int")
    is_open = F.array(*[F.lit(x) for x in open_shards])
    scored = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda j: F.struct(
            F.when(F.element_at(is_open, j + 1), F.element_at(counts, j + 1)).otherwise(F.lit(-1)).alias("n"),
            F.pmod(j + turn, F.lit(shards)).alias("turn"),
            j.alias("shard"),
        ),
    )
    return F.array_max(scored)["shard"]


def _quotas(demand: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Moves allowed per pair of shards: exchanges, and a share of the target's free room."""
    quota = {}
    rest_into = [0] * len(room)
    for (i, j), d in demand.items():
        quota[i, j] = min(d, demand.get((j, i), 0))
        rest_into[j] += d - quota[i, j]
    left = list(room)
    for (i, j), d in sorted(demand.items()):
        rest = d - quota[i, j]
        if rest and left[j] > 0:
            share = min(left[j], -(-room[j] * rest // rest_into[j]))
            quota[i, j] += share
            left[j] -= share
    return quota


def _round(state: DataFrame, capacity: list[int], shards: int) -> tuple[DataFrame, bool]:
    """State after one round of moves, and whether anything may still move."""
    loads = state.agg(*[F.sum(F.element_at("counts", j + 1)).alias(f"l{j}") for j in range(shards)]).first()
    room = [c - (load or 0) for c, load in zip(capacity, loads)]
    open_shards = [r > 0 for r in room] if any(r > 0 for r in room) else [True] * shards
    wishes = state.withColumn("best", _best(F.col("counts"), F.col("gid"), open_shards, shards))
    moves = (
        wishes.select("gid", "best", F.element_at("counts", F.col("best") + 1).alias("there"), F.posexplode("counts").alias("origin", "k"))
        .filter((F.col("origin") != F.col("best")) & (F.col("k") > 0))
        .filter("k <= there")
        .withColumn("class", F.lit(63) - F.floor(F.log2(F.col("there"))).cast("int"))
    )
    rows = moves.groupBy("origin", "best").agg(F.sum("k").alias("k"), F.count("*").alias("n")).collect()  # shards^2 rows
    if not rows:
        return state, False
    demand = {(r.origin, r.best): r.k for r in rows}
    quota = _quotas(demand, room)
    if not any(quota.values()):
        return state, False
    if all(quota[p] >= demand[p] for p in demand):
        granted = moves.withColumn("moved", F.col("k"))
    else:
        # by gain class, then by a hash of the group; the slice holds few groups even at one gain
        parts = slices_for(sum(r.n for r in rows))
        sliced = moves.withColumn("slice", F.col("class") * parts + hash_slice(F.col("gid"), parts))
        allowed = F.lit(0).cast("long")
        for (i, j), q in quota.items():
            allowed = F.when((F.col("origin") == i) & (F.col("best") == j), F.lit(q).cast("long")).otherwise(allowed)
        granted = prefix(sliced, ["origin", "best"], "slice", ["gid"], "k", "upto").withColumn(
            "moved", F.least(F.col("k"), F.greatest(F.lit(0), allowed - (F.col("upto") - F.col("k"))))
        )
    gone = granted.groupBy("gid", "best").agg(
        *[F.sum(F.when(F.col("origin") == j, F.col("moved")).otherwise(0)).alias(f"m{j}") for j in range(shards)]
    )
    taken = F.array(*[F.coalesce(F.col(f"m{j}"), F.lit(0)) for j in range(shards)])
    total = sum((F.coalesce(F.col(f"m{j}"), F.lit(0)) for j in range(shards)), F.lit(0))
    after = state.join(gone, "gid", "left").select(
        "gid",
        F.transform(
            F.zip_with(
                F.zip_with("counts", taken, lambda a, b: a - b),
                F.sequence(F.lit(0), F.lit(shards - 1)),
                lambda n, j: F.struct(n.alias("n"), j.alias("j")),
            ),
            lambda x: x["n"] + F.when(x["j"] == F.col("best"), total).otherwise(0),
        ).alias("counts"),
    )
    return materialize(after, "shard-round"), True


def _by_thresholds(number_column: Column, sizes: list[int]) -> Column:
    out, upto = F.lit(len(sizes) - 1), sum(sizes)
    for j in range(len(sizes) - 1, -1, -1):
        out = F.when(number_column < upto, F.lit(j)).otherwise(out)
        upto -= sizes[j]
    return out


def balanced_shards(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Shard and gapless slot of every row; shard counts differ by one at most.

    Returns id, size (UTF-8 bytes of the text plus 1, 1 for null), text_crc32, group_rows, shard, slot.
    A null text counts as an empty one in the checksum and as equal to other nulls and empty texts.
    Repeated rows are rows of their own. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = materialize(
        docs.select(
            F.col(id_column),
            (F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("gid"),
        ),
        "shard-base",
    )
    rows = base.count()
    parts = slices_for(rows)
    capacity = [rows // shards + (j < rows % shards) for j in range(shards)]
    # the slice comes from id and text together, so a repeated id is spread too unless its text repeats
    placed = base.withColumn("slice", hash_slice(F.struct(id_column, "gid"), parts))
    dealt = number(placed.withColumn("all", F.lit(0)), ["all"], "slice", [id_column, "text_crc32"], "dealt").drop("all")
    dealt = materialize(dealt.withColumn("shard0", F.pmod("dealt", F.lit(shards)).cast("int")), "shard-dealt")
    state = dealt.groupBy("gid").agg(
        F.count("*").alias("n"), *[F.sum((F.col("shard0") == j).cast("long")).alias(f"c{j}") for j in range(shards)]
    ).filter("n > 1")
    state = materialize(state.select("gid", F.array(*[f"c{j}" for j in range(shards)]).alias("counts")), "shard-groups")
    for _ in range(MAX_ROUNDS):
        state, moving = _round(state, capacity, shards)
        if not moving:
            break
    loads = state.agg(*[F.sum(F.element_at("counts", j + 1)).alias(f"l{j}") for j in range(shards)]).first()
    free = [c - (load or 0) for c, load in zip(capacity, loads)]
    joined = dealt.join(state, "gid", "left")
    grouped = number(joined.filter("counts IS NOT NULL"), ["gid"], "slice", [id_column, "text_crc32"], "place").withColumn(
        "shard",
        F.aggregate(
            "counts",
            F.struct(F.lit(0).alias("j"), F.lit(0).cast("long").alias("upto")),
            lambda acc, n: F.struct(
                (acc["j"] + F.when(acc["upto"] + n <= F.col("place"), 1).otherwise(0)).alias("j"), (acc["upto"] + n).alias("upto")
            ),
        )["j"],
    )
    alone = number(
        joined.filter("counts IS NULL").withColumn("all", F.lit(0)), ["all"], "slice", [id_column, "text_crc32"], "place"
    ).withColumn("shard", _by_thresholds(F.col("place"), free))
    kept = [id_column, "size", "text_crc32", "slice", "shard"]
    sharded = materialize(
        grouped.select(*kept, F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("group_rows")).unionByName(
            alone.select(*kept, F.lit(1).cast("long").alias("group_rows"))
        ),
        "shard-placed",
    )
    return number(sharded, ["shard"], "slice", [id_column, "text_crc32"], "slot").select(
        id_column, "size", "text_crc32", "group_rows", F.col("shard").cast("int"), "slot"
    )

