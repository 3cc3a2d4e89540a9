"""Uniform shuffle into shards of exact sizes [native].

The method draws a communication matrix: entry (p, s) says how many rows of source
block p go to shard s. Given the block sizes and the shard sizes, the matrix of a
uniform shuffle has a multivariate hypergeometric law, so it is drawn first, exactly;
then rows are permuted inside their block, cut by the matrix row, exchanged, and
permuted again inside their shard.

Both permutations are keyed bijections on ``0..n-1`` made of column expressions
(alternating additive rounds on a rectangle, with a walk back into the range), so
neither needs a sort or a window: a row's slot follows from its place in its input
partition alone, and the exchange that delivers the rows is the only shuffle of them.

The driver holds one count for each input partition (three numbers each, as Spark's
scheduler holds more for each task) and a matrix of at most ``max_blocks`` x ``shards``
numbers; with the defaults the broadcast matrix is below 6 MB at any input size.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: An even number, so that the sides stand as at the start.
ROUNDS = 8
WALK = 64


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken without replacement are good.

    Few draws are taken one by one; otherwise ratio-of-uniforms rejection under the
    log-concave law, so the cost does not grow with the numbers.
    """
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    total = good + bad
    if draws > total - draws:
        return good - hypergeometric(rng, good, bad, total - draws)
    if draws <= 16:
        left, hit = good, 0
        for taken in range(draws):
            if rng.randrange(total - taken) < left:
                left, hit = left - 1, hit + 1
        return hit
    low, high = max(0, draws - bad), min(draws, good)
    mean = draws * good / total
    var = mean * (bad / total) * (total - draws) / (total - 1)
    mode = (draws + 1) * (good + 1) // (total + 2)

    def log_mass(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(draws - k + 1) + math.lgamma(bad - draws + k + 1))

    top = log_mass(mode)
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(var + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u = 1.0 - rng.random()
        k = math.floor(mean + 0.5 + width * (rng.random() - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_mass(k) - top:
            return k


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Row p: the counts that block p sends to each shard. Row and column sums are as given."""
    rng = random.Random(seed)
    left, total, matrix = list(shard_rows), sum(shard_rows), []
    for rows in block_rows:
        counts, need, pool = [], rows, total
        for s, room in enumerate(left):
            got = need if s == len(left) - 1 else hypergeometric(rng, room, pool - room, need)
            counts.append(got)
            need, pool = need - got, pool - room
        left = [a - b for a, b in zip(left, counts, strict=True)]
        total -= rows
        matrix.append(counts)
    return matrix


def permuted(index: Column, n: Column, key: Column) -> Column:
    """A bijection of 0..n-1 that ``key`` chooses, at ``index``. n is at least 1."""
    sides = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    across = F.ceil(n / sides).cast("long")

    def rounds(x: Column) -> Column:
        start = F.struct(F.floor(x / across).cast("long").alias("u"), (x % across).alias("v"), sides.alias("nu"), across.alias("nv"))

        def one(s: Column, r: Column) -> Column:
            moved = F.pmod(s["u"] + F.pmod(F.xxhash64(s["v"], key, r), s["nu"]), s["nu"])
            return F.struct(s["v"].alias("u"), moved.alias("v"), s["nv"].alias("nu"), s["nu"].alias("nv"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one, lambda s: s["u"] * across + s["v"])

    last = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), rounds(index.cast("long")), lambda x, _: F.when(x < n, x).otherwise(rounds(x)))
    return F.when(last < n, last).otherwise(F.raise_error(F.lit("permutation did not return to its range")).cast("long"))


def literal_table(spark: SparkSession, rows: list[tuple], kinds: dict[str, str]) -> DataFrame:
    """Rows that the driver has, as a table that the JVM reads from a literal: one row for each partition or block."""
    listed = json.dumps([dict(zip(kinds, r, strict=True)) for r in rows])
    struct = ", ".join(f"{name}: {kind}" for name, kind in kinds.items())
    return spark.range(1).select(F.inline(F.from_json(F.lit(listed), f"array<struct<{struct}>>")))


def shard_rows(
    df: DataFrame,
    shards: int,
    seed: int = 0,
    max_blocks: int = 4096,
    block_rows: int = 2_000,
    stable_input: bool = True,
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """All rows of ``df`` with the columns ``shard`` and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one at most: law ``rows``. Rows are told apart by their place
    in the input, so nulls in any column, repeated rows and ties need no rule: each row
    gets its own slot. An empty table gives an empty result. Columns of ``df`` that are
    called like the new ones are replaced.

    ``stable_input``: the input gives the same rows in the same partitions each time it
    is computed, as a file scan does. Otherwise it is written to the shared folder first.
    The result is delivered in blocks of ``block_rows`` slots, so that no task gets a
    whole shard.
    """
    if not stable_input:
        df = materialise(df, "shard-input")
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in (shard_col, slot_col)]
    # rows travel as one struct, so that no column of theirs meets a name used here; the upper
    # bits of the place are the partition, the lower 33 the place in it
    row = F.struct(*(F.col(f"`{c}`").alias(c) for c in kept)) if kept else F.lit(0)
    placed = df.select(row.alias("__row"), F.monotonically_increasing_id().alias("__at"))
    part, place = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND((1 << 33) - 1)

    counted = placed.select(part.alias("__part")).groupBy("__part").count().collect()  # one number for each partition
    counts = sorted((r["__part"], r["count"]) for r in counted)
    total = sum(n for _, n in counts)
    blocks = [0] * min(max_blocks, max(1, len(counts)))
    parts = []
    for i, (p, n) in enumerate(counts):
        b = i % len(blocks)
        parts.append((p, b, blocks[b]))
        blocks[b] += n
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix(blocks, sizes, seed)
    rows, sent = [], [0] * shards
    for b, counts_row in enumerate(matrix):
        cut = [0]
        for c in counts_row:
            cut.append(cut[-1] + c)
        rows.append((b, blocks[b], cut, list(sent)))
        sent = [x + y for x, y in zip(sent, counts_row, strict=True)]
    part_of = literal_table(spark, parts, {"__part": "int", "__block": "int", "__base": "bigint"})
    row_of = literal_table(spark, rows, {"__block": "int", "__rows": "bigint", "__cut": "array<bigint>", "__sent": "array<bigint>"})

    local = permuted(F.col("__base") + place, F.col("__rows"), F.xxhash64(F.lit(seed), F.col("__block")))
    size_of = F.when(F.col("__shard") < total % shards, total // shards + 1).otherwise(total // shards)
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(part_of), "__part")
        .join(F.broadcast(row_of), "__block")
        .withColumn("__local", local)
        .withColumn("__shard", (F.size(F.filter("__cut", lambda c: c <= F.col("__local"))) - 1).cast("int"))
        # shards that get nothing from this block share a cut; the last of equal cuts is the one with rows
        .withColumn("__pre", F.col("__sent")[F.col("__shard")] + F.col("__local") - F.col("__cut")[F.col("__shard")])
        .withColumn("__slot", permuted(F.col("__pre"), size_of.cast("long"), F.xxhash64(F.lit(seed), F.lit("shard"), F.col("__shard"))))
        .repartition("__shard", F.floor(F.col("__slot") / block_rows))
        .select(*(F.col("__row")[c].alias(c) for c in kept), F.col("__shard").alias(shard_col), F.col("__slot").alias(slot_col))
    )


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """One folder for each shard, rows in slot order inside each file."""
    sharded.sortWithinPartitions(shard_col, slot_col).write.partitionBy(shard_col).parquet(path)
