"""Groups of items that are compared with each other: large groups by a star, then in blocks.

A small group is one block. One of a few blocks goes to the pairs of them. Of a large one, of
more than STAR_BLOCKS, each item is compared with the centre, the least
item: one row an item, however large the group is. Items that are linked with the centre
are in its component, so two of them need no comparison; only the rest, dealt to blocks, meets all items of the
group, dealt to blocks too. A family of copies of one text is done after the star.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidied, writers

#: Blocks of a group up to which their pairs are compared at once; an item is copied as often.
STAR_BLOCKS = 8


def placed(members: DataFrame, values: DataFrame, linked: Callable[[bytes, bytes], bool], block_items: int, block_bytes: int = 1 << 62) -> tuple[DataFrame, DataFrame]:
    """Edges a, b of the stars, and the blocks: g, item, i, j, side.

    ``members``: g, item, size (bytes), stored; ``values``: item, value (binary). A block (g, i, j) with
    i and j from 0 on has items on side 0 and on side 1, which are to be compared across: two blocks
    of a group, or a large group's rest and all its items. One with i and j below 0 has them all on
    side 1, to be compared with each other.
    """
    spark = members.sparkSession

    def blocks(n: str, size: str) -> Column:
        return F.greatest(F.ceil(F.col(n) / block_items), F.ceil(F.col(size) / block_bytes), F.lit(1)).cast("int")

    parts = writers(spark, rows=members.count())
    each = members.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("item").alias("centre")).where("n > 1")
    # stored, so that joins on a group stand alone between their exchanges and a hot one can be split
    each = materialise(each.select("g", "centre", blocks("n", "bytes").alias("blocks")), "groups-each", parts)
    few = members.join(each.where(F.col("blocks") <= STAR_BLOCKS).select("g", "blocks"), "g")
    mine = F.pmod(F.xxhash64("item", F.lit(2)), F.col("blocks")).cast("int")
    few = few.select("g", "item", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    alone, low, high = F.col("mine") == F.col("other"), F.least("mine", "other"), F.greatest("mine", "other")
    paired = few.select(
        "g", "item", F.when(alone, -1 - low).otherwise(low).alias("i"), F.when(alone, -1 - low).otherwise(high).alias("j"),
        F.when(~alone & (F.col("mine") == low), 0).otherwise(1).alias("side"),
    )
    large = each.where(F.col("blocks") > STAR_BLOCKS)
    if large.isEmpty():
        return spark.createDataFrame([], "a long, b long"), paired

    def compare(batches):
        for batch in batches:
            values_, centres = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            same = [a == b or linked(a, b) for a, b in zip(values_, centres, strict=True)]
            yield pa.record_batch([*batch.columns[:5], pa.array(same, pa.bool_())], ["g", "item", "size", "centre", "blocks", "linked"])

    centres = large.join(values.select(F.col("item").alias("centre"), F.col("value").alias("middle")), "centre")
    rows = members.join(large.select("g"), "g", "left_semi").join(values, "item")
    both = rows.join(centres, "g").select("g", "item", "size", "centre", "blocks", "value", "middle")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema.fields[:5])
    star = materialise(both.mapInArrow(tidied(compare), kinds + ", linked boolean"), "stars", parts)
    edges = star.where("linked and item <> centre").select(F.col("item").alias("a"), F.col("centre").alias("b"))
    rest = star.where("not linked")
    left_over = rest.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select("g", blocks("n", "bytes").alias("rests"))
    left_over = materialise(left_over, "rests", parts)

    def own(n: str, seed: int) -> Column:
        return F.pmod(F.xxhash64("item", F.lit(seed)), F.col(n)).cast("int")

    def other(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = rest.join(left_over, "g").select("g", "item", own("rests", 1).alias("i"), other("blocks").alias("j"), F.lit(0).alias("side"))
    right = star.join(left_over, "g").select("g", "item", other("rests").alias("i"), own("blocks", 2).alias("j"), F.lit(1).alias("side"))
    return edges, paired.union(left).union(right)
