"""Distributed union-find: connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored, writers


def components(edges: DataFrame, parts: int = 0, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for each node of the edges ``a``, ``b`` (longs); root is the least node of its component.

    In a large star all larger neighbours of a node move to the least neighbour, in a
    small star the smaller ones do; both keep the components, and the edges end as stars.
    Least neighbours are partially aggregated, and the joins' hot keys can be split.
    Each round is written to the shared folder, and the one before is deleted; only a count
    and a checksum reach the driver. ``parts`` tasks write the first edges, as many as their
    number calls for the later ones.
    """
    spark = edges.sparkSession

    def marked(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, path = stored(e, "edges", parts)
    mark = marked(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        old = path
        e, path = stored(small.distinct(), "edges", writers(spark, rows=mark[0]))
        forget(spark, [old])
        before, mark = mark, marked(e)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
