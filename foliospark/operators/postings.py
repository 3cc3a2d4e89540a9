"""Stored term postings for BM25: searches read the blocks of the terms that they ask for, and of these the ones that can matter.

Notes are dealt to ranges of about RANGE_NOTES by a hash of their paths, the same for all terms. A
row of the table is a block: a term's notes in one range, with how often each has the term, and ``top``,
the most that the term adds to a note's score there but for its idf. The table is partitioned by a
hash of the term, so only the folders of a query's terms are read.

A search adds the tops of its terms for each range, from the columns of numbers alone. It scores the ``k``
ranges with the largest sums, which hold ``k`` notes at least; then, of the others, those whose sum
reaches the ``k``-th score. No other range can have a note among the best, so the rows are those of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .search import B, K1, micro

RANGE_NOTES, BUCKETS = 256, 64


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def share(tf: Column, size: Column, mean: Column) -> Column:
    """What a term adds to a score but for its idf."""
    tf = tf.cast("double")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.greatest(mean, F.lit(1e-12))))


def blocks(catalog: DataFrame) -> DataFrame:
    """The table's rows of a catalog (path, tokens): bucket, term, range, top, df, notes, mean, paths, tfs, sizes. To be written by ``bucket``."""
    notes, mean = catalog.agg(F.count("*"), F.avg(F.size("tokens"))).first()
    ranges = max(1, -(-notes // RANGE_NOTES))
    of = F.pmod(F.xxhash64("path"), F.lit(ranges)).cast("int")
    each = catalog.select("path", of.alias("range"), F.size("tokens").alias("size"), F.explode("tokens").alias("term"))
    # one exchange: the counts of notes and the blocks stand on the same keys
    each = each.repartition("term", "range").groupBy("term", "range", "path", "size").agg(F.count("*").cast("int").alias("tf"))
    rows = each.groupBy("term", "range").agg(F.array_sort(F.collect_list(F.struct("path", "tf", "size"))).alias("p"), F.max(share(F.col("tf"), F.col("size"), F.lit(mean or 0.0))).alias("top"))
    df = rows.groupBy("term").agg(F.sum(F.size("p")).alias("df"))
    return rows.join(df, "term").select(
        bucket(F.col("term")).alias("bucket"), "term", "range", "top", "df", F.lit(notes).alias("notes"), F.lit(mean or 0.0).alias("mean"),
        F.col("p.path").alias("paths"), F.col("p.tf").alias("tfs"), F.col("p.size").alias("sizes"),
    ).repartition("bucket", F.pmod("range", F.lit(4))).sortWithinPartitions("bucket", "term", "range")


def wanted(queries: DataFrame) -> DataFrame:
    """qid, pos, term: the distinct terms of each query (qid, query) in order."""
    terms = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("query", F.lit(""))), r"\s+"), lambda t: t != ""))
    return queries.select("qid", F.posexplode(terms).alias("pos", "term"))


def read(table: DataFrame, terms: DataFrame) -> DataFrame:
    """The blocks of the terms (qid, pos, term); the folders of other terms are not read."""
    folders = [r[0] for r in terms.select(bucket(F.col("term")).alias("b")).distinct().collect()]  # at most BUCKETS
    return table.where(F.col("bucket").isin(folders)).join(terms, "term")


def search(table: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """qid, rank, path, score_micro: the ``k`` best notes of each query (qid, query) with a positive score; ties by path.

    ``table`` is the stored table of ``blocks``. All queries are one job, and a query without terms has no rows.
    """
    held = read(table, wanted(queries))
    idf = F.log(1 + (F.col("notes") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    sums = held.select("qid", "range", (idf * F.col("top")).alias("most")).groupBy("qid", "range").agg(F.sum("most").alias("most"))
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("most"), "range"))
    first = sums.withColumn("place", place).where(F.col("place") <= k).select("qid", "range")

    def scores(ranges: DataFrame) -> DataFrame:
        # a query's blocks of a range meet in one task, which scores its notes there: no single posting is exchanged
        rows = held.join(ranges.hint("merge"), ["qid", "range"]).select("qid", "range", "pos", idf.alias("idf"), "mean", F.explode(F.arrays_zip("paths", "tfs", "sizes")).alias("n"))
        tf = F.col("n.tfs").cast("double")
        # the terms are added from the left, each as the scan computes it
        adds = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n.sizes") / F.greatest("mean", F.lit(1e-12))))
        each = rows.select("qid", "range", F.col("n.paths").alias("path"), "pos", adds.alias("adds"))
        got = each.groupBy("qid", "range", "path").agg(F.array_sort(F.collect_list(F.struct("pos", "adds"))).alias("a"))
        return got.select("qid", "path", F.aggregate("a", F.lit(0.0), lambda s, x: s + x["adds"]).alias("score")).where("score > 0").select("qid", "path", micro(F.col("score")).alias("score_micro"))

    best = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score_micro"), "path"))
    early = scores(first).withColumn("rank", best).where(F.col("rank") <= k)
    least = early.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score_micro")).alias("least"))
    # sums in another order may differ in their last places
    reach = sums.join(least, "qid", "left").where(F.col("least").isNull() | (micro(F.col("most") * (1 + 1e-9)) + 1 >= F.col("least"))).select("qid", "range")
    late = scores(reach.join(first, ["qid", "range"], "left_anti"))
    both = early.select("qid", "path", "score_micro").union(late)
    return both.withColumn("rank", best).where(F.col("rank") <= k).select("qid", "rank", "path", "score_micro")
