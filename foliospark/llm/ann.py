"""Approximate nearest neighbours by learned partitions.

On a sample of bounded size (it grows with the number of partitions): a neighbour graph, its balanced partitioning (partitions of equal
capacity that keep neighbours together), and a small classifier (one hidden layer) that
learns the partition of a vector. All rows are indexed in the classifier's most probable
partition; a query goes to its several most probable ones and is reranked exactly there.

How many partitions a query visits is set on the sample too: the least number that
covers ``coverage`` of the true neighbours of held-back queries. Neighbours among all
rows are nearer than among the sample, so recall over the table is higher than that.

Partitions are searched in blocks of bounded numbers of rows and queries, so a partition
that holds a third of all rows is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, small_batches


#: Rows of a partition, on average; most partitions; sample rows at least, and for each partition.
PARTITION_ROWS, MOST_PARTS, SAMPLE_ROWS, SAMPLE_EACH = 8192, 1024, 4096, 32


@dataclass
class Router:
    """The classifier's weights and the number of partitions that a query visits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def order(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each row, most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbours(x: np.ndarray, of: np.ndarray, k: int, skip: np.ndarray | None = None) -> np.ndarray:
    """Indices in ``x`` of the k largest cosines of each row of ``of``; ``skip``: each row's own index."""
    out = []
    for lo in range(0, len(of), 512):
        s = of[lo : lo + 512] @ x.T
        if skip is not None:
            s[np.arange(len(s)), skip[lo : lo + 512]] = -2
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_partition(graph: np.ndarray, x: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """Partition of each node: halves by projections first, then moves towards one's neighbours within the capacity."""
    n = len(x)
    label = np.zeros(n, np.int64)
    groups = [np.arange(n)]
    while len(groups) < parts:
        groups.sort(key=len)
        g = groups.pop()
        a, b = x[rng.choice(g, 2, replace=False)]
        g = g[np.argsort(x[g] @ (a - b), kind="stable")]
        groups += [g[: len(g) // 2], g[len(g) // 2 :]]
    for p, g in enumerate(groups):
        label[g] = p
    capacity = int(np.ceil(n / parts * slack))
    ends = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (ends[0], label[ends[1]]), 1)
        np.add.at(votes, (ends[1], label[ends[0]]), 1)
        size = np.bincount(label, minlength=parts)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < capacity:
                size[best[i]] += 1
                size[label[i]] -= 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def train(x: np.ndarray, parts: int, seed: int, coverage: float, k: int = 10, hidden: int = 96, steps: int = 500) -> Router:
    """Fit on sample rows ``x`` (unit vectors); a seventh of them are held back to set the visits."""
    rng = np.random.default_rng(seed)
    if len(x) < 8 * parts or parts == 1:
        d = x.shape[1] if len(x) else 1
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    order = rng.permutation(len(x))
    held, x = x[order[: len(x) // 7]], x[order[len(x) // 7 :]]
    graph = neighbours(x, x, min(k, len(x) - 1), np.arange(len(x)))
    label = balanced_partition(graph, x, parts, rng)
    d = x.shape[1]
    weights = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(x), 512)
        xb, h = x[at], np.maximum(x[at] @ weights[0] + weights[1], 0)
        z = h @ weights[2] + weights[3]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(at)), label[at]] -= 1
        p /= len(at)
        dh = (p @ weights[2].T) * (h > 0)
        for w, g, m, v in zip(weights, (xb.T @ dh, dh.sum(0), h.T @ p, p.sum(0)), first, second, strict=True):
            g = g + 1e-4 * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    router = Router(*weights, 1)
    near = neighbours(x, held, min(k, len(x)))
    home = router.order(x)[:, 0]
    rank = np.argsort(router.order(held), axis=1)  # place of each partition in a query's order
    place = rank[np.arange(len(held))[:, None], home[near]]
    router.visits = int(np.searchsorted(np.cumsum(np.bincount(place.ravel(), minlength=parts)) / place.size, coverage) + 1)
    router.visits = min(router.visits, parts)
    return router


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part; a repeated vec_id counts once, with its least vector."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf"))), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & fine)
    rows = rows.where(F.aggregate("v", F.lit(0.0), lambda s, a: s + a * a) > 0)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten()).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def search(
    df: DataFrame, is_query, k: int = 5, parts: int | None = None, sample_rows: int | None = None, coverage: float = 0.93, block_rows: int = 4096, block_queries: int = 2048, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest rows by cosine for each row for which ``is_query`` (a Column over vec_id) holds.

    Columns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. A row is
    never its own neighbour. Vectors that are null or zero, hold nulls or non-finite
    numbers, or are of another length than the most frequent one, and rows with a null
    id, take no part. Fewer candidates than ``k`` give fewer rows, an empty table none.

    ``sample_rows`` bounds the rows that are fitted on the driver, those with the least
    seeded hash of their id: SAMPLE_ROWS, or SAMPLE_EACH for each partition. ``parts``
    grows with the table up to MOST_PARTS. All rows are indexed. The rows that take part are
    stored once, and the passes over them read that table.
    """
    small_batches(df)
    spark = df.sparkSession
    rows = materialise(valid_vectors(df, id_col, vec_col), "vectors")
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], schema)
    rows, total = rows.where(F.size("v") == length["d"]), length["count"]
    parts = parts or int(min(MOST_PARTS, max(16, total // PARTITION_ROWS)))
    sample_rows = sample_rows or max(SAMPLE_ROWS, SAMPLE_EACH * parts)
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample_rows).select("v").collect()
    router = train(unit(np.array([r["v"] for r in picked], np.float64)), parts, seed, coverage)

    def place(visits: int):
        def work(batches):
            for batch in batches:
                x = unit(matrix(batch.column(1))) if len(batch) else np.zeros((0, 1))
                order = router.order(x)[:, :visits] if len(batch) else np.zeros((0, visits), np.int64)
                n = order.shape[1]
                at = np.repeat(np.arange(len(batch)), n)
                yield pa.record_batch([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(order.ravel().astype(np.int32))], ["vec_id", "v", "part"])

        return work

    indexed = rows.mapInArrow(place(1), "vec_id long, v array<double>, part int")
    asked = rows.where(is_query).mapInArrow(place(router.visits), "vec_id long, v array<double>, part int")
    # rows and queries of a partition come in blocks; one small row for each partition says how many
    size = indexed.groupBy("part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    size = size.join(asked.groupBy("part").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("turns")), "part")
    size = F.broadcast(size)

    def own(n: str):
        return F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")

    left = indexed.join(size, "part").select("part", own("blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "vec_id", "v")
    right = asked.join(size, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), own("turns").alias("turn"), "vec_id", "v")

    def rerank(here: pa.Table, wanted: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(here) and len(wanted):
            ids, x, query, q = here["vec_id"].to_numpy(), matrix(here["v"]), wanted["vec_id"].to_numpy(), matrix(wanted["v"])
            nx, nq = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
            for lo in range(0, len(q), 256):
                rough = (q[lo : lo + 256] @ x.T) / (nq[lo : lo + 256, None] * nx)
                rough[query[lo : lo + 256, None] == ids] = -np.inf
                least = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(rough), -np.inf)
                r, c = np.nonzero((rough >= least[:, None] - 1e-9) & (rough > -np.inf))
                # the same sum in the same order for equal vectors, so that ties are ties
                score = (q[lo + r] * x[c]).sum(1) / (nq[lo + r] * nx[c])
                order = np.lexsort((ids[c], -score, r))
                r, c, score = r[order], c[order], score[order]
                start = np.searchsorted(r, r)
                best = np.arange(len(r)) - start < k
                out[0].append(query[lo + r[best]])
                out[1].append(ids[c[best]])
                out[2].append(score[best])
        cols = [np.concatenate(o) if o else np.zeros(0, kind) for o, kind in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    keys = ["part", "block", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
