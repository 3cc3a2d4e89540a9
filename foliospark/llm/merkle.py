"""Merkle manifest of a dataset: an append log of nodes in postorder, and proofs read from it.

The rows of each group are leaves in order; every eight consecutive nodes become their parent
until one is left. A tree is built by aligned builders: builder b of a round has 8**4
nodes, those from b * 8**4 on, however the rows were dealt, and writes its nodes to its log in the order in
which they are completed, so that children stand before their parent. Its last node is a
node of the next round. The groups' tops are the leaves of one more tree.

Where a node stands follows from the sizes of the subtrees before it alone: with e the end of its
leaves, all nodes that end before e, sum((e - 1) // 8**k), and the ones below it that
end there too, its level. A proof reads the siblings of each level at these places of
its builder's log, and the rest of the way from the log of the builder above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import digests, materialise, tidied, writers

#: Children of a node, and levels of a builder, which has FANOUT**LEVELS leaves.
FANOUT, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The siblings of each level from a node up, those before it and those after it.
PATH = "array<struct<before:string,after:string>>"


def position(level: int, end: int) -> int:
    """Place in the log of the node of ``level`` whose leaves end at ``end``."""
    before, count = end - 1, level
    while before:
        count += before
        before //= FANOUT
    return count


def height(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    up = 0
    while leaves > 1:
        leaves, up = -(-leaves // FANOUT), up + 1
    return up


def parent(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def appended(leaves: list[str], levels: int) -> list[str]:
    """The log of a builder over its leaves: every node when its last leaf is there."""
    log: list[str] = []
    open_nodes: list[list[str]] = [[] for _ in range(levels + 1)]
    for i, leaf in enumerate(leaves):
        node, level = leaf, 0
        while True:
            log.append(node)
            open_nodes[level].append(node)
            last = i == len(leaves) - 1
            if level == levels or len(open_nodes[level]) < FANOUT and not last:
                break
            node = parent(open_nodes[level])
            open_nodes[level], level = [], level + 1
    return log


def siblings(log: list[str], leaves: int, levels: int, leaf: int) -> list[tuple[str, str]]:
    """For each level, the other nodes of the run that ``leaf`` is under, before and after its own."""
    out = []
    for level in range(levels):
        width, own = FANOUT**level, leaf // FANOUT**level
        first = own - own % FANOUT
        end = min(first + FANOUT, -(-leaves // width))
        run = [log[position(level, min((j + 1) * width, leaves))] for j in range(first, end)]
        out.append(("".join(run[: own - first]), "".join(run[own - first + 1 :])))
    return out


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        leaf = sha256(f"{before}{leaf}{after}".encode()).hexdigest()
    return leaf


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: each field as its byte count and value, or ``-``."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def indexed(rows: DataFrame, order: list[str], name: str, parts: int) -> DataFrame:
    """``rows`` (with a text ``k``) with ``idx``, their place in their group by ``order``, nulls first, and ``total``, the group's size.

    Rows are dealt by range, so that a group may go over many tasks; a task counts its rows, and the
    counts of each group and task, as many as tasks and groups, give the place of its first one.
    ``order`` must be strict; ``parts`` tasks sort and write.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("k", *order)]
    ranged = rows.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*keys)
    at = rows.columns.index("k")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen = None, 0
        for batch in batches:
            places = []
            for k in batch.column(at).to_pylist():
                group, seen = k, seen + 1 if k == group else 0
                places.append(seen)
            yield pa.record_batch([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "place"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    placed = materialise(ranged.mapInArrow(tidied(count), kinds + ", place long"), f"{name}-placed", parts)
    counts = placed.groupBy("k", "part").agg(F.count("*").alias("n"))
    by_part = Window.partitionBy("k").orderBy("part")
    first = counts.select("k", "part", (F.sum("n").over(by_part) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy("k")).alias("total"))
    found = placed.join(first, ["k", "part"]).select(*rows.columns, (F.col("first") + F.col("place")).alias("idx"), "total")
    return materialise(found, f"{name}-indexed", parts)


def levels_of(total: int, levels: int) -> int:
    """Levels of a builder's tree: all of them, unless it is its group's only one."""
    return height(total) if total <= FANOUT**levels else levels


def build(nodes: DataFrame, name: str, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of a tree for each ``k``, and their tops ``k``, ``digest``.

    ``nodes``: k, idx, total, digest. A round has a row a builder: k, block, total (nodes of the
    group in this round), log. A group is done in the round in which one builder holds it.
    """
    spark, size = nodes.sparkSession, FANOUT**levels
    largest = nodes.agg(F.max("total")).first()[0] or 0

    def write(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        total = group["total"][0].as_py()
        log = appended(group["digest"].to_pylist(), levels_of(total, levels))
        raw = bytes.fromhex("".join(log))
        row = {"k": [group["k"][0].as_py()], "block": [group["idx"][0].as_py() // size], "total": [total], "log": [raw]}
        return pa.table(row, pa.schema([("k", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("log", pa.binary())]))

    rounds, tops = [], []
    while True:
        cut = nodes.select("k", "idx", "total", "digest").groupBy("k", F.expr(f"idx div {size}").alias("block"))
        logs = materialise(cut.applyInArrow(write, "k string, block long, total long, log binary"), f"{name}-log", writers(spark, rows=largest))
        rounds.append(logs)
        top = F.lower(F.hex(F.expr("substring(log, -32, 32)"))).alias("digest")
        tops.append(logs.where(F.col("total") <= size).select("k", top))
        if largest <= size:
            break
        largest = -(-largest // size)
        nodes = logs.where(F.col("total") > size).select("k", F.col("block").alias("idx"), F.expr(f"(total + {size - 1}) div {size}").alias("total"), top)
    done = tops[0]
    for more in tops[1:]:
        done = done.union(more)
    return rounds, done


def opened(log: bytes) -> list[str]:
    text = log.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def with_paths(rounds: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The first round's builders with ``path``, the siblings from their top to the root; ``above``: k and the path from the group's top."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = row["block"] * size
                count, log, up = min(row["total"] - first, size), opened(row["log"]), levels_of(row["total"], levels)
                paths = [[{"before": b, "after": a} for b, a in siblings(log, count, up, i)] + row["path"] for i in range(count)]
                yield pa.record_batch([pa.array([row["k"]] * count), pa.array(range(first, first + count), pa.int64()), pa.array(paths, kind)], ["k", "block", "path"])

    size = FANOUT**levels
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    found: DataFrame | None = None
    for logs in reversed(rounds):
        lone = logs.where(F.col("total") <= size).join(above, "k").select("k", "block", "total", "log", "path")
        more = logs.where(F.col("total") > size)
        held = lone if found is None else lone.union(more.join(found, ["k", "block"]).select("k", "block", "total", "log", "path"))
        found = held.mapInArrow(tidied(extend), f"k string, block long, path {PATH}")
    return held


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id",
    changed: Callable[[DataFrame], tuple[Column, dict[str, Column]]] | None = None, levels: int = LEVELS,
) -> DataFrame:
    """A row for each row of ``docs``: its leaf, the roots, the digest of its proof, and what the proof gives now.

    Columns: ``order``'s name, leaf, subroot, root, proof_sha256 (siblings from the leaf to the root), folded_root (the
    root that the row as it is now, ``changed``, gives with the siblings of the log), verified, and the
    group's name and ``idx``, the place of the leaf in its group. ``changed`` takes the rows and gives a condition
    and the columns that are others where it holds. A null is a value of its own in every field; null groups
    and orders come first. Rows that agree in the order follow each other by leaf; equal rows are
    leaves each. A lone leaf is its group's root and has no siblings, and an empty table
    has no rows. Columns of ``docs`` other than the fields are not read.
    """
    fresh = {f: F.col(f"`{f}`") for f in fields}
    leaf = leaf_digest([*fresh.values()])
    now = leaf
    if changed is not None:
        where, other = changed(docs)
        now = F.when(where, leaf_digest([other.get(f, c) for f, c in fresh.items()])).otherwise(leaf)
    name = F.col(f"`{group}`").cast("string")
    key = F.coalesce(F.concat(F.lit("="), name), F.lit(""))
    leaves = docs.select(key.alias("k"), F.col(f"`{order}`").alias("o"), leaf.alias("digest"), now.alias("now"), F.monotonically_increasing_id().alias("row"))
    parts = writers(docs.sparkSession, rows=docs.count())
    leaves = indexed(materialise(leaves, "merkle-leaves", parts), ["o", "digest", "row"], "merkle", parts)
    rounds, subroots = build(leaves, "merkle", levels)
    # the groups' tops are the leaves of the last tree, in the order of their names
    parts = writers(docs.sparkSession, rows=subroots.count())
    tops = materialise(subroots.select(F.lit("").alias("k"), F.col("k").alias("name"), "digest"), "merkle-tops", parts)
    tops = indexed(tops, ["name"], "merkle-tops", parts)
    root_rounds, roots = build(tops, "merkle-root", levels)
    none = F.array().cast(PATH)
    root_logs = with_paths(root_rounds, roots.select("k", none.alias("path")), levels)
    above = proved(root_logs, levels, tops.select("k", "idx", "total", "digest", F.col("digest").alias("now"), F.col("name").alias("o")), "o string", keep_path=True)
    above = materialise(above.select(F.col("o").alias("k"), "path", "root", F.col("leaf").alias("subroot")), "merkle-above", parts)
    logs = with_paths(rounds, above.select("k", "path"), levels).join(above.select("k", "subroot", "root"), "k")
    kind = docs.schema[order].dataType.simpleString()
    done = digests(proved(logs, levels, leaves, f"o {kind}"))
    shown = F.when(F.col("k") != "", F.expr("substring(k, 2)"))
    return done.select(
        F.col("o").alias(order), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), shown.alias(group), "idx",
    )


def proved(logs: DataFrame, levels: int, leaves: DataFrame, order: str, keep_path: bool = False) -> DataFrame:
    """Proofs of ``leaves`` (k, idx, total, digest, now, o) from the builders' logs with their ways up.

    With ``keep_path`` for the last tree, whose tops are roots; without, ``logs`` has subroot and root.
    """

    def prove(key: tuple, mine: pa.Table, log: pa.Table) -> pa.Table:
        held, total = opened(log["log"][0].as_py()), log["total"][0].as_py()
        way = [(p["before"], p["after"]) for p in log["path"][0].as_py()]
        count, up = min(total - key[1].as_py() * size, size), levels_of(total, levels)
        leaf, proof, now, paths = [], [], [], []
        for place, value in zip(mine["idx"].to_pylist(), mine["now"].to_pylist(), strict=True):
            path = siblings(held, count, up, place % size) + way
            leaf.append(held[position(0, place % size + 1)])
            proof.append(sha256("".join(b + a for b, a in path).encode()).hexdigest())
            now.append(folded(value, path))
            paths.append([{"before": b, "after": a} for b, a in path] if keep_path else None)
        roots = [leaf, now] if keep_path else [[log[c][0].as_py()] * len(leaf) for c in ("subroot", "root")]
        cols = [pa.array(c, pa.string()) for c in (leaf, *roots, proof, now)]
        return pa.table([mine["k"], mine["o"], mine["idx"], *cols, pa.array(paths, kind)], names)

    size = FANOUT**levels
    names = ["k", "o", "idx", "leaf", "subroot", "root", "proof_sha256", "folded_root", "path"]
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    block = F.expr(f"idx div {size}").alias("block")
    mine = leaves.select("k", "o", "idx", "now", block).groupBy("k", "block")
    held = logs.groupBy("k", "block")
    schema = f"k string, {order}, idx long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, path {PATH}"
    return mine.cogroup(held).applyInArrow(prove, schema)


def lowered(docs: DataFrame) -> tuple[Column, dict[str, Column]]:
    """The tampering of the query: where 3 divides the checksum of doc_id, A-Z of the text are lower-cased."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 0, {"text": F.translate(F.col("text").cast("string"), UPPER, UPPER.lower())}


def oracle(levels: int = 8) -> str:
    """The same by plain levels of ``levels`` rounds at most, with siblings by joins."""

    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"

    bits = "flatten([[CAST(ascii(c) AS BIGINT)] || [-1::BIGINT for i in range(8)] for c in string_split(CAST(doc_id AS VARCHAR), '')])"
    crc = f"xor(list_reduce([4294967295::BIGINT] || {bits}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"
    ctes = [
        f"leaves AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY k, doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM "
        f"(SELECT doc_id, coalesce('=' || lang, '') AS k, {digest('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {digest(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} ELSE {digest('text')} END AS now FROM documents))"
    ]

    def tree(p: str, nodes: str, folds: str) -> tuple[str, str]:
        """Levels p0, p1, ... of nodes (k, idx, h, n), and of each document's fold pf0, pf1, ... (id, k, place, now, proof); the last ones' names."""
        ctes.append(f"{p}0 AS MATERIALIZED (SELECT k, idx, leaf AS h, count(*) OVER (PARTITION BY k) AS n FROM {nodes})")
        ctes.append(f"{p}f0 AS MATERIALIZED (SELECT id, k, idx AS place, now, proof FROM {folds})")
        for i in range(levels):
            up = f"SELECT k, idx // {FANOUT} AS idx, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM {p}{i} GROUP BY k, idx // {FANOUT}"
            ctes.append(f"{p}{i + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM ({up}))")
            near = f"""SELECT f.id, max(f.k) AS k, max(f.place) AS place, max(f.now) AS now, max(f.proof) AS proof, max(t.n) AS n,
                coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx < f.place), '') AS before, coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx > f.place), '') AS after
                FROM {p}f{i} f JOIN {p}{i} t ON t.k = f.k AND t.idx // {FANOUT} = f.place // {FANOUT} GROUP BY f.id"""
            ctes.append(f"{p}f{i + 1} AS MATERIALIZED (SELECT id, k, place // {FANOUT} AS place, CASE WHEN n = 1 THEN now ELSE sha256(before || now || after) END AS now, proof || before || after AS proof FROM ({near}))")
        return f"{p}{levels}", f"{p}f{levels}"

    ctes.append("base AS MATERIALIZED (SELECT *, '' AS proof FROM leaves)")
    sub, sub_folds = tree("s", "base", "base")
    ctes.append(f"tops AS MATERIALIZED (SELECT '' AS k, k AS name, h AS leaf, row_number() OVER (ORDER BY k) - 1 AS idx FROM {sub})")
    ctes.append(f"whole AS MATERIALIZED (SELECT f.id, '' AS k, t.idx, f.now, f.proof FROM {sub_folds} f JOIN tops t ON t.name = f.k)")
    root, folds = tree("r", "tops", "whole")
    return f"""WITH {", ".join(ctes)}
        SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.now AS folded_root, f.now = r.h AS verified, substr(nullif(l.k, ''), 2) AS lang, l.idx
        FROM leaves l JOIN {folds} f ON f.id = l.id JOIN {sub} s ON s.k = l.k CROSS JOIN {root} r"""
