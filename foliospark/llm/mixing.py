"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves of a tree: domain, language, source. A token budget goes down the
tree: children share their parent's budget by weight, but none gets more than its
subtree can give (its tokens times ``max_epochs``); what one child cannot take goes to
its siblings, and only what they cannot take either reaches the parent's siblings.

Each leaf then takes a token-prefix of its seeded epochs: all documents as often as the
budget covers whole epochs, and of one more epoch, in the order of a seeded digest, the
longest run of documents from the start that fits what is left. The end of that run is
found by histograms over the digest's leading digits, so no leaf is sorted whole.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, writers

LEVELS = ["domain", "lang", "source"]
WORD = r"[^\x20\x09-\x0D]+"
#: Production weights; names that are not listed weigh 1.
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2}
LANG_WEIGHTS = {"en": 5, "fr": 2, "de": 2}


def default_domain() -> Column:
    """The domain of a source: its number modulo four; sources without one are of domain0."""
    return F.concat(F.lit("domain"), F.coalesce(F.expr("try_cast(regexp_replace(source, '[^0-9]', '') AS bigint)"), F.lit(0)) % 4)


def weight(col: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(col) == name, F.lit(w)).otherwise(out)
    return out.cast("decimal(10,0)")


def leaves(docs: DataFrame, domain: Column) -> DataFrame:
    """row (all columns), domain, lang, source (nulls are ''), tokens and a digest of id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(domain.cast("string"), F.lit("")).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)).alias("digest"),
    )


def shared_out(children: DataFrame, parent: list[str], name: str, weights: Mapping[str, int]) -> DataFrame:
    """``share`` of each child (columns parent..., name, cap, budget): its part of the parent's budget.

    Sorted by capacity over weight, the children that are filled are the first ones; the
    others share what is left by weight. Tokens lost to rounding down are fewer than the
    children. A window holds the children of one node, one row each.
    """
    rows = children.withColumn("w", weight(name, weights))
    order = W.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), F.col(name))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    big = "decimal(28,0)"
    rows = (
        rows.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(big))
        .withColumn("rest", F.sum("w").over(after).cast("decimal(10,0)"))
        .withColumn("full", F.col("cap").cast(big) * F.col("rest") <= F.col("w") * (F.col("budget").cast(big) - F.col("used")).cast(big))
    )
    node = W.partitionBy(*parent)
    rows = rows.withColumn("filled", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(node), F.lit(0)).cast(big)).withColumn(
        "open", F.sum(F.when(~F.col("full"), F.col("w"))).over(node).cast("decimal(10,0)")
    )
    part = F.expr("cast((w * cast(cast(budget as decimal(28,0)) - filled as decimal(28,0))) div open as bigint)")
    return rows.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("w", "used", "rest", "full", "filled", "open")


def budgets(narrow: DataFrame, percent: int, max_epochs: int, weights: list[Mapping[str, int]]) -> DataFrame:
    """domain, lang, source, whole (epochs) and left (tokens of one more epoch) of each leaf."""
    leaf = narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    leaf = materialise(leaf.withColumn("cap", F.col("tokens") * max_epochs), "leaves", 1)
    total = leaf.agg(F.sum("tokens")).first()[0] or 0
    above = None
    for depth, name in enumerate(LEVELS):
        parent = LEVELS[:depth]
        nodes = leaf.groupBy(*LEVELS[: depth + 1]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(total * percent // 100).cast("long"))
        else:
            nodes = nodes.join(above, parent)
        above = shared_out(nodes, parent, name, weights[depth]).select(*LEVELS[: depth + 1], F.col("share").alias("budget"), "tokens")
        if depth < len(LEVELS) - 1:
            above = above.drop("tokens")
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("int")
    return above.select(*LEVELS, whole.alias("whole"), (F.col("budget") - whole * F.col("tokens")).alias("left"))


def epoch_key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.col("digest")))


def thresholds(narrow: DataFrame, budget: DataFrame, seed: int) -> DataFrame:
    """Leaf columns, whole, and ``upto``: the largest key that the last, partial epoch takes (null: it has none)."""
    rows = narrow.join(budget.where("left > 0"), LEVELS).withColumn("key", epoch_key(F.col("whole"), seed))
    edge = budget.where("left > 0").select(*LEVELS, "left", F.lit("").alias("prefix"))
    for _ in range(2):  # two hexadecimal digits a time
        digits = F.substring("key", 1, F.length("prefix") + 2)
        inside = rows.drop("left").join(edge, LEVELS).where(F.expr("startswith(key, prefix)"))
        sums = inside.groupBy(*LEVELS, "left", digits.alias("bin")).agg(F.sum("tokens").alias("n"))
        upto = F.sum("n").over(W.partitionBy(*LEVELS).orderBy("bin"))
        sums = sums.withColumn("upto", upto).where("upto > left")
        edge = sums.groupBy(*LEVELS).agg(F.min_by(F.struct("bin", (F.col("left") - (F.col("upto") - F.col("n"))).alias("left")), "bin").alias("e"))
        edge = materialise(edge.select(*LEVELS, F.col("e.left").alias("left"), F.col("e.bin").alias("prefix")), "edges", 1)
    inside = rows.drop("left").join(edge, LEVELS).where(F.expr("startswith(key, prefix)")).groupBy(*LEVELS, "left", "key").agg(F.sum("tokens").alias("n"))
    taken = inside.withColumn("upto", F.sum("n").over(W.partitionBy(*LEVELS).orderBy("key"))).where("upto <= left")
    last = taken.groupBy(*LEVELS).agg(F.max("key").alias("last"))
    # without a document in the last bin, its bare prefix lies above all earlier keys and below its own
    return budget.join(edge.drop("left"), LEVELS, "left").join(last, LEVELS, "left").select(*LEVELS, "whole", F.coalesce("last", "prefix").alias("upto"))


def mixed(docs: DataFrame, percent: int = 60, max_epochs: int = 2, seed: int = 11, domain: Column | None = None, weights: list[Mapping[str, int]] | None = None, as_documents: bool = False) -> DataFrame:
    """The documents that the budget takes, once for each epoch that has them.

    ``percent``: the budget as a share of all tokens (words); ``weights`` by level.
    Columns doc_id, domain, lang, source, tokens, epoch (from 0), or with ``as_documents``
    those of ``docs`` alone. A null text has no tokens; a null language, source or domain is
    the name ''. Documents of one leaf with the same doc_id and text go together. A
    leaf without tokens, and so an empty table, gives nothing.
    """
    domain = default_domain() if domain is None else domain
    weights = weights or [DOMAIN_WEIGHTS, LANG_WEIGHTS, {}]
    all_rows = leaves(docs, domain)
    narrow = materialise(all_rows.drop("row"), "tokens", writers(docs.sparkSession, rows=docs.count()))
    budget = materialise(budgets(narrow, percent, max_epochs, weights), "budgets", 1)
    upto = materialise(thresholds(narrow, budget, seed), "thresholds", 1)
    # one row a leaf, and small enough to be broadcast unless there are very many leaves
    rows = all_rows.join(upto, LEVELS)
    one_more = F.coalesce(epoch_key(F.col("whole"), seed) <= F.col("upto"), F.lit(False))
    times = F.col("whole") + one_more.cast("int")
    rows = rows.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    if as_documents:
        return rows.select("row.*")
    return rows.select(F.col("row.doc_id").alias("doc_id"), *LEVELS, "tokens", "epoch")


def oracle(percent: int = 60, max_epochs: int = 2, seed: int = 11) -> str:
    """The same selection in DuckDB's SQL, with the production weights."""

    def case(col: str, weights: Mapping[str, int]) -> str:
        return "CASE " + col + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"

    def level(source: str, name: str, parent: str, weights: Mapping[str, int]) -> str:
        over = f"PARTITION BY {parent}" if parent else ""
        keys = f"{parent}, {name}" if parent else name
        return f"""
{name}_a AS (SELECT {keys}, cap, tokens, budget, {case(name, weights)} AS w FROM {source}),
{name}_b AS (SELECT *, coalesce(sum(cap) OVER ({over} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(w) OVER ({over} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}_a),
{name}_c AS (SELECT *, cap * rest <= w * (budget - used) AS fits FROM {name}_b),
{name}_d AS (SELECT *, coalesce(sum(CASE WHEN fits THEN cap END) OVER ({over}), 0) AS filled, sum(CASE WHEN NOT fits THEN w END) OVER ({over}) AS open_w FROM {name}_c),
{name}_s AS (SELECT {keys}, tokens, CAST(CASE WHEN fits THEN cap ELSE (w * (budget - filled)) // open_w END AS HUGEINT) AS share FROM {name}_d)"""

    return f"""
WITH d AS (
  SELECT doc_id, 'domain' || CAST(coalesce(TRY_CAST(regexp_replace(source, '[^0-9]', '', 'g') AS BIGINT), 0) % 4 AS VARCHAR) AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS tokens,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS tokens, CAST(sum(tokens) * {max_epochs} AS HUGEINT) AS cap FROM d GROUP BY ALL),
n1 AS (SELECT domain, CAST(sum(cap) AS HUGEINT) AS cap, CAST(sum(tokens) AS HUGEINT) AS tokens, (SELECT CAST(sum(tokens) AS HUGEINT) FROM leaf) * {percent} // 100 AS budget FROM leaf GROUP BY domain),
{level("n1", "domain", "", DOMAIN_WEIGHTS).strip()},
n2 AS (SELECT domain, lang, CAST(sum(leaf.cap) AS HUGEINT) AS cap, CAST(sum(leaf.tokens) AS HUGEINT) AS tokens, any_value(share) AS budget FROM leaf JOIN domain_s USING (domain) GROUP BY domain, lang),
{level("n2", "lang", "domain", LANG_WEIGHTS).strip()},
n3 AS (SELECT domain, lang, source, leaf.cap AS cap, leaf.tokens AS tokens, share AS budget FROM leaf JOIN lang_s USING (domain, lang)),
{level("n3", "source", "domain, lang", {}).strip()},
b AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS whole, share - CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END * tokens AS rest FROM source_s),
k AS (SELECT d.*, whole, rest, md5('{seed}:' || CAST(whole AS VARCHAR) || ':' || digest) AS key FROM d JOIN b USING (domain, lang, source)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k),
t AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM c)
SELECT doc_id, domain, lang, source, tokens, CAST(e AS INTEGER) AS epoch FROM (SELECT *, unnest(range(CAST(times AS BIGINT))) AS e FROM t) AS x
"""
