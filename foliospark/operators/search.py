"""Catalog, content and hybrid search, and title resolution.

Searches read the stored catalog, which has each note's tokens, and not the texts. BM25
needs no exploded tokens and no shuffle: one pass aggregates counts, lengths and document
frequencies of the query's terms to one row, a second one scores each note from the
occurrences of those terms in its token array and keeps the top k.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.5, 0.75


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(query.lower().split()))


def occurrences(term: str) -> Column:
    return F.size(F.filter("tokens", lambda t: t == term)).cast("double")


def corpus_stats(docs: DataFrame, terms: list[str]) -> tuple[int, float, list[int]]:
    """Documents, mean length and document frequency of each term; ``docs`` has ``tokens``."""
    row = docs.agg(F.count("*"), F.sum(F.size("tokens")), *(F.count_if(F.array_contains("tokens", t)) for t in terms)).first()
    n = row[0]
    return n, (row[1] or 0) / n if n else 0.0, list(row[2:])


def bm25(docs: DataFrame, query: str) -> DataFrame:
    """``docs`` with ``score``; an empty query scores zero."""
    terms = query_terms(query)
    n, mean, df = corpus_stats(docs, terms)
    score = F.lit(0.0)
    for term, d in zip(terms, df, strict=True):
        tf = occurrences(term)
        idf = F.log(F.lit(1 + (n - d + 0.5) / (d + 0.5)))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("tokens") / max(mean, 1e-12)))
    return docs.withColumn("score", score)


def micro(score: Column) -> Column:
    return F.floor(score * 1e6).cast("long")


def catalog_search(notes: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The k best notes with a positive score; ties by path."""
    scored = bm25(notes, query).withColumn("score_micro", micro(F.col("score")))
    return scored.where("score > 0").orderBy(F.desc("score_micro"), "path").limit(k)


def usable(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine that runs the pattern, Java's, takes it."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (IllegalArgumentException, Py4JJavaError):
        return False
    return True


def content_matches(notes: DataFrame, pattern: str) -> DataFrame:
    """Notes whose content holds the pattern, whatever the case; a bad pattern matches nothing."""
    whole = f"(?iu){pattern}"  # letters beyond A-Z too
    return notes.where(F.col("content").rlike(whole) if usable(notes.sparkSession, whole) else F.lit(False))


def content_search(catalog: DataFrame, notes: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The first 2k catalogued matches by path, scored among themselves; zero scores stay.

    ``notes`` (path, content) are only scanned for the pattern; what is shown and scored is
    the catalog's, by a semi join.
    """
    hits = catalog.join(content_matches(notes, query).select("path"), "path", "left_semi").orderBy("path").limit(2 * k)
    scored = bm25(hits, query).withColumn("score_micro", micro(F.col("score")))
    return scored.orderBy(F.desc("score_micro"), "path").limit(k)


def hybrid_search(catalog: DataFrame, notes: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Catalog and content results, one row a path with the catalog's score kept."""
    cols = ["path", "title", "type", "summary", "keywords", "sections", "score_micro"]
    both = catalog_search(catalog, query, k).select(*cols, F.lit(0).alias("origin")).union(content_search(catalog, notes, query, k).select(*cols, F.lit(1)))
    first = F.row_number().over(W.partitionBy("path").orderBy("origin"))  # at most 2k rows
    return both.withColumn("turn", first).where("turn = 1").drop("turn", "origin").orderBy(F.desc("score_micro"), "path").limit(k)


def overlap(title: Column, words: list[str]) -> Column:
    """Share of the query's distinct words that a title has."""
    return F.size(F.array_intersect(T.tokens(title), F.array(*(F.lit(w) for w in words)))) / F.lit(float(len(words)))


def resolve_title(notes: DataFrame, query: str, least: float = 0.35) -> DataFrame:
    """The note that a title means: exact, path, part of the title, all words, best overlap; the first by path in a stage."""
    query = query.strip().lstrip("[").split("|")[0].rstrip("]").strip()
    q, words = query.lower(), query_terms(query)
    if not words:
        return notes.select("*", F.lit(None).cast("int").alias("stage"), F.lit(0.0).alias("share")).limit(0)
    title = F.lower("title")
    stage = F.when(title == q, 1).when((F.col("path") == query) | (F.col("path") == query + ".md"), 2).when(F.contains(title, F.lit(q)), 3)
    if len(words) > 1:
        stage = stage.when(F.forall(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(title, w)), 4)
    share = overlap(F.col("title"), words)
    stage = stage.when(share >= least, 5)
    rank = F.when(F.col("stage") == 5, -F.col("share")).otherwise(F.lit(0.0))
    found = notes.withColumn("stage", stage).withColumn("share", share).where("stage is not null")
    return found.orderBy("stage", rank, "path").limit(1)


def suggestions(notes: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Titles with the largest word overlap."""
    return notes.withColumn("share", overlap(F.col("title"), query_terms(query))).where("share > 0").orderBy(F.desc("share"), "path").limit(k)


def formatted(results: DataFrame) -> DataFrame:
    """Results in order as one text; a fixed sentence where there are none. ``results`` is a top-k list."""
    place = F.row_number().over(W.orderBy(F.desc("score_micro"), "path"))
    thousandths = F.floor((F.col("score_micro") + 500) / 1000)  # half a thousandth goes up, as in print
    milli = F.format_string("%d.%03d", F.floor(thousandths / 1000), thousandths % 1000)
    section = F.when(F.size("sections") > 0, F.concat(F.lit(" \u00a7 "), F.array_join("sections", ", "))).otherwise("")
    line = F.concat(
        place.cast("string"), F.lit(". **"), "title", F.lit("** `["), "type", F.lit("]"), section, F.lit("` _(score: "), milli, F.lit(")_\n   Path: `"), "path",
        F.lit("`\n   Summary: "), "summary", F.lit("\n   Keywords: "), F.array_join("keywords", ", "), F.lit("\n"),
    )
    rows = results.select(place.alias("place"), line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
    text = F.concat(F.lit("## Wiki Search Results\n\n"), F.array_join(lines, "\n"))
    return rows.agg(F.when(F.count("*") == 0, F.lit("No matching pages found in the wiki.")).otherwise(text).alias("text"))
