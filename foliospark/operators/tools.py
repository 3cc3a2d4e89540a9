"""The four tools of a question-answering agent: each is a query that gives one text.

They are what an agent loop or a server calls; the loop itself is not part of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import Tokenizer
from . import catalog as C
from . import pages, search


#: Ranges of postings that a task scores; their notes' matches with all questions lie in its memory.
TASK_RANGES = 4

#: Table functions of SQL over the views of ``register``; ``{p}`` is the name that they share.
FUNCTIONS = (
    r"""search_wiki(q STRING) RETURNS TABLE(path STRING, title STRING, type STRING, summary STRING, score_micro BIGINT) RETURN
    SELECT c.path, c.title, c.type, c.summary, s.score_micro FROM (
        SELECT note AS path, CAST(floor(aggregate(array_sort(collect_list(struct(pos, adds))), 0D, (a, x) -> a + x.adds) * 1e6D) AS BIGINT) AS score_micro
        FROM (SELECT t.pos, p.range, p.note, ln(1 + (p.notes - p.df + 0.5D) / (p.df + 0.5D)) * p.tf * 2.5D / (p.tf + 1.5D * (0.25D + 0.75D * p.size / greatest(p.mean, 1e-12D))) AS adds
            FROM (SELECT posexplode(array_distinct(filter(split(lower(search_wiki.q), '\\s+'), x -> x <> ''))) AS (pos, term)) t JOIN {p}_postings p ON p.term = t.term)
        GROUP BY range, note ORDER BY score_micro DESC, path LIMIT 10) s JOIN {p}_catalog c ON c.path = s.path WHERE s.score_micro >= 0""",
    "read_page(page STRING) RETURNS TABLE(path STRING, text STRING) RETURN SELECT n.path, n.text FROM {p}_pages n WHERE n.path = CASE WHEN read_page.page LIKE '%.md' THEN read_page.page ELSE read_page.page || '.md' END",
    "get_related(page STRING) RETURNS TABLE(path STRING, title STRING) RETURN SELECT r.related, r.title FROM {p}_related r WHERE r.path = CASE WHEN get_related.page LIKE '%.md' THEN get_related.page ELSE get_related.page || '.md' END",
    "read_raw_source(name STRING) RETURNS TABLE(text STRING) RETURN SELECT r.text FROM {p}_raw r WHERE r.source = read_raw_source.name",
)


def register(spark: SparkSession, catalog: DataFrame, postings: DataFrame, notes: DataFrame, raw: DataFrame | None = None, name: str = "wiki", tokenizer: Tokenizer | None = None) -> None:
    """The tools as temporary table functions of SQL: ``SELECT * FROM search_wiki('holding pattern')``.

    With a lateral join they answer a table of questions in one job: ``SELECT id, s.* FROM asked, LATERAL search_wiki(question) s``. All
    of them meet their views by equality, on terms, paths and sources, so many questions are a join. ``postings``: the stored
    table of ``postings.blocks``; ``notes``: path, content; ``raw``: source, page, text.
    """
    catalog.createOrReplaceTempView(f"{name}_catalog")
    # a note's postings lie in one task before they meet the questions: scores are summed, and all but a question's best left out, where they are made
    ranges = postings.agg(F.max("range")).first()[0]
    dealt = postings.repartition(1 + (ranges or 0) // TASK_RANGES, "range")
    each = dealt.select("term", "range", "df", "notes", "mean", F.inline(F.arrays_zip("paths", "tfs", "sizes")))
    each.select("term", "range", "df", "notes", "mean", F.col("paths").alias("note"), F.col("tfs").cast("double").alias("tf"), F.col("sizes").alias("size")).createOrReplaceTempView(f"{name}_postings")
    notes.select("path", pages.page_text(F.col("path"), F.col("content"), tokenizer=tokenizer).alias("text")).createOrReplaceTempView(f"{name}_pages")
    one = C.related_notes(catalog).select("path", F.posexplode("related").alias("place", "related"))
    titles = catalog.select(F.col("path").alias("related"), "title")
    one.join(titles, "related", "left").select("path", "related", F.coalesce("title", "related").alias("title")).createOrReplaceTempView(f"{name}_related")
    if raw is not None:
        pages.read_raw(raw.select("source", F.col("page").alias("ord"), "text"), tokenizer=tokenizer).createOrReplaceTempView(f"{name}_raw")
    for body in FUNCTIONS[: 3 if raw is None else 4]:
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION " + body.replace("{p}", name))


def search_wiki(catalog: DataFrame, notes: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Ranked notes of a keyword query, by catalog and content."""
    return search.formatted(search.hybrid_search(catalog, notes, query, k))


def read_page(catalog: DataFrame, notes: DataFrame, path_or_title: str, limit: int = pages.PAGE_TOKENS, tokenizer: Tokenizer | None = None) -> DataFrame:
    """A page by its path or title."""
    return pages.resolved_read(notes, path_or_title, limit, catalog, tokenizer)


def get_related(catalog: DataFrame, path: str) -> DataFrame:
    """Pages that a page links to or that link to it."""
    one = C.related_notes(C.entry(catalog, path))
    said = C.related_lines(one, catalog).select("text", F.lit(0).alias("origin"))
    none = catalog.sparkSession.range(1).select(F.lit(f"No related pages found for '{path}'.").alias("text"), F.lit(1).alias("origin"))
    return said.union(none).orderBy("origin").limit(1).select("text")


def read_raw_source(pages_: DataFrame, toc: DataFrame, source: str, query: str = "", focus: str = "", limit: int = 3000, tokenizer: Tokenizer | None = None) -> DataFrame:
    """An excerpt of a raw source: the section that ``query`` means, or its first pages.

    ``pages_``: source, page, text; ``toc``: the source's table of contents.
    """
    own = pages_.where(F.col("source") == source)
    if query:
        return pages.jump_text(toc, own.select(F.col("page").alias("page_no"), "text"), query, focus, limit, source, tokenizer)
    said = pages.read_raw(own.select("source", F.col("page").alias("ord"), "text"), limit, tokenizer).select("text", F.lit(0).alias("origin"))
    none = toc.sparkSession.range(1).select(F.lit(f"[Raw source not found: {source}]").alias("text"), F.lit(1).alias("origin"))
    return said.union(none).orderBy("origin").limit(1).select("text")
