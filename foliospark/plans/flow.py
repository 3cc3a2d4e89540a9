"""The ingestion flow from documents to a stored catalog, composed of the operators; each step is a DataFrame.

Short documents are read in a single pass. Longer ones are cut at the pages of their table of
contents if they have one, at their headings where there are enough, else at the sections that a sectionizer finds; one of
which nothing can be cut is read in a single pass too. Chunks are parts of the text as it
stands; they are packed in batches, an extractor makes a note of each batch, similar notes of a
document are merged. Every document has a note, or a pending row that says why not.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, consolidate, ingest, sections
from ..sources import files, store


def with_sections(docs: DataFrame, sectionizer: sections.Sectionizer) -> DataFrame:
    """``docs`` (text, strategy) with ``sections``: an array of ord, title, start_marker, end_marker, from the heading lines of a text or a sectionizer; and ``failed``, why that found none.

    A text's sections stay in its row, so that they need not be brought to it.
    """
    line = lambda x, k: F.struct(k.alias("ord"), F.trim(x).alias("title"), T.is_heading(x).alias("is_heading"))
    heads = F.filter(F.transform(F.split("text", "\n"), line), lambda x: x["is_heading"])
    found = sections.sections_found(F.when(F.col("strategy") == "llm", F.col("text")), sectionizer)
    rows = docs.withColumn("heads", F.when(F.col("strategy") == "regex", heads)).withColumn("found", found)

    def headed(x, k):
        behind = F.coalesce(F.get("heads", k + 1)["title"], F.lit(sections.END))
        return F.struct(x["ord"].alias("ord"), x["title"].alias("title"), x["title"].alias("start_marker"), behind.alias("end_marker"))

    def told(x):
        return F.struct(x["ord"].alias("ord"), T.section_title(x["title"], x["start_marker"], x["ord"]).alias("title"), x["start_marker"].alias("start_marker"), x["end_marker"].alias("end_marker"))

    by_model = F.transform(F.filter("found", lambda x: x["error"].isNull()), told)
    failed = F.array_min(F.transform("found", lambda x: x["error"]))
    return rows.withColumn("sections", F.coalesce(F.transform("heads", headed), by_model)).withColumn("failed", failed).drop("heads", "found")


def page_chunks(docs: DataFrame, toc: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, ord, title, chunk of the documents' sections by the pages of their tables of contents."""
    own = toc.join(docs.select("doc_id"), "doc_id", "left_semi")
    total = pages.groupBy("doc_id").agg(F.max("page_no").alias("total_pages"))
    found = sections.toc_sections(own.join(total, "doc_id"), by=("doc_id",))
    bounds = found.select("doc_id", F.col("ord").cast("int").alias("ord"), "title", F.col("page_start").alias("page"), F.col("page_end").alias("behind"))
    return sections.page_sections(bounds, pages, by=("doc_id",))


class Cut(NamedTuple):
    """``documents``: doc_id, text, why, parts (an array of ord, title, chunk and place, null for a single pass), and ``paged``: doc_id, ord, title, chunk of those that are cut at their pages, if any."""

    documents: DataFrame
    paged: DataFrame | None


def cut(docs: DataFrame, sectionizer: sections.Sectionizer, toc: DataFrame | None, pages: DataFrame | None) -> Cut:
    """Documents with their chunks, by the strategy that the length, table of contents and headings of each call for.

    A text is cut in its row and not exchanged; only what has a table of contents meets its pages.
    """
    told = sections.with_strategy(docs.select("doc_id", "text").where("doc_id is not null"), toc)
    rows = sections.with_parts(with_sections(told, sectionizer), 80)
    why = F.when(F.col("strategy") == "single", "short").otherwise(F.coalesce(F.concat(F.lit("sectionizer failed: "), "failed"), F.lit("no section found")))
    rows = rows.select("doc_id", "text", "strategy", why.alias("why"), "parts")
    if toc is None or pages is None:
        return Cut(rows.drop("strategy"), None)
    rows = store.written(rows, "told")
    listed = rows.where("strategy = 'toc'")
    paged = store.written(page_chunks(listed, toc, pages), "paged")
    rest = listed.join(paged.select("doc_id").distinct(), "doc_id", "left_anti")
    return Cut(rows.where("strategy <> 'toc'").unionByName(rest).drop("strategy"), paged)


def chunks(docs: DataFrame, sectionizer: sections.Sectionizer = sections.by_stride, toc: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """source_id, ord, title, text, why: the chunks of each document (doc_id, text).

    ``toc``: doc_id, ord, level, title, page; ``pages``: doc_id, page_no, text. A document that is read in a single
    pass is one chunk of ord -1, whole, with ``why``: it is short, its sectionizer failed, or no section of it was found.
    """
    rows, paged = cut(docs, sectionizer, toc, pages)
    rows = rows.select("doc_id", "text", "why", F.explode_outer("parts").alias("p"))
    whole = F.col("p").isNull()
    title = F.when(whole, F.concat(F.lit("Document "), F.col("doc_id").cast("string"))).otherwise(F.col("p.title"))
    text = F.when(whole, F.col("text")).otherwise(F.col("p.chunk"))
    out = rows.select(F.col("doc_id").alias("source_id"), F.coalesce("p.ord", F.lit(-1)).alias("ord"), title.alias("title"), text.alias("text"), F.when(whole, F.col("why")).alias("why"))
    return out if paged is None else out.union(paged.select("doc_id", "ord", "title", "chunk", F.lit(None).cast("string")))


def batches(docs: DataFrame, batch_chars: int, sectionizer: sections.Sectionizer, toc: DataFrame | None, pages: DataFrame | None) -> DataFrame:
    """source_id, batch, of, rendered: what an extractor reads, and how many batches the document has, if that is known. A document in a single pass is its own batch, as it stands."""
    rows, paged = cut(docs, sectionizer, toc, pages)
    rows = rows.select("doc_id", "text", sections.batched(F.col("parts"), batch_chars).alias("texts"))
    rows = rows.select("doc_id", F.coalesce("texts", F.array("text")).alias("texts"))
    out = rows.select(F.col("doc_id").alias("source_id"), F.size("texts").alias("of"), F.posexplode("texts").alias("batch", "rendered")).select("source_id", "batch", "of", "rendered")
    if paged is None:
        return out
    texts = sections.batch_texts(paged.select(F.col("doc_id").alias("source_id"), "ord", "title", F.col("chunk").alias("text")), batch_chars, -1)
    return out.union(texts.select("source_id", "batch", F.lit(None).cast("int"), "rendered"))


def extracted(batches: DataFrame, extractor: ingest.Extractor = ingest.extractive) -> DataFrame:
    """source, ord, of, title, type, summary, keywords, content, error: the note of each batch (source_id, batch, of, rendered), or why there is none."""
    store.small_batches()
    rows = batches.select(F.struct("source_id", "batch", "of").alias("doc_id"), F.col("rendered").alias("text"))
    notes = ingest.extract(rows, extractor)
    error = F.when(F.col("error").isNull() & (F.col("title").isNull() | F.col("type").isNull()), F.lit("a note without title or type")).otherwise(F.col("error"))
    return notes.select(F.col("doc_id.source_id").cast("string").alias("source"), F.col("doc_id.batch").alias("ord"), "doc_id.of", "title", "type", "summary", "keywords", "content", error.alias("error"))


def consolidated(notes: DataFrame, merger: consolidate.Merger = consolidate.first_and_all, least: int = 5) -> DataFrame:
    """source, title, type, summary, keywords, content, members: notes of a document with similar titles are merged.

    The note of a document of one batch (``of``) is alone and stays where it is.
    """
    cols = ["title", "type", "summary", "keywords", "content"]
    alone, others = notes.where("of = 1"), notes.where("of is null or of > 1")  # one is not known of a ledger's rows
    seeds = consolidate.clusters(others, least=least).drop("n")
    found = others.join(seeds, ["source", "type", "title"])
    key = F.to_json(F.struct("source", "type", "seed"))
    out = consolidate.merged(found.select(key.alias("cluster"), "ord", *cols), merger)
    merged = out.select(F.get_json_object("cluster", "$.source").alias("source"), *cols, "members")
    return merged.union(alone.select("source", *cols, F.lit(1).alias("members")))


def as_notes(found: DataFrame, today: str) -> DataFrame:
    """Notes with their paths, as the catalog takes them; of equal paths the one of the least source stays, and ``same_path`` counts the others."""
    folder = F.lit("concepts")
    for kind, name in catalog.FOLDERS.items():
        folder = F.when(F.col("type") == kind, name).otherwise(folder)
    rows = found.select(
        F.concat(folder, F.lit("/"), T.slug(F.col("title")), F.lit(".md")).alias("path"), "source", "title", "type", "summary", "keywords", "content", "members",
        F.array(F.concat(F.lit("[[raw/sources/"), "source", F.lit("]]"))).alias("sources"), T.links(F.col("content")).alias("links"), T.section_refs(F.col("content")).alias("sections"), F.lit(today).alias("last_updated"),
    )
    first = F.min(F.struct("source", "title", "type", "summary", "keywords", "content", "members", "sources", "links", "sections", "last_updated"))
    return rows.groupBy("path").agg(first.alias("n"), (F.count("*") - 1).alias("same_path")).select("path", "n.*", "same_path")


class Ingested(NamedTuple):
    """``notes``, ready for ``catalog.entries`` and ``files.write_notes``, and ``pending``: source, ord, error of the batches that gave none."""

    notes: DataFrame
    pending: DataFrame


def ingested(
    docs: DataFrame, today: str, batch_chars: int = sections.BATCH, least: int = 5, sectionizer: sections.Sectionizer = sections.by_stride,
    extractor: ingest.Extractor = ingest.extractive, merger: consolidate.Merger = consolidate.first_and_all, toc: DataFrame | None = None, pages: DataFrame | None = None,
) -> Ingested:
    """The notes of documents (doc_id, text). A null text is an empty one."""
    found = store.written(extracted(batches(docs, batch_chars, sectionizer, toc, pages), extractor), "notes")
    notes = as_notes(consolidated(found.where("error is null").drop("error"), merger, least), today)
    return Ingested(notes, found.where("error is not null").select("source", "ord", "error"))


LEDGER = "source string, ord int, digest string, title string, type string, summary string, keywords array<string>, content string, error string, rendered string, stamp long"


def resumed(
    docs: DataFrame, root: str, today: str, batch_chars: int = sections.BATCH, least: int = 5, stamp: int = 0, others: bool = False,
    sectionizer: sections.Sectionizer = sections.by_stride, extractor: ingest.Extractor = ingest.extractive, merger: consolidate.Merger = consolidate.first_and_all,
    toc: DataFrame | None = None, pages: DataFrame | None = None,
) -> Ingested:
    """``ingested`` that goes on where an earlier run stopped, writes the notes below ``root`` and saves the catalog.

    The ledger at ``root``/.ledger has a row for each batch that was tried, under the digest of its text.
    Batches with a note there are not extracted again; failed ones, and those whose text is another now, are.
    Notes of a document are those of the batches that it has now. A run that is cut off before the ledger's append
    changes nothing, one after it only has the files and the catalog left, which take no second copy. With ``others`` the
    notes of documents that are not in ``docs`` stay in the catalog, and their failed batches are tried again too;
    a note whose path another document's has is left out. ``stamp`` grows from run to run.
    """
    spark, at = docs.sparkSession, f"{root}/.ledger"
    text = batches(docs, batch_chars, sectionizer, toc, pages)
    key = [F.col("source_id").cast("string").alias("source_id"), F.col("batch").cast("int").alias("batch")]
    wanted = store.written(text.select(*key, "rendered", F.sha2("rendered", 256).alias("digest")), "wanted")
    before = store.written(ledger(spark, at), "ledger")
    names = [F.col("source").alias("source_id"), F.col("ord").alias("batch"), "digest"]
    todo = wanted.join(before.where("error is null").select(*names), ["source_id", "batch", "digest"], "left_anti").select("source_id", "batch", "rendered", "digest")
    again = before.where("error is not null").select("source", "ord", "rendered", "digest").join(wanted.select(F.col("source_id").alias("source")).distinct(), "source", "left_anti")
    if others:
        todo = todo.union(again)
    todo = store.written(todo, "todo")
    tried = extracted(todo.select("source_id", "batch", F.lit(None).cast("int").alias("of"), "rendered"), extractor)
    tried = tried.join(todo.select(F.col("source_id").alias("source"), F.col("batch").alias("ord"), "digest", "rendered"), ["source", "ord"])
    columns = [c.split()[0] for c in LEDGER.split(", ")]
    tried = tried.withColumn("rendered", F.when(F.col("error").isNotNull(), F.col("rendered"))).withColumn("stamp", F.lit(stamp).cast("long"))
    tried.select(*columns).write.mode("append").parquet(at)
    now = store.written(ledger(spark, at), "ledger")
    have = now.join(wanted.select(F.col("source_id").alias("source"), F.col("batch").alias("ord"), "digest"), ["source", "ord", "digest"], "left_semi")
    if others:  # all batches of the documents that were tried again
        have = have.unionByName(now.join(again.select("source").distinct(), "source", "left_semi"))
    found = store.written(have.withColumn("of", F.lit(None).cast("int")), "notes")
    notes = as_notes(consolidated(found.where("error is null").drop("error", "digest", "rendered", "stamp"), merger, least), today)
    if others:
        theirs = catalog.load(spark, f"{root}/.catalog").select("path", F.col("sources").alias("theirs"))
        notes = notes.join(theirs, "path", "left").where(F.col("theirs").isNull() | (F.col("theirs") == F.col("sources"))).drop("theirs")
    notes = store.written(notes, "ingested")
    files.write_notes(catalog.render(notes, today), root)
    entries = catalog.updated(catalog.load(spark, f"{root}/.catalog"), notes) if others else catalog.entries(notes)
    catalog.save(entries, f"{root}/.catalog")
    return Ingested(notes, found.where("error is not null").select("source", "ord", "error"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each batch in the ledger, one with a note before one without; none where there is no ledger."""
    if not store.exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(LEDGER).parquet(path)
    names = [c.split()[0] for c in LEDGER.split(", ")]
    best = F.max_by(F.struct(*names), F.struct(F.col("error").isNull().alias("ok"), "stamp"))
    return rows.groupBy("source", "ord", "digest").agg(best.alias("r")).select("r.*")
