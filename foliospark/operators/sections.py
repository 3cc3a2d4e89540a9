"""Sectioning: tables of contents, headings, page ranges, packing and routing.

Operators over tables of contents take ``by``, the columns that tell documents apart; without, all rows are one document's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import offsets
from ..functions import text as T
from ..sources import store
from .pages import running_before

SINGLE_PASS, SAMPLED, BATCH = 12_000, 60_000, 40_000
#: Batches in a block of a source that is packed on its own.
PACK_BLOCK = 256
END = "END_OF_DOC"


def toc_depth(toc: DataFrame, least: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """The finest level with ``least`` entries, else the deepest."""
    n = toc.groupBy(*by, "level").agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("n") >= least, F.col("level"))), F.max("level")).alias("depth"))


#: Pages, and ordinals, in a block of a document whose next entries are found by themselves.
PAGE_BLOCK, ORD_BLOCK = 1024, 4096


def following(rows: DataFrame, order: str, value: Column, size: int, by: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``next``, ``value`` of the document's next row by ``order``, which is strict.

    A document is dealt to blocks of ``size`` values of ``order``: a lead inside a block, and at its end the first
    row of the document's next block, from a window over a row a block. A long document is many tasks.
    """
    rows = rows.withColumn("block", F.floor(F.col(order) / size))
    inside = rows.withColumn("next", F.lead(value).over(W.partitionBy(*by, "block").orderBy(order)))
    first = rows.groupBy(*by, "block").agg(F.min_by(value, order).alias("first"))
    ahead = first.withColumn("after", F.lead("first").over(W.partitionBy(*by).orderBy("block"))).select(*by, "block", "after")
    return inside.join(ahead, [*by, "block"]).withColumn("next", F.coalesce("next", "after")).drop("block", "after")


def toc_bounds(toc: DataFrame, forward: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """First page, and the first page behind, of each entry: the document's next distinct page, else six more."""
    nxt = following(toc.select(*by, "page").distinct(), "page", F.col("page"), PAGE_BLOCK, by)
    return toc.join(nxt, [*by, "page"]).select(*by, "ord", "level", "title", "page", F.coalesce("next", F.col("page") + forward).alias("behind"))


def toc_meant(toc: DataFrame, wanted: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The entry that each ``query`` means in its document: ``wanted`` (by, query) with ord, level, title, page; none where none holds it."""
    key = T.toc_key(F.col("query"))
    rows = wanted.distinct().join(toc, [*by]).withColumn("key", T.toc_key(F.col("title"))).where(F.contains("key", key))
    ratio = F.length(key) / F.greatest(F.length("key"), F.lit(1))
    best = F.struct((F.col("key") == key).alias("same"), ratio.alias("ratio"), (-F.col("ord")).alias("first"))
    found = rows.groupBy(*by, "query").agg(F.max_by(F.struct("ord", "level", "title", "page"), best).alias("e"))
    return found.select(*by, "query", "e.*")


def toc_match(toc: DataFrame, query: str) -> DataFrame:
    """The entry a query means: the first equal one, else the one that it covers most of."""
    key = T.toc_key(F.lit(query))
    found = toc.withColumn("key", T.toc_key(F.col("title"))).where(F.contains("key", key))
    ratio = F.length(key) / F.greatest(F.length("key"), F.lit(1))
    return found.orderBy(F.desc(F.col("key") == key), F.desc(ratio), "ord").limit(1)


def headings(lines: DataFrame, least: int = 3) -> DataFrame:
    """Heading lines of the sources that have ``least`` of them; ``lines``: source_id, k, line."""
    rows = lines.where(T.is_heading(F.col("line")))
    many = rows.groupBy("source_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("source_id")
    return rows.join(many, "source_id", "left_semi")


def section_bounds(found: DataFrame) -> DataFrame:
    """Each heading with the next one as its end marker; ordinals and next ones come from blocks of lines, so no window holds a source."""
    rows = running_before(found.select("source_id", "k", "line", F.lit(1).alias("one")), "source_id", "k", "one", "before")
    rows = following(rows, "k", F.trim("line"), ORD_BLOCK, ("source_id",))
    return rows.select("source_id", "k", F.trim("line").alias("title"), T.section_id(F.trim("line"), F.col("before") + 1).alias("section_id"), F.coalesce("next", F.lit(END)).alias("end_marker"))


def page_ranges(sections: DataFrame, pages: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pages of each section, ``page`` up to but not ``behind`` (one page at least): an equi-join on exploded pages."""
    wanted = sections.select(*by, "ord", "title", F.explode(F.sequence("page", F.greatest(F.col("behind") - 1, F.col("page")))).alias("page_no"))
    return wanted.join(pages, [*by, "page_no"]).select(*by, "ord", "title", "page_no", "text")


def batch_ends(before: np.ndarray, size: np.ndarray, limit: int) -> np.ndarray:
    """Where the batch that starts at each chunk ends, as characters before that place; chunks come in order without gaps."""
    end = before + size
    last = np.searchsorted(end, before + limit, "right") - 1
    return np.where(last >= np.arange(len(end)), end[np.maximum(last, 0)], end)


def packed(chunks: DataFrame, limit: int = BATCH, least: int = 80) -> DataFrame:
    """Greedy batches of a source's chunks in order, up to ``limit`` characters; a longer chunk is alone: source_id, ord, batch, size.

    Where a batch starts hangs on the one before it, so a source of more than a block is packed in three steps.
    Running sums deal its chunks to blocks of PACK_BLOCK batches' characters. In each block
    the chain of batches is followed from every chunk that a batch of an earlier block may
    end before: the place where it leaves the block, and how many batches it has. Only
    those few rows a block meet in one call for each source, which strings the blocks
    together; then each block numbers its chunks. Sizes travel, not texts.
    """
    span = limit * PACK_BLOCK
    kept = chunks.where(F.length(F.trim("text")) > least).select("source_id", "ord", F.length("text").cast("long").alias("size"))
    kept = store.written(kept, "sizes")
    total = kept.agg(F.sum("size")).first()[0] or 0
    # a call takes the blocks of a pool, which is about one block's characters
    pools = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // span)
    rows = running_before(kept, "source_id", "ord", "size", "before").withColumn("block", F.floor(F.col("before") / span)).withColumn("key", F.xxhash64("source_id"))
    rows = store.written(rows, "blocks")
    # a block sees the chunks behind it that its last batches may take
    ahead = rows.where((F.col("before") % span < limit) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1)
    both = rows.withColumn("own", F.lit(True)).union(ahead.withColumn("own", F.lit(False)))
    both = both.withColumn("pool", F.pmod(F.xxhash64("key", "block"), F.lit(pools)))

    def blocks(group: pd.DataFrame):
        """The blocks of a pool: places of their rows in order, then the values of before, size and own."""
        cols = [group[c].to_numpy() for c in ("before", "block", "key")]
        order = np.lexsort(cols)
        cut = np.flatnonzero(np.r_[True, (np.diff(cols[1][order]) != 0) | (np.diff(cols[2][order]) != 0)])
        for at in np.split(order, cut[1:]):
            yield at, cols[0][at], group["size"].to_numpy()[at], group["own"].to_numpy()[at]

    def chains(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for at, before, size, own in blocks(group):
            n, block = int(own.sum()), int(group["block"].iloc[at[0]])
            border = (block + 1) * span
            end = batch_ends(before, size, limit)[:n]  # other blocks' chunks come behind
            leave, count = end.copy(), np.ones(n, np.int64)
            to = np.searchsorted(before[:n], end)
            for i in range(n - 1, -1, -1):
                if end[i] < border and to[i] < n:
                    leave[i], count[i] = leave[to[i]], count[to[i]] + 1
            entry = np.flatnonzero((before[:n] - (border - span) < limit) | (np.arange(n) == 0))
            key = np.full(len(entry), group["key"].iloc[at[0]])
            out.append(np.c_[key, np.full(len(entry), block), before[:n][entry], leave[entry], count[entry]])
        return pd.DataFrame(np.concatenate(out), columns=["key", "block", "entry", "leave", "batches"])

    # a source of one block starts with batch 0 at 0; others are strung
    several = both.join(rows.where("block > 0").select("key").distinct(), "key", "left_semi")
    steps = several.select("pool", "key", "block", "before", "size", "own").groupBy("pool").applyInPandas(chains, "key long, block long, entry long, leave long, batches long")

    def strung(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, own in group.groupby("key"):
            at, base, met = 0, 0, set()
            step = {e: (b, leave, n) for b, e, leave, n in zip(own["block"], own["entry"], own["leave"], own["batches"], strict=True)}
            while at in step:
                block, leave, n = step[at]
                out.append((key, block, at, base))
                met.add(block)
                at, base = leave, base + n
            # a last block in which no batch starts belongs to the last batch
            out += [(key, b, 1 << 62, base) for b in sorted(set(own["block"]) - met)]
        return pd.DataFrame(out, columns=["key", "block", "entry", "base"])

    entries = steps.groupBy(F.pmod("key", F.lit(pools))).applyInPandas(strung, "key long, block long, entry long, base long")

    def numbered(group: pd.DataFrame) -> pd.DataFrame:
        batch, entries_, base = np.zeros(len(group), np.int64), group["entry"].to_numpy(), group["base"].to_numpy()
        for at, before, size, _ in blocks(group):
            start, number = int(entries_[at[0]]), int(base[at[0]])
            end, mine = batch_ends(before, size, limit), np.zeros(len(at), np.int64)
            mine[before < start] = number - 1  # what the last batch of an earlier block takes
            while (i := int(np.searchsorted(before, start))) < len(before):
                j = int(np.searchsorted(before, end[i]))
                mine[i:j] = number
                start, number = int(end[i]), number + 1
            batch[at] = mine
        own = group["own"].to_numpy()
        return pd.DataFrame({"source_id": group["source_id"].to_numpy()[own], "ord": group["ord"].to_numpy()[own], "batch": batch[own], "size": group["size"].to_numpy()[own]})

    source, kind = (chunks.schema[c].dataType.simpleString() for c in ("source_id", "ord"))
    started = both.join(entries, ["key", "block"], "left").fillna(0, ["entry", "base"])
    return started.groupBy("pool").applyInPandas(numbered, f"source_id {source}, ord {kind}, batch int, size int")


def with_strategy(docs: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """``docs`` (doc_id, text) with ``strategy``, from a document's length and the sections that cheap ways find; texts move only to meet a ``toc``.

    ``toc``: doc_id, level of the entries of all tables of contents, if there are any. A
    document has two sections of it where a level has two entries, as ``toc_sections`` chooses.
    """
    docs, listed = docs.withColumn("text", F.coalesce("text", F.lit(""))), F.lit(0)
    if toc is not None:
        levels = toc.groupBy("doc_id", "level").agg(F.count("*").alias("n"))
        docs = docs.join(levels.groupBy("doc_id").agg(F.max("n").alias("toc_sections")), "doc_id", "left")
        listed = F.coalesce("toc_sections", F.lit(0))
    found = F.size(F.filter(F.split("text", "\n"), T.is_heading))
    strategy = F.when(F.length("text") < SINGLE_PASS, "single").when(listed >= 2, "toc").when(found >= 3, "regex").otherwise("llm")
    return docs.withColumn("strategy", strategy).drop("toc_sections")


def routed(docs: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """The strategy for each document, and how much of it a sectionizer reads."""
    return with_strategy(docs, toc).select("doc_id", "strategy", F.length(T.sample(F.col("text"))).alias("sample_chars"))


def toc_sections(toc: DataFrame, total_pages: int | None = None, least: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Sections from the entries of each document's chosen level, each up to the next one's page; none where no level has two.

    The last one goes to ``total_pages``, or to the column of that name.
    """
    n = toc.groupBy(*by, "level").agg(F.count("*").alias("n"))
    fine = F.max(F.when(F.col("n") >= least, F.col("level")))
    depth = n.where("n >= 2").groupBy(*by).agg(F.coalesce(fine, F.when(F.max_by("n", "level") >= 2, F.max("level")), F.min("level")).alias("level"))
    rows = toc.join(depth, [*by, "level"])
    rows = following(rows, "ord", F.struct("page", "title"), ORD_BLOCK, by)
    last = (F.col("total_pages") if total_pages is None else F.lit(total_pages)) + 1
    return rows.select(
        *by, "ord", "level", "title", T.section_id(F.col("title"), F.col("ord") + 1).alias("section_id"), F.col("page").alias("page_start"),
        F.coalesce("next.page", last).alias("page_end"), F.coalesce("next.title", F.lit(END)).alias("end_marker"),
    )


def marker_slices(docs: DataFrame, start: str, end: str, least: int = 80) -> DataFrame:
    """The part of each text between two markers, as it stands; none where the start is not found or the part is short."""
    one = F.array(F.struct(F.lit(1).alias("ord"), F.lit("").alias("title"), F.lit(start).alias("start_marker"), F.lit(end).alias("end_marker")))
    return cut_sections(docs.select("doc_id", "text", one.alias("sections")), least).select("doc_id", "place", "chunk")


def sliced(docs: DataFrame, sections: DataFrame, least: int = 80) -> DataFrame:
    """Sections (doc_id, ord, title, start_marker, end_marker) of texts (doc_id, text) with their parts of them: doc_id, ord, title, place, chunk.

    ``place`` is where the part starts in the collapsed text, ``chunk`` the part as it stands in the text. A text
    is collapsed once for all its sections, which travel to it as one row.
    """
    listed = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "start_marker", "end_marker"))).alias("sections"))
    return cut_sections(docs.select("doc_id", "text").join(listed, "doc_id"), least)


def cut_sections(rows: DataFrame, least: int) -> DataFrame:
    """doc_id, ord, title, place, chunk of the sections of each row of ``rows``: doc_id, text, sections."""
    return with_parts(rows, least).select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.*")


def with_parts(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` (text, sections) with ``parts``: an array of ord, title, place, chunk, null where there is none.

    A section goes from its start marker to the next place of its end
    marker behind that, or to the end of the text; one whose start is not found, or that is short, is left out.
    Markers are found in the collapsed text; an offset map cuts the text itself."""

    def mark(s):
        end = F.when(s["end_marker"] != END, T.collapsed(s["end_marker"]))
        return F.struct(s["ord"].alias("ord"), s["title"].alias("title"), T.collapsed(s["start_marker"]).alias("start"), F.length(s["start_marker"]).alias("n"), end.alias("end"))

    ordinal = rows.schema["sections"].dataType.elementType["ord"].dataType.simpleString()
    norm = F.when(F.col("sections").isNotNull(), T.collapsed(F.col("text")))
    return rows.withColumn("parts", offsets.raw_parts(F.col("text"), norm, F.transform("sections", mark), ordinal, least))


def page_sections(sections: DataFrame, pages: DataFrame, least: int = 80, by: tuple[str, ...] = ()) -> DataFrame:
    """ord, title, chunk: the texts of each section's pages in order with a blank line between; short ones are left out.

    ``sections``: ord, title, page, behind; ``pages``: page_no, text.
    """
    rows = page_ranges(sections, pages, by).groupBy(*by, "ord", "title").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    chunk = T.stripped(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"))
    return rows.select(*by, "ord", "title", chunk.alias("chunk")).where(F.length("chunk") > least)


def batch_text(chunks: DataFrame) -> DataFrame:
    """Chunks as an extractor reads them: a title line and the text."""
    return chunks.select("ord", F.concat(F.lit("### Section: "), "title", F.lit("\n"), "text").alias("rendered"))


def batch_texts(chunks: DataFrame, limit: int = BATCH, least: int = 80) -> DataFrame:
    """source_id, batch, chunks, rendered: each batch of a source's chunks (source_id, ord, title, text) as one text."""
    chunks = store.written(chunks.select("source_id", "ord", "title", "text"), "texts")  # read for their sizes, and again as texts
    batch = packed(chunks, limit, least).select("source_id", "ord", "batch")
    line = F.concat(F.lit("### Section: "), "title", F.lit("\n"), "text")
    rows = batch.join(chunks.select("source_id", "ord", line.alias("line")), ["source_id", "ord"])
    got = rows.groupBy("source_id", "batch").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("p"))
    return got.select("source_id", "batch", F.size("p").alias("chunks"), F.array_join(F.transform("p", lambda x: x["line"]), "\n\n").alias("rendered"))


def batched(parts: Column, limit: int = BATCH) -> Column:
    """An array of texts: the batches of a document's chunks as ``batch_texts`` has them, where the chunks (an array of title and chunk, in order) are one row's."""

    def packs(chunks: list[dict]) -> list[str]:
        out, size = [], 0
        for c in chunks:
            line, n = f"### Section: {c['title']}\n{c['chunk']}", len(c["chunk"])
            if out and size + n <= limit:
                out[-1].append(line)
                size += n
            else:
                out.append([line])
                size = n
        return ["\n\n".join(lines) for lines in out]

    def work(parts: pa.Array) -> pa.Array:
        return pa.array([packs(p.as_py()) if p.is_valid else None for p in parts], pa.list_(pa.string()))

    store.small_batches()
    return F.arrow_udf(work, "array<string>").asNondeterministic()(parts)


#: text -> (title, section_id, start_marker, end_marker) of its sections; title and id may be empty
Sectionizer = Callable[[str], list[tuple[str, str, str, str]]]


def by_stride(text: str, stride: int = 4000, marker: int = 60) -> list[tuple[str, str, str, str]]:
    """The offline sectionizer: a section each ``stride`` characters, none of an empty text."""
    starts = [text[at : at + marker] for at in range(0, len(text), stride)]
    return [("", "", a, b) for a, b in zip(starts, [*starts, END][1:], strict=True)]


FOUND = "array<struct<ord:int,title:string,section_id:string,start_marker:string,end_marker:string,error:string>>"


def sections_found(text: Column, sectionizer: Sectionizer = by_stride) -> Column:
    """An array of ord, title, section_id, start_marker, end_marker, error: what a model finds in a sample of a text; null where the text is.

    A sectionizer's exception becomes one item with ``error``. Titles and ids are as the sectionizer gives them.
    """
    names = ["ord", "title", "section_id", "start_marker", "end_marker", "error"]

    def listed(sample: str) -> list[dict]:
        try:
            return [dict(zip(names, (k, *s, None), strict=True)) for k, s in enumerate(sectionizer(sample), 1)]
        except Exception as e:  # one document's failure is a value, not the job's
            return [{"ord": 0, "error": str(e)}]

    def work(samples: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(n, pa.int32() if n == "ord" else pa.string()) for n in names]))
        return pa.array([None if t is None else listed(t) for t in samples.to_pylist()], kind)

    store.small_batches()
    return F.arrow_udf(work, FOUND).asNondeterministic()(T.sample(text))


def analysed(docs: DataFrame, sectionizer: Sectionizer = by_stride) -> DataFrame:
    """doc_id, ord, title, section_id, start_marker, end_marker, error: the sections that a model finds in a sample of each text.

    A sectionizer's exception becomes a row with ``error``. Titles and ids that it leaves
    empty come from the start marker and the title.
    """
    found = docs.select("doc_id", sections_found(F.coalesce("text", F.lit("")), sectionizer).alias("found"))
    return titled(found.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.*"))


def titled(sections: DataFrame) -> DataFrame:
    """Sections (title, section_id, start_marker, ord and others) with the titles and ids that are missing."""
    failed = F.col("start_marker").isNull()
    title = F.when(~failed, T.section_title(F.col("title"), F.col("start_marker"), F.col("ord")))
    own = F.coalesce("section_id", F.lit("")) != ""
    rows = sections.withColumn("title", title)
    return rows.withColumn("section_id", F.when(own, F.col("section_id")).otherwise(T.section_id(F.col("title"), F.col("ord"))))
