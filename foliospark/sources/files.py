"""Reading raw documents and note files, and writing notes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = ["concepts", "entities", "procedures", "synthesis"]
TOC_SCHEMA = "source string, total_pages int, entries array<struct<level:int,title:string,page:int>>"


def raw_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """source_id (stem), suffix, path and content of text files; a path that is not there is an error."""
    rows = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("source_id"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("suffix"), "path", "content")


def note_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``) and markdown of the notes in the four folders."""
    rows = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "false").text([f"{root}/{f}" for f in FOLDERS], wholetext=True)
    path = F.concat_ws("/", F.slice(F.split(F.col("_metadata.file_path"), "/"), -2, 2))
    return rows.select(path.alias("path"), F.col("value").alias("markdown"))


def toc_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """source, ord, level, title, page, total_pages of a table of contents in JSON."""
    rows = spark.read.schema(TOC_SCHEMA).option("multiLine", True).json(path)
    return rows.select("source", "total_pages", F.posexplode("entries").alias("ord", "e")).select("source", "ord", "e.level", "e.title", "e.page", "total_pages")


#: the bytes of a file -> the texts of its pages, and (level, title, page) of its table of contents
PageDecoder = Callable[[bytes], tuple[list[str], list[tuple[int, str, int]]]]


def form_feeds(data: bytes) -> tuple[list[str], list[tuple[int, str, int]]]:
    """The decoder for texts whose pages end with a form feed, as text extractors write them; each page's first line is an entry."""
    pages = data.decode(errors="replace").split("\f")
    pages = pages[:-1] if len(pages) > 1 and not pages[-1].strip() else pages
    return pages, [(1, p.strip().split("\n")[0].strip(), k) for k, p in enumerate(pages, 1) if p.strip()]


def decoded_rows(source: str, content: bytes, decoder: PageDecoder) -> list[tuple]:
    """Rows of a file: its pages, then its entries; or one with an error."""
    try:
        pages, toc = decoder(content)
    except Exception as e:  # one file's failure is a value, not the job's
        return [(source, "page", None, None, None, None, None, None, str(e) or type(e).__name__)]
    rows = [(source, "page", k, k - 1, None, None, t, len(pages), None) for k, t in enumerate(pages, 1)]
    return rows + [(source, "toc", p, k, level, title.strip(), None, len(pages), None) for k, (level, title, p) in enumerate(toc)]


def decoded(spark: SparkSession, decoder: PageDecoder, *paths: str) -> DataFrame:
    """source, part (page or toc), page, ord, level, title, text, total_pages, error: what ``decoder`` finds in files of any format.

    A file that it cannot read is one row with ``error``.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select(F.element_at(F.split("path", "/"), -1).alias("source"), "content")
    cols = ["source", "part", "page", "ord", "level", "title", "text", "total_pages", "error"]

    def work(batches):
        for batch in batches:
            for source, content in zip(batch["source"], batch["content"], strict=True):
                frame = pd.DataFrame(decoded_rows(source, content, decoder), columns=cols)
                yield frame.astype({c: "Int32" for c in ("page", "ord", "level", "total_pages")})

    return files.mapInPandas(work, "source string, part string, page int, ord int, level int, title string, text string, total_pages int, error string")


def toc_documents(toc: DataFrame) -> DataFrame:
    """path and content (JSON) of the sidecar of each source's table of contents: source, ord, level, title, page, total_pages."""
    got = toc.groupBy("source").agg(F.max("total_pages").alias("total_pages"), F.array_sort(F.collect_list(F.struct("ord", "level", "title", "page"))).alias("e"))
    entries = F.transform("e", lambda x: F.struct(x["level"].alias("level"), x["title"].alias("title"), x["page"].alias("page")))
    path = F.concat(F.regexp_replace("source", r"\.[^.]*$", ""), F.lit(".toc.json"))
    return got.select(path.alias("path"), F.to_json(F.struct("source", "total_pages", entries.alias("entries"))).alias("content"))


def write_files(rows: DataFrame, root: str, overwrite: bool = True) -> DataFrame:
    """Write each row's ``content`` to ``root``/``path``, one file a row, in the tasks that hold the rows.

    A file appears whole, by a rename, so a task that runs again does no harm. Without
    ``overwrite`` files that are there stay; which are is listed before the first is written, so a
    task that runs again gives the same rows. Returns path and created, one row a file.
    """
    there = F.lit(False)
    if not overwrite:
        old = listed(rows.sparkSession, root).withColumn("there", F.lit(True))
        rows, there = rows.join(old, "path", "left"), F.col("there").isNotNull()

    def work(batches):
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content, there in zip(batch["path"], batch["content"], batch["there"], strict=True):
                at = f"{base}/{path}"
                if there:
                    continue
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                part = f"{at}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write((content or "").encode())
                store.move(part, at)
            yield pd.DataFrame({"path": batch["path"], "created": ~batch["there"]})

    return rows.select("path", "content", there.alias("there")).mapInPandas(work, "path string, created boolean")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``) of each note file that is there now; names are listed, contents are not read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "path string")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    below = len(at.toUri().getPath().rstrip("/")) + 2
    return rows.select(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", "").alias("path")).select(F.expr(f"substring(path, {below})").alias("path"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write the column ``line`` of a sorted frame as text below ``path``: the parts by name are the page, each written by the task that sorted it."""
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_notes(rendered: DataFrame, root: str) -> tuple[int, int]:
    """Write rendered notes (path, markdown) below ``root`` as ``note_files`` reads them; of equal paths the least text counts.

    Returns how many were created and how many were there already and stay as they are.
    """
    one = rendered.groupBy("path").agg(F.min("markdown").alias("content"))
    created = write_files(one, root, overwrite=False).agg(F.count_if("created")).first()[0]
    return created, rendered.select("path").count() - created
