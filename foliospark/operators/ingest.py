"""Note extraction from documents: pluggable extractor, error isolation, resume."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

PROGRESS = "source_id string, batch_id long, status string, notes array<struct<title:string,type:string,summary:string,keywords:array<string>,content_body:string>>, stamp long"

#: text -> (title, type, summary, keywords, content)
Extractor = Callable[[str], tuple[str, str, str, list[str], str]]
SCHEMA = "doc_id long, title string, type string, summary string, keywords array<string>, content string, error string"


def extractive(text: str) -> tuple[str, str, str, list[str], str]:
    """The offline extractor: first words as title, first sentence as summary, longest words as keywords."""
    words = text.split()
    if not words:
        raise ValueError("no words")
    summary = text.split(". ")[0][:200]
    keywords = sorted({w.strip(".,;:!?").lower() for w in words}, key=lambda w: (-len(w), w))[:4]
    return " ".join(words[:6]), "concept", summary, keywords, text


def extract(docs: DataFrame, extractor: Extractor = extractive) -> DataFrame:
    """One note for each document; an extractor's exception becomes the row's ``error``. ``doc_id`` may be of any type."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            rows = []
            for text in batch["text"]:
                try:
                    rows.append((*extractor(text or ""), None))
                except Exception as e:  # one document's failure is a value, not the job's
                    rows.append((None, None, None, None, None, str(e)))
            found = pd.DataFrame(rows, columns=["title", "type", "summary", "keywords", "content", "error"])
            found.insert(0, "doc_id", batch["doc_id"].reset_index(drop=True) if not isinstance(batch["doc_id"], pd.DataFrame) else batch["doc_id"].to_dict("records"))
            yield found

    return docs.select("doc_id", "text").mapInPandas(work, SCHEMA.replace("doc_id long", f"doc_id {key}"))


def pending(batches: DataFrame, progress: DataFrame) -> DataFrame:
    """Batches without a finished entry in the progress table; failed ones are tried again."""
    done = progress.where("status = 'done'").select("source_id", "batch_id")
    return batches.join(done, ["source_id", "batch_id"], "left_anti")


def checked(notes: DataFrame) -> DataFrame:
    """Notes with the contract's checks: three to five keywords, a known type."""
    known = F.col("type").isin("concept", "entity", "procedure", "synthesis")
    return notes.withColumn("keywords_ok", F.size("keywords").between(3, 5)).withColumn("type_ok", F.coalesce(known, F.lit(False)))


NOTES_JSON = "source_title string, summary string, notes array<struct<title:string,type:string,summary:string,keywords:array<string>,content_body:string,content:string>>"


def decoded(responses: DataFrame) -> DataFrame:
    """Notes of JSON responses (id, json), ``content`` standing in for ``content_body``; bad JSON gives a row with ``ok`` false."""
    rows = responses.select("id", F.from_json("json", NOTES_JSON, {"mode": "PERMISSIVE"}).alias("j"))
    rows = rows.select("id", F.col("j.notes").isNotNull().alias("ok"), F.explode_outer("j.notes").alias("n"))
    return rows.select("id", "ok", "n.title", "n.type", F.coalesce("n.keywords", F.array().cast("array<string>")).alias("keywords"), F.coalesce("n.content_body", "n.content", F.lit("")).alias("content"))


def latest(progress: DataFrame) -> DataFrame:
    """The newest status of each batch of an append-only progress table."""
    return progress.groupBy("source_id", "batch_id").agg(F.max_by("status", "stamp").alias("status"), F.max("stamp").alias("stamp"))


def save_progress(done: DataFrame, path: str) -> None:
    """Append finished batches (the columns of PROGRESS) to the progress table; one that is there already gets a newer row."""
    done.select(*(c.strip().split()[0] for c in ("source_id", "batch_id", "status", "notes", "stamp"))).write.mode("append").parquet(path)


def load_progress(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each batch, none where there is no progress."""
    if not store.exists(spark, path):
        return spark.createDataFrame([], PROGRESS)
    rows = spark.read.schema(PROGRESS).parquet(path)
    newest = rows.groupBy("source_id", "batch_id").agg(F.max_by(F.struct("status", "notes", "stamp"), "stamp").alias("r"))
    return newest.select("source_id", "batch_id", "r.*")


def clear_progress(spark: SparkSession, path: str) -> None:
    store.delete(spark, path)


def resumed(batches: DataFrame, progress: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """source_id, batch_id, result, stored: kept results of the batches that are done, and ``process``'s of the others.

    ``batches``: source_id, batch_id and what ``process`` needs, which gives them a ``result``;
    ``progress``: source_id, batch_id, status, result.
    """
    done = progress.where("status = 'done'").select("source_id", "batch_id", "result")
    keys = ["source_id", "batch_id"]
    old = batches.select(*keys).join(done, keys).withColumn("stored", F.lit(True))
    new = process(pending(batches, progress)).select(*keys, "result").withColumn("stored", F.lit(False))
    return old.unionByName(new)
