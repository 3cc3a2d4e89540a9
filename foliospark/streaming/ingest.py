"""Incremental ingestion: new document files become notes as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import extract
from ..plans import flow
from ..sources import store


def ingest_new(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id long, text string") -> StreamingQuery:
    """Read files that were not read yet, extract notes, append them, stop; the checkpoint is the progress."""
    docs = spark.readStream.schema(schema).parquet(source)
    return extract(docs).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ingest_documents(spark: SparkSession, source: str, root: str, checkpoint: str, today: str, schema: str = "doc_id long, text string", files: int = 1000, **options) -> StreamingQuery:
    """The whole flow over document files as they arrive: notes below ``root`` and a catalog that is always whole; stops when no file is left.

    Each micro-batch of ``files`` files is one ``flow.resumed`` with the batch's number as its stamp. A batch that is
    run again after a restart finds its extractions in the ledger, its note files written and its notes in the catalog, so
    it changes nothing; batches of text whose extraction failed come again with every later one. ``options`` are those of ``flow.resumed``.
    """
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def one(batch: DataFrame, number: int) -> None:
        with store.passing(spark):
            flow.resumed(batch, root, today, stamp=number, others=True, **options)

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
