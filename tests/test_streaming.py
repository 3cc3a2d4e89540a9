"""Streams against the batch operators."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from foliospark.operators import agent
from foliospark.streaming import pairs

SCHEMA = "conv_id long, seq int, kind string, call_id int, tool string, args map<string,string>, content string, at timestamp"


def test_pairs_of_a_stream_are_those_of_the_join(spark, tmp_path):
    """Out of order over several batches, parallel calls, missing results, results without a call, equal ids in other conversations, two results of one call."""
    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for conv in range(6):
        for call in range(5):
            rows.append((conv, 10 * call, "call", call, f"t{call}", {"path": f"p{call}"} if call % 2 else None, "asked"))
            if (conv + call) % 4:
                rows.append((conv, 10 * call + 5, "result", call, None, None, "x" * (600 if call == 1 else 3)))
        rows.append((conv, 99, "result", 77, None, None, "no call"))
        rows.append((conv, 1, "question", None, None, None, "why"))
    rows.append((0, 98, "result", 1, None, None, "second"))
    rows = [(*r, start + datetime.timedelta(seconds=rng.randrange(300))) for r in rows]
    rng.shuffle(rows)
    at = f"file://{tmp_path}/in"
    for k in range(4):
        spark.createDataFrame(rows[k::4], SCHEMA).coalesce(1).write.mode("append").parquet(at)
        # later files carry the watermark on, the last two past all timers
    for minutes in (60, 120):
        spark.createDataFrame([(1000, 1, "call", 0, "end", None, "", start + datetime.timedelta(minutes=minutes))], SCHEMA).write.mode("append").parquet(at)
    stream = pairs.call_pairs(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at), wait=600)
    out = f"file://{tmp_path}/out"
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(out).where("conv_id < 1000")
    plain = agent.call_pairs(spark.createDataFrame(rows, SCHEMA)).withColumn("args", F.to_json("args")).withColumn("seq", F.col("seq").cast("long")).withColumn("result_seq", F.col("result_seq").cast("long"))
    listed = lambda df: sorted(map(repr, df.select("conv_id", "call_id", "seq", "tool", "args", "result_seq", "result_preview").collect()))
    assert listed(got) == listed(plain)
    assert got.where("result_seq is null").count() >= 6
