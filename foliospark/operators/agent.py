"""Agent transcripts as relations: folds, rounds, call pairs and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def folded(turns: DataFrame) -> DataFrame:
    """conv_id, calls, the last answer (whole) and its preview."""
    rows = turns.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("calls"),
        F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"),
    )
    answered = F.coalesce("answer", F.lit(""))
    return rows.select("conv_id", "calls", answered.alias("answer"), T.preview(answered, 500).alias("preview"))


def call_pairs(messages: DataFrame) -> DataFrame:
    """Each call with the result that names its id, wherever that comes; a call without one has a null result.

    ``messages``: conv_id, seq, kind, call_id, tool, args, content.
    """
    calls = messages.where("kind = 'call'").select("conv_id", "call_id", "seq", "tool", "args")
    results = messages.where("kind = 'result'").select("conv_id", "call_id", F.col("seq").alias("result_seq"), F.col("content").alias("result"))
    return calls.join(results, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "seq", "tool", "args", "result_seq", T.preview(F.col("result"), 500).alias("result_preview"))


def read_sources(messages: DataFrame) -> DataFrame:
    """conv_id and sources: the distinct paths that a conversation's page reads ask for, first read first."""
    path = F.col("args")["path"]
    reads = messages.where((F.col("kind") == "call") & (F.col("tool") == "read_page") & (F.coalesce(path, F.lit("")) != ""))
    got = reads.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", path.alias("path")))).alias("p"))
    return got.select("conv_id", F.array_distinct(F.transform("p", lambda x: x["path"])).alias("sources"))


def responses(messages: DataFrame) -> DataFrame:
    """conv_id, query, answer, tool_calls (tool, result_preview in the order of the calls) and sources of each conversation."""
    text = messages.groupBy("conv_id").agg(
        F.min_by("content", F.when(F.col("kind") == "question", F.col("seq"))).alias("query"),
        F.max_by("content", F.when(F.col("kind") == "answer", F.col("seq"))).alias("answer"),
    )
    pairs = call_pairs(messages).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "tool", "result_preview"))).alias("p"))
    calls = pairs.select("conv_id", F.transform("p", lambda x: F.struct(x["tool"].alias("tool"), x["result_preview"].alias("result_preview"))).alias("tool_calls"))
    none = F.array().cast("array<string>")
    rows = text.join(calls, "conv_id", "left").join(read_sources(messages), "conv_id", "left")
    return rows.select("conv_id", "query", F.trim(F.coalesce("answer", F.lit(""))).alias("answer"), "tool_calls", F.coalesce("sources", none).alias("sources"))


def capped(turns: DataFrame, most: int) -> DataFrame:
    """Conversations with their rounds, and whether the cap stops them."""
    rounds = turns.groupBy("conv_id").agg(F.max("round").alias("rounds"))
    return rounds.select("conv_id", "rounds", F.least("rounds", F.lit(most)).alias("run"), (F.col("rounds") > most).alias("stopped"))


def events(turns: DataFrame) -> DataFrame:
    """Turns as events: tool_call, tool_result, and answer for the last assistant turn."""
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(W.partitionBy("conv_id"))
    kind = F.when(F.col("role") == "user", "tool_call").when((F.col("role") == "assistant") & (F.col("turn") == F.col("last")), "answer").when(F.col("role") == "assistant", "tool_result")
    rows = turns.withColumn("last", last).select("conv_id", "turn", kind.alias("type"), T.preview(F.col("text"), 800).alias("content"))
    return rows.where("type is not null")


def formatted_args(args):
    """``k=json`` pairs of a map column in key order, or ``(no args)``."""
    pairs = F.transform(F.array_sort(F.map_entries(args)), lambda e: F.concat(e["key"], F.lit("="), F.to_json(F.array(e["value"]))))
    inner = F.transform(pairs, lambda p: F.regexp_replace(p, r"^([^=]*=)\[(.*)\]$", "$1$2"))
    return F.when(F.size(args) > 0, F.array_join(inner, ", ")).otherwise(F.lit("(no args)"))
