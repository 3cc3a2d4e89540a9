"""Calls of tools and their results, paired as messages stream in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T

PAIR = "conv_id long, call_id int, seq long, tool string, args string, result_seq long, result string"
#: What a session must be set to, since timers and lists of state are kept there.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Pairing(StatefulProcessor):
    """State of one call id: calls without a result yet, results without a call yet, and answered calls, until the timer ends them."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getListState("calls", "seq long, tool string, args string, answered boolean")
        self.results = handle.getListState("results", "seq long, content string")

    def rows(self, key: tuple, pairs: list[tuple]) -> pd.DataFrame:
        rows = [(*key, *call[:3], *(result or (None, None))) for call, result in pairs]
        frame = pd.DataFrame(rows, columns=["conv_id", "call_id", "seq", "tool", "args", "result_seq", "result"])
        return frame.astype({"result_seq": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = [tuple(c) for c in self.calls.get()]
        results = [tuple(r) for r in self.results.get()]
        pairs, latest = [], 0
        for frame in rows:
            latest = max(latest, int(frame["at"].max().timestamp() * 1000))
            for kind, seq, tool, args, content in zip(frame["kind"], frame["seq"], frame["tool"], frame["args"], frame["content"], strict=True):
                if kind == "call":
                    call = (int(seq), tool, args)
                    pairs += [(call, r) for r in results]
                    calls.append((*call, bool(results)))
                else:
                    result = (int(seq), content)
                    pairs += [(c, result) for c in calls]
                    calls = [(*c[:3], True) for c in calls]
                    results.append(result)
        if calls:
            self.calls.put(calls)
        if results:
            self.results.put(results)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.wait_ms)
        if pairs:
            yield self.rows(key, pairs)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = [(tuple(c), None) for c in self.calls.get() if not c[3]]
        self.calls.clear()
        self.results.clear()
        if left:
            yield self.rows(key, left)

    def close(self) -> None:
        pass


def call_pairs(messages: DataFrame, wait: int = 600, late: str = "10 minutes") -> DataFrame:
    """``agent.call_pairs`` of a stream: messages (conv_id, seq, kind, call_id, tool, args, content, at) in any order.

    A pair comes out as soon as both are there, and a call without a result, with nulls, once
    the watermark is ``wait`` seconds past the last message of its id; a result after that is left out. ``args`` come out as JSON. A
    conversation's calls are keys of their own, so a long one is many tasks.
    """
    messages.sparkSession.conf.set(*STATE_STORE)
    rows = messages.where("kind in ('call', 'result')").select("conv_id", "call_id", F.col("seq").cast("long").alias("seq"), "kind", "tool", F.to_json("args").alias("args"), "content", "at")
    found = rows.withWatermark("at", late).groupBy("conv_id", "call_id").transformWithStateInPandas(Pairing(1000 * wait), PAIR, "Append", "EventTime")
    return found.select("conv_id", "call_id", "seq", "tool", "args", "result_seq", T.preview(F.col("result"), 500).alias("result_preview"))
