"""The same operators over streams."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from hushlake.functions.rules import apply_overrides
from hushlake.operators.audit import LAST
from hushlake.plans.audit_job import audit_requests, finished

#: The setting that keyed state with an end needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_verdict(rows: DataFrame, rules: DataFrame, agent_mode: bool = False) -> DataFrame:
    """A verdict for each request of a stream; no state."""
    return audit_requests(rows, rules, agent_mode)


def stream_stats(judged: DataFrame) -> DataFrame:
    """Counts by status, for update or complete mode."""
    return judged.groupBy("status").agg(F.count("*").alias("n"))


def stream_responses(judged: DataFrame, responses: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Responses join their requests if they come within ``late``; a request without one is written after that."""
    left = judged.withWatermark("ts", late)
    right = responses.withColumnRenamed("request_id", "_id").withWatermark("response_ts", late)
    in_time = F.expr(f"request_id = _id AND response_ts >= ts AND response_ts <= ts + INTERVAL {late}")
    return finished(left.join(right, in_time, "left").drop("_id"))


class _Latency(StatefulProcessor):
    """A key's state is a list of its newest ``n`` rows (time and duration), and a timer at the newest one's time: it rings
    when the watermark has passed that, and the list goes."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getListState("newest", "at long, duration_ms long")

    def handleInputRows(self, key: tuple[str, str], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        newest = [tuple(map(int, x)) for x in self.newest.get()]
        for part in rows:
            newest = heapq.nlargest(self.n, [*newest, *zip(part["at"].tolist(), part["duration_ms"].tolist(), strict=True)])
        self.newest.put(newest)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest[0][0] // 1000 + 1)
        d = sorted(b for _, b in newest)
        at = lambda q: d[min(int(len(d) * q), len(d) - 1)]
        yield pd.DataFrame({"client": [key[0]], "model": [key[1]], "p50": [at(0.5)], "p95": [at(0.95)], "p99": [at(0.99)], "sample": [len(d)]})

    def handleExpiredTimer(self, key: tuple[str, str], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_model_latency(judged: DataFrame, n: int = LAST, idle: str | None = "1 day") -> DataFrame:
    """client, model, p50, p95, p99 and sample over the newest ``n`` durations of each key, for update mode.

    The state of a key is its newest ``n`` rows, however many have come. It goes when the newest of all rows is ``idle``
    past the key's newest, in the rows' own time; a key that comes back later starts anew. A row that comes when others
    are already ``idle`` past it is left out. With None the stream's own watermark on ts says when. State is kept in the
    RocksDB store, which timers need: the session must name it (see STORE), else this is an error.
    """
    if judged.sparkSession.conf.get(STORE[0], None) != STORE[1]:
        raise ValueError(f"set {STORE[0]} to {STORE[1]}")
    rows = judged.withWatermark("ts", idle) if idle else judged
    rows = rows.where((F.col("model") != "") & (F.col("duration_ms") > 0))
    return rows.select("client", "model", "ts", F.unix_micros("ts").alias("at"), F.col("duration_ms").cast("long")).groupBy("client", "model").transformWithStateInPandas(
        _Latency(n), "client string, model string, p50 long, p95 long, p99 long, sample long", "Update", "EventTime"
    )


def with_current_rules(
    rows: DataFrame, rules: DataFrame, overrides: Callable[[SparkSession], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Each micro-batch is judged under the overrides as they are when it starts, and given to ``sink``."""

    def batch(df: DataFrame, number: int) -> None:
        now = apply_overrides(rules, overrides(df.sparkSession))
        sink(audit_requests(df, now), number)

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
