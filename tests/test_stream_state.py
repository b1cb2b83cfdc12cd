import os
import tempfile
from datetime import datetime, timedelta

import pytest

from hushlake.operators import audit as A
from hushlake.streaming import stream as T

SCHEMA = "id long, ts timestamp, client string, model string, duration_ms long, status string"


def row(n, client, ms, model="m"):
    return n, datetime(2024, 1, 1) + timedelta(seconds=n), client, model, ms, "clean"


@pytest.fixture
def feed(spark):
    top = tempfile.mkdtemp(prefix="spark-")

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{top}/in")

    def run(**options):
        """One run over what is new; the rows of its batches."""
        out = []
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
        latency = T.stream_model_latency(source, **options).writeStream.outputMode("update")
        latency.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination(120)
        return {(r.client, r.model): (r.p50, r.p95, r.p99, r.sample) for r in out}

    os.makedirs(f"{top}/in")
    return add, run, lambda: spark.read.parquet(f"{top}/in")


def test_state_follows_the_newest_rows_over_restarts(spark, feed):
    add, run, table = feed
    add([row(n, "c", n % 17 + 1) for n in range(70)] + [row(n, "d", n + 1) for n in range(3)])
    first = run()
    add([row(n, "c", n % 23 + 1) for n in range(40, 110)] + [row(5, "c", 0), row(6, "c", 9, "")])
    second = run()
    want = {(r.client, r.model): (r.p50, r.p95, r.p99, r.sample) for r in A.model_latency(table()).collect()}
    assert first["c", "m"][3] == 50 and first["d", "m"] == want["d", "m"] == (2, 3, 3, 3)
    assert second.keys() == {("c", "m")} and second["c", "m"][3] == 50
    # of rows with one time the longest counts here, the last id there: times 60 to 69 come twice
    newest = sorted(((r.ts, r.duration_ms) for r in table().where("client = 'c' AND model <> '' AND duration_ms > 0").collect()), reverse=True)[:50]
    d = sorted(x for _, x in newest)
    assert second["c", "m"] == (d[25], d[47], d[49], 50)


def test_state_of_an_idle_key_goes(spark, feed):
    add, run, _ = feed
    add([row(1, "c", 100), row(2, "d", 7)])
    assert run(idle="60 seconds") == {("c", "m"): (100, 100, 100, 1), ("d", "m"): (7, 7, 7, 1)}
    add([row(50, "c", 3)])
    assert run(idle="60 seconds") == {("c", "m"): (100, 100, 100, 2)}
    add([row(90, "e", 1)])  # d is 88 seconds behind, c 40
    run(idle="60 seconds")
    add([row(91, "d", 5), row(92, "c", 4), row(3, "c", 1000)])  # the last one is too late
    assert run(idle="60 seconds") == {("c", "m"): (4, 100, 100, 3), ("d", "m"): (5, 5, 5, 1)}


def test_the_store_must_be_named(spark):
    source = spark.readStream.schema(SCHEMA).parquet(tempfile.mkdtemp(prefix="spark-"))
    try:
        spark.conf.set(T.STORE[0], "other")
        with pytest.raises(ValueError):
            T.stream_model_latency(source)
    finally:
        spark.conf.set(*T.STORE)
