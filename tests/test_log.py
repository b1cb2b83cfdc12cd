"""The audit log over time: late responses, batches that are written again, lines that are no JSON."""

import json
import os
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hushlake.sources import audit_log as S

DAY = [datetime(2024, 1, d, 10) for d in (1, 2, 3)]


def stored(spark, rows):
    """Rows (request_id, day, status) as the audit job leaves them where no response has come."""
    df = spark.createDataFrame([(i, DAY[d], s) for i, d, s in rows], "request_id string, ts timestamp, status string")
    return df.withColumns({"duration_ms": F.lit(0).cast("long"), "input_tokens": F.lit(0).cast("long"), "output_tokens": F.lit(0).cast("long"), "llm_response": F.lit("")})


def said(text, tokens):
    return json.dumps({"content": [{"type": "text", "text": text}], "usage": {"input_tokens": tokens, "output_tokens": tokens + 1}})


def files(path):
    return {os.path.join(top, f) for top, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def content(spark, path):
    return {r.request_id: (r.duration_ms, r.input_tokens, r.output_tokens, r.llm_response) for r in S.read_audit(spark, path).collect()}


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="spark-") + "/audit"


@pytest.fixture
def responses(spark):
    rows = [("a", DAY[1], 5, said("old", 1)), ("a", DAY[2], 7, said("hi", 3)), ("b", DAY[2], 9, said("kept out", 4)), ("unknown", DAY[2], 1, said("x", 1)), (None, DAY[2], 1, said("x", 1))]
    return spark.createDataFrame(rows, S.RESPONSES)


def test_late_responses(spark, path, responses):
    S.write_audit(stored(spark, [("a", 0, "redacted"), ("b", 0, "clean"), ("c", 0, "redacted"), (None, 0, "clean")]), path)
    S.write_audit(stored(spark, [("d", 1, "clean")]), path)
    untouched = {f for f in files(path) if "dt=2024-01-02" in f}
    assert S.merge_responses(spark, path, responses) == ["2024-01-01"]
    want = {"a": (7, 3, 4, "hi"), "b": (9, 4, 5, ""), "c": (0, 0, 0, ""), None: (0, 0, 0, ""), "d": (0, 0, 0, "")}
    assert content(spark, path) == want and untouched <= files(path) and not os.path.exists(f"{path}/_merged")
    before = files(path)
    assert S.merge_responses(spark, path, responses) == [] and files(path) == before
    assert S.merge_responses(spark, path, responses.limit(0)) == [] and S.merge_responses(spark, path, responses, since="2024-01-02") == []


def test_a_merge_that_stops_is_completed(spark, path, responses, monkeypatch):
    S.write_audit(stored(spark, [("a", 0, "redacted"), ("b", 1, "clean")]), path)

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(S, "_swap", fails)
        with pytest.raises(OSError, match="lost"):
            S.merge_responses(spark, path, responses)
    assert content(spark, path)["a"] == (0, 0, 0, "")  # readers do not see the unfinished merge
    assert S.merge_responses(spark, path, responses.limit(0)) == []
    assert content(spark, path) == {"a": (7, 3, 4, "hi"), "b": (9, 4, 5, "")}


def test_a_batch_that_fails_after_its_write_is_written_once(spark, path):
    top = os.path.dirname(path)
    stored(spark, [("a", 0, "clean"), ("b", 1, "redacted"), ("c", 1, "clean")]).write.parquet(f"{top}/in")
    rows = spark.readStream.schema(spark.read.parquet(f"{top}/in").schema).parquet(f"{top}/in")
    write = S.audit_sink(path, "live")

    def run(sink):
        rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{top}/c").trigger(availableNow=True).start().awaitTermination(120)

    def write_and_fail(df, number):
        write(df, number)
        raise OSError("lost")

    with pytest.raises(Exception, match="lost"):
        run(write_and_fail)
    assert S.read_audit(spark, path).count() == 3
    run(write)
    stored(spark, [("d", 1, "clean")]).write.mode("append").parquet(f"{top}/in")
    run(write)
    S.write_audit(stored(spark, [("e", 1, "clean")]), path)
    assert sorted(r.request_id for r in S.read_audit(spark, path).collect()) == ["a", "b", "c", "d", "e"]
    S.purge_audit(spark, path, "2024-01-02")
    assert [r.request_id for r in S.read_audit(spark, path).collect()] == ["a"]


LINES = ['{"request_id":"a","ts":"2024-01-01T00:00:00Z","host":"h","body":"{}"}', "", "no json", '{"request_id":"b","ts":"never"}', '{"request_id":"c"', "[1]", "null", '{"request_id":"d","other":1}', "{}"]
BAD = {"no json", '{"request_id":"b","ts":"never"}', '{"request_id":"c"', "[1]", "null"}


@pytest.mark.parametrize("stream", [False, True])
def test_bad_lines(spark, path, stream):
    os.makedirs(path)
    with open(f"{path}/log.json", "w") as f:
        f.write("\n".join(LINES) + "\n")
    good, bad = S.split_lines(S.read_lines(spark, path, stream=stream))
    if stream:
        got = {}
        for name, df in (("good", good), ("bad", bad)):
            df.writeStream.foreachBatch(lambda d, n, name=name: got.setdefault(name, []).extend(d.collect())).option("checkpointLocation", f"{path}-{name}").trigger(availableNow=True).start().awaitTermination(120)
        good, bad = got["good"], got["bad"]
    else:
        assert (good.count(), bad.count()) == (3, 5)
        good, bad = good.collect(), bad.collect()
    assert {r.request_id for r in good} == {"a", "d", None} and {r.bad_line for r in bad} == BAD and all(r.file.endswith("log.json") for r in bad)
