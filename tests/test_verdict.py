import json
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hushlake.functions import rules as R
from hushlake.operators import audit as A
from hushlake.operators import requests as Q
from hushlake.operators import verdict as V
from hushlake.plans.audit_job import attach_responses, audit_requests
from hushlake.sources import audit_log as S
from hushlake.streaming import stream as T

SSN, MAIL = "123-45-6789", "me@mail.example"


def body(*turns, **more):
    return json.dumps({"model": "m", "messages": [{"role": r, "content": c} for r, c in turns], **more})


BODIES = {
    "clean": body(("user", "hello")), "block": body(("user", f"my {SSN} and {MAIL}")), "track": body(("user", f"mail {MAIL}")),
    "history": body(("user", f"my {SSN}"), ("assistant", "ok"), ("user", "go on")), "background": body(("user", f"Summarize the following {SSN}")),
    "empty": body(), "span": body(("user", "password ="), ("user", "abcdefgh12")),
}


def judged(spark, agent=False):
    df = spark.createDataFrame(list(BODIES.items()), "id string, body string")
    return {r.id: r for r in V.verdict(Q.parse_request(df), R.builtin_rules(spark), agent).collect()}


def test_verdicts(spark):
    got = judged(spark)
    assert {k: r.status for k, r in got.items()} == {"clean": "clean", "block": "blocked", "track": "redacted", "history": "redacted", "background": "redacted", "span": "blocked"}
    assert [m.rule_id for m in got["block"].matches] == ["ssn", "email"] and "Social Security Number" in got["block"].notice and got["block"].safe_text.startswith("[blocked")
    assert got["block"].prompt == f"my {SSN} and {MAIL}" and got["block"].redacted_prompt == f"my {SSN} and [REDACTED]"
    assert [m.rule_id for m in got["history"].history] == ["ssn"] and got["history"].prompt == "go on" and got["history"].notice == ""
    assert SSN in got["background"].redacted_prompt and SSN not in got["background"].safe_text
    assert got["track"].redacted_prompt == "mail [REDACTED]" and "flagged" not in {r.status for r in got.values()}


def test_agent_mode_blocks_nothing(spark):
    got = judged(spark, True)
    assert {k: r.status for k, r in got.items()} == {"clean": "clean", "block": "redacted", "track": "redacted", "history": "clean", "background": "redacted", "span": "redacted"}
    assert got["block"].redacted_prompt == "my [REDACTED] and [REDACTED]"


def test_columns_of_stored_rows(spark):
    ms = [("r", "Rule")]
    df = spark.createDataFrame([("redacted", ms, "p", "p"), ("redacted", ms, "p", "q"), ("redacted", [], "p", ""), ("blocked", ms, "p", ""), ("clean", [], "p", "")],
                               "status string, matches array<struct<rule_id:string,rule_name:string>>, prompt string, redacted string")
    args = [F.col(c) for c in ("status", "matches", "prompt", "redacted")]
    rows = df.select(V.history_only(*args).alias("h"), V.safe_text(*args).alias("s")).collect()
    assert [r.h for r in rows] == [True, False, False, False, False]
    assert [r.s for r in rows] == ["p", "q", "p", "[blocked — content withheld. Rules matched: Rule]", "p"]


def log(spark):
    t = datetime(2024, 1, 1)
    rows = [(n, datetime(2024, 1, 1 + n % 3, n % 24), f"h{n % 4}", ["clean", "redacted", "blocked", "telemetry"][n % 4], "cli" if n % 2 else "ide", "m" if n % 5 else "", n * 10, n, f"100% Text_{n}", f"s{n}") for n in range(120)]
    return spark.createDataFrame(rows, "id long, ts timestamp, host string, status string, client string, model string, duration_ms long, input_tokens long, prompt string, session_id string"), t


def test_audit_queries(spark):
    df, _ = log(spark)
    df = df.withColumn("output_tokens", F.lit(2))
    s = A.audit_stats(df).first()
    assert (s.total, s.clean, s.flagged, s.redacted, s.blocked, s.telemetry, s.output_tokens) == (120, 30, 0, 30, 30, 30, 240)
    empty = A.audit_stats(df.limit(0)).first()
    assert (empty.total, empty.input_tokens) == (0, 0)
    assert A.most_flagged_host(df).first().host == "h1" and A.most_flagged_host(df.limit(0)).collect() == []
    page = A.list_prompts(df, 2, 10).collect()
    every = A.list_prompts(df, 1, 200).collect()
    assert page == every[10:20] and len(A.list_prompts(df, 0, 999).collect()) == 25 and every[0].ts == max(r.ts for r in every)
    assert A.count_prompts(df, "blocked", "text_1").first().n == len([r for r in every if r.status == "blocked" and "Text_1" in r.prompt])
    assert A.search_filter(df, "100%").count() == 120 and A.search_filter(df, "0_text").count() == 0 and A.search_filter(df, "a\\b").count() == 0
    assert A.time_range(df, "2024-01-02", "2024-01-02").count() == 40 and A.time_range(df, "no day", None).count() == 120 and A.get_prompt(df, 7).count() == 1
    lines = A.export_lines(df.withColumn("safe_text", F.col("prompt"))).orderBy("n").collect()
    assert [r.n for r in lines] == list(range(1, 121)) and lines[0].line.startswith("[1] 2024-01-01 00:00 | h0 | clean\n100% Text_0")


def test_presets():
    from datetime import date

    day = date(2024, 3, 10)
    assert A.preset("today", day) == ("2024-03-10", "2024-03-10") and A.preset("last 7 days", day)[0] == "2024-03-04" and A.preset("last 30 days", day)[0] == "2024-02-10" and A.preset("all", day) == (None, None)


def test_latency(spark):
    rows = [(n, datetime(2024, 1, 1, 0, n // 60, n % 60), "c", "m", n + 1) for n in range(200)] + [(500, datetime(2024, 1, 2), "c", "m", 0), (501, datetime(2024, 1, 2), "c", "", 5), (502, datetime(2024, 1, 2), "d", "m", 9)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, client string, model string, duration_ms long")
    got = {(r.client, r.model): (r.p50, r.p95, r.p99, r.sample) for r in A.model_latency(df).collect()}
    assert got == {("c", "m"): (176, 198, 200, 50), ("d", "m"): (9, 9, 9, 1)}
    p = A.latency_pivot(df, ["c", "d"]).first()
    assert (p.c_p50, p.d_n) == (176, 1)


def test_small_expressions(spark):
    df = spark.createDataFrame([(150_000, "big-cli"), (0, "x"), (10, None), (500_000, "x")], "t long, c string")
    limit = A.context_limit(F.col("c"), {"CLI": 200_000, "big": 160_000})
    use = A.context_use(F.col("t"), limit)
    assert [(r[0], r[1]) for r in df.select(use, A.context_band(use)).collect()] == [(75, "amber"), (None, None), (0, "green"), (100, "red")]
    row = spark.range(1).select(A.preview(F.lit("abcdef"), 3), A.preview(F.lit("abc"), 3), A.mask_path(F.lit("/v1/01234567-89ab-cdef-0123-456789abcdef/x")), A.short_session(F.lit("0123456789")), A.latency_band(F.lit(5001))).first()
    assert list(row) == ["abc…", "abc", "/v1/…/x", "01234567", "warning"]


@pytest.fixture
def logs(spark):
    top = tempfile.mkdtemp(prefix="spark-")
    rows = [(k, f"2024-01-0{n % 3 + 1}T00:00:0{n}.500Z", "api.openai.com:443", "/v1", {"User-Agent": "tool/1 x", "Vscode-Sessionid": "s"}, b) for n, (k, b) in enumerate(BODIES.items())]
    rows += [("other", "2024-01-01T00:00:00Z", "example.com", "/", {}, BODIES["block"]), ("beat", "2024-01-01T00:00:01Z", "api.openai.com", "/t", {}, json.dumps({"writeKey": "k", "batch": [{"event": "e"}]}))]
    with open(f"{top}/in.json", "w") as f:
        f.writelines(json.dumps(dict(zip(("request_id", "ts", "host", "path", "headers", "body"), r, strict=True))) + "\n" for r in rows)
    with open(f"{top}/out.jsonl", "w") as f:
        f.writelines(json.dumps({"request_id": k, "response_ts": "2024-01-01T00:00:30Z", "duration_ms": 7, "response": json.dumps({"content": [{"type": "text", "text": "hi"}], "usage": {"input_tokens": 3, "output_tokens": 4}})}) + "\n" for k in ("clean", "track"))
    return top


def test_audit_job_and_log(spark, logs):
    judged = audit_requests(S.read_requests(spark, f"{logs}/in.json"), R.builtin_rules(spark))
    S.write_audit(attach_responses(judged, S.read_responses(spark, f"{logs}/out.jsonl")), f"{logs}/audit")
    rows = {r.request_id: r for r in S.read_audit(spark, f"{logs}/audit").collect()}
    assert set(rows) == {"clean", "block", "track", "history", "background", "span", "beat"} and rows["beat"].status == "telemetry" and rows["beat"].prompt == "Events: e"
    assert (rows["track"].llm_response, rows["clean"].llm_response, rows["track"].input_tokens, rows["track"].duration_ms) == ("hi", "", 3, 7)
    assert rows["history"].raw_body == BODIES["history"].replace(SSN, "[REDACTED]") and rows["track"].raw_body == "" and rows["clean"].client == "tool/1" and rows["clean"].host == "api.openai.com"
    assert rows["clean"].ts.microsecond == 0
    for r in rows.values():  # what is stored of a request with history matches holds no value that a block rule finds
        assert r.request_id != "history" or not any(SSN in str(x) for k, x in r.asDict().items() if k != "matches")  # a match keeps its snippet
    log = S.read_audit(spark, f"{logs}/audit").withColumn("id", F.col("request_id"))
    some = A.time_range(log, "2024-01-02", "2024-01-02")
    assert some.count() == 2 and "PartitionFilters: [isnotnull(dt" in some._jdf.queryExecution().toString()
    S.export_text(A.export_lines(log), f"{logs}/text", A.export_header(log, None, "2024-01-03"))
    text = "\n".join(r.value for r in sorted(spark.read.text(f"{logs}/text").collect(), key=lambda r: 0))
    assert "Days: the first to 2024-01-03\nPrompts: 7, of which 2 blocked and 3 redacted" in text
    assert SSN not in "".join(r.value for r in spark.read.text(f"{logs}/text").collect())
    S.purge_audit(spark, f"{logs}/audit", "2024-01-02")
    assert {r.ts.day for r in S.read_audit(spark, f"{logs}/audit").collect()} == {1, 3}


def test_stream_equals_batch(spark, logs):
    import os
    import shutil

    os.makedirs(f"{logs}/stream")
    shutil.copy(f"{logs}/in.json", f"{logs}/stream/in.json")
    rules = R.builtin_rules(spark)
    batch = audit_requests(S.read_requests(spark, f"{logs}/in.json"), rules)
    live = T.stream_verdict(S.read_requests(spark, f"{logs}/stream", stream=True), rules)
    columns = ["request_id", "ts", "status", "safe_text", "session_id", "client", "model"]
    S.stream_audit(live.select(*columns), f"{logs}/live", f"{logs}/c1").awaitTermination(120)
    want = S.with_day(batch.select(*columns)).select(*columns).collect()
    assert sorted(map(tuple, spark.read.parquet(f"{logs}/live").select(*columns).collect())) == sorted(map(tuple, want))

    seen = []
    overrides = lambda s: s.createDataFrame([(0, "ssn", "track", None)], "n int, rule_id string, mode string, severity string")
    T.with_current_rules(S.read_requests(spark, f"{logs}/stream", stream=True), rules, overrides, lambda df, n: seen.extend(df.select("request_id", "status").collect()), f"{logs}/c2").awaitTermination(120)
    assert dict(map(tuple, seen))["block"] == "redacted"


def test_stream_state(spark, logs):
    import os

    for n, lo in enumerate((0, 80)):
        os.makedirs(f"{logs}/latency", exist_ok=True)
        rows = [(k, datetime(2024, 1, 1, 0, k // 60, k % 60), "c", "m", k + 1, "clean") for k in range(lo, lo + 80)]
        spark.createDataFrame(rows, "id long, ts timestamp, client string, model string, duration_ms long, status string").coalesce(1).write.mode("append").parquet(f"{logs}/latency")
    schema = "id long, ts timestamp, client string, model string, duration_ms long, status string"
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{logs}/latency")
    out = []
    T.stream_model_latency(source()).writeStream.outputMode("update").foreachBatch(lambda df, n: out.append(df.collect())).option("checkpointLocation", f"{logs}/c3").trigger(availableNow=True).start().awaitTermination(120)
    want = A.model_latency(spark.read.parquet(f"{logs}/latency")).first()
    last = [b for b in out if b][-1][0]
    assert (last.p50, last.p95, last.p99, last.sample) == (want.p50, want.p95, want.p99, want.sample)
    counts = []
    T.stream_stats(source()).writeStream.outputMode("complete").foreachBatch(lambda df, n: counts.append(df.collect())).option("checkpointLocation", f"{logs}/c4").trigger(availableNow=True).start().awaitTermination(120)
    assert counts[-1][0].n == 160


def test_stream_responses(spark, logs):
    import os
    import shutil

    os.makedirs(f"{logs}/s1")
    os.makedirs(f"{logs}/s2")
    shutil.copy(f"{logs}/in.json", f"{logs}/s1/in.json")
    shutil.copy(f"{logs}/out.jsonl", f"{logs}/s2/out.json")
    live = T.stream_verdict(S.read_requests(spark, f"{logs}/s1", stream=True), R.builtin_rules(spark))
    joined = T.stream_responses(live, S.read_responses(spark, f"{logs}/s2", stream=True))
    rows = []
    joined.writeStream.outputMode("append").foreachBatch(lambda df, n: rows.extend(df.select("request_id", "duration_ms", "llm_response").collect())).option("checkpointLocation", f"{logs}/c5").trigger(availableNow=True).start().awaitTermination(120)
    assert ("clean", 7, "") in set(map(tuple, rows))


def test_stream_late_and_missing_responses(spark, logs):
    import os

    os.makedirs(f"{logs}/r1")
    os.makedirs(f"{logs}/r2")

    def put(folder, n, rows):
        names = ["request_id", "ts", "host", "path", "headers", "body"] if folder == "r1" else ["request_id", "response_ts", "duration_ms", "response"]
        with open(f"{logs}/{folder}/{n}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows)

    request = lambda k, t: (k, f"2024-01-01T{t}Z", "claude.ai", "/", {}, BODIES["track"])
    answer = lambda k, t: (k, f"2024-01-01T{t}Z", 9, json.dumps({"content": [{"type": "text", "text": "hi"}]}))
    put("r1", 0, [request("answered", "00:00:00"), request("none", "00:00:01"), request("late", "00:00:02")])
    put("r2", 0, [answer("answered", "00:00:05"), answer("late", "00:30:00"), answer("nobody", "00:00:05")])
    rows = []

    def run():
        live = T.stream_verdict(S.read_requests(spark, f"{logs}/r1", stream=True), R.builtin_rules(spark))
        joined = T.stream_responses(live, S.read_responses(spark, f"{logs}/r2", stream=True))
        writer = joined.writeStream.outputMode("append").foreachBatch(lambda df, n: rows.extend(df.select("request_id", "duration_ms", "llm_response").collect()))
        writer.option("checkpointLocation", f"{logs}/r3").trigger(availableNow=True).start().awaitTermination(240)

    run()
    assert ("answered", 9, "hi") in set(map(tuple, rows)) and "nobody" not in {r.request_id for r in rows}
    # once the watermark of both sides has passed the time that a response may take, what had none in time is written without
    put("r1", 1, [request("next", "02:00:00")])
    put("r2", 1, [answer("next", "02:00:01")])
    run()
    put("r1", 2, [request("last", "04:00:00")])
    put("r2", 2, [answer("last", "04:00:01")])
    run()
    got = sorted(tuple(r) for r in rows if r.request_id != "last")
    assert got == [("answered", 9, "hi"), ("late", 0, ""), ("next", 9, "hi"), ("none", 0, "")]


def test_header_and_labels(spark):
    df, _ = log(spark)
    head = A.export_header(A.time_range(df, "2024-01-02", None), "2024-01-02").first()
    assert head.n == 0 and head.line.startswith("Days: 2024-01-02 to the last\nPrompts: 80, of which ")
    rules = R.builtin_rules(spark).where("rule_id IN ('ssn', 'aws-access-token', '1password-secret-key')")
    labels = {r.rule_id: r.label for r in rules.select("rule_id", R.rule_label().alias("label")).collect()}
    assert labels == {"ssn": "Social Security Number", "aws-access-token": "Aws Access Token", "1password-secret-key": "1password Secret Key"}
