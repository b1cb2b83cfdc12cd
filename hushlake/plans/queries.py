"""Registered queries over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.functions import rules as R
from hushlake.functions.dialect import replacement_to_re2
from hushlake.operators import audit, detect, requests, verdict
from hushlake.operators.bodies import redact_bodies
from hushlake.operators.bodies import text_leaves as text_leaves_of
from hushlake.operators.rule_index import indexed_findings
from hushlake.plans import audit_job
from hushlake.sources import audit_log

Query = Callable[[SparkSession, str], DataFrame]

#: Planted into the text of every tenth conversation turn, on both sides: the driver's turns hold nothing that a rule finds.
PLANTED = " write to anna.b@mail.example or use password = \"hunter2hunter2\" with 4111111111111111"
LIMITS = {"click": 400, "view": 150}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, counted: DataFrame | None = None, rows: int = 5_000) -> DataFrame:
    """Small files are one task each; texts that rules scan are dealt over all cores, some ``rows`` a task at the most. Large inputs are split by Spark already.

    Give ``counted``, a table whose rows are counted in its stead, where those of ``df`` are made from it at some cost, or few bytes become many.
    """
    sc = df.sparkSession.sparkContext
    tasks = max(sc.defaultParallelism, -(-counted.count() // rows)) if counted is not None else sc.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def audit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an audit log."""
    host = F.when(F.col("event_id") % 3 == 0, "api.openai.com").when(F.col("event_id") % 3 == 1, "api.anthropic.com").otherwise("claude.ai")
    status = F.element_at(F.array(*[F.lit(s) for s in ("clean", "flagged", "redacted", "blocked", "telemetry")]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", host.alias("host"), status.alias("status"), F.col("event_type").alias("client"),
        F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model"), F.col("user_id").cast("string").alias("session_id"),
        F.coalesce(F.col("props"), F.lit("")).alias("prompt"), F.floor(F.col("value") * 10).cast("long").alias("duration_ms"),
        F.floor(F.col("value")).cast("long").alias("input_tokens"), (F.col("event_id") % 11).cast("long").alias("output_tokens"),
        F.array(F.struct(F.col("event_type").alias("rule_name"))).alias("matches"), F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise("changed").alias("redacted_prompt"),
    )


AUDIT = """(SELECT event_id AS id, ts, CASE event_id % 3 WHEN 0 THEN 'api.openai.com' WHEN 1 THEN 'api.anthropic.com' ELSE 'claude.ai' END AS host,
  (['clean', 'flagged', 'redacted', 'blocked', 'telemetry'])[event_id % 5 + 1] AS status, event_type AS client, 'm' || (user_id % 7) AS model,
  CAST(user_id AS VARCHAR) AS session_id, coalesce(props, '') AS prompt, CAST(floor(value * 10) AS BIGINT) AS duration_ms, CAST(floor(value) AS BIGINT) AS input_tokens,
  event_id % 11 AS output_tokens FROM events)"""


def planted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.withColumn("text", F.when((F.col("conv_id") * 31 + F.col("turn")) % 10 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(PLANTED))).otherwise(F.col("text")))


TURNS = f"""(SELECT conv_id, turn, role, CASE WHEN (conv_id * 31 + turn) % 10 = 0 THEN coalesce(text, '') || '{PLANTED}' ELSE text END AS text FROM conversations)"""


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rule_sql(row: tuple, text: str = "text") -> str:
    """Whether a rule fires, in DuckDB; a card must pass the Luhn test."""
    if row[10] == "luhn":
        return f"len(list_filter(regexp_extract_all({text}, {sql_text(row[4])}), lambda m: {LUHN.format(m='m')})) > 0"
    return f"regexp_matches({text}, {sql_text(row[4])})"


LUHN = (
    "list_sum(list_transform(range(1, len({m}) + 1), lambda i: CASE WHEN (len({m}) - i) % 2 = 0 THEN CAST({m}[i] AS INT) "
    "WHEN CAST({m}[i] AS INT) * 2 > 9 THEN CAST({m}[i] AS INT) * 2 - 9 ELSE CAST({m}[i] AS INT) * 2 END)) % 10 = 0"
)
ROWS = R.builtin_rows()
BY_ID = {r[1]: r for r in ROWS}
BLOCK, TRACK = [r for r in ROWS if r[7] == "block"], [r for r in ROWS if r[7] == "track"]


def hits_sql(source: str, id_col: str, rows: list[tuple], text: str = "text") -> str:
    return " UNION ALL ".join(f"SELECT {id_col}, {r[0]} AS ord, {sql_text(r[1])} AS rule_id, '{r[6]}' AS severity FROM {source} t WHERE {rule_sql(r, text)}" for r in rows)


# Detection


def rule_hits(spark, sf_dir):
    return detect.findings(documents(spark, sf_dir), R.builtin_rules(spark), ["doc_id"]).select("doc_id", "rule_id", "severity", "mode")


def hits_by_lang_severity(spark, sf_dir):
    rows = detect.findings(documents(spark, sf_dir), R.builtin_rules(spark), ["doc_id", "lang"])
    return rows.groupBy("lang", "severity").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))


def first_match_pos(spark, sf_dir):
    return detect.findings(documents(spark, sf_dir), R.builtin_rules(spark), ["doc_id"]).select("doc_id", "rule_id", "start")


def snippets(spark, sf_dir):
    return detect.findings(documents(spark, sf_dir), R.builtin_rules(spark), ["doc_id"]).select("doc_id", "rule_id", "snippet")


def luhn_cards(spark, sf_dir):
    docs = documents(spark, sf_dir)
    cards = F.filter(F.regexp_extract_all("text", F.lit(BY_ID["credit-card"][5]), F.lit(0)), lambda m: F.call_function("luhn_check", m))
    return docs.select("doc_id", F.explode(cards).alias("card"))


def redact_track(spark, sf_dir):
    rows = detect.redact_text(documents(spark, sf_dir), R.builtin_rules(spark))
    return rows.where("size(redactions) > 0").select("doc_id", "redacted")


def redact_all(spark, sf_dir):
    """Agent mode: every rule redacts, in order."""
    rows = detect.redact_text(documents(spark, sf_dir), R.builtin_rules(spark), agent_mode=True)
    return rows.where("size(redactions) > 0").select("doc_id", "redacted", F.size("redactions").alias("fired"))


def redact_groups(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.concat("text", F.lit(PLANTED)).alias("text"))
    rules = R.builtin_rules(spark).where("rule_id = 'generic-secret'")
    return detect.redact_text(rows, rules, agent_mode=True).select("doc_id", F.length("redacted").alias("chars"), F.md5("redacted").alias("digest"))


def rule_report(spark, sf_dir):
    """Rules with "key" in their name, id or description as they are listed, after a change of mode, with the documents they fire on."""
    no_changes = spark.createDataFrame([], "n int, rule_id string, mode string, severity string")
    rules = R.apply_overrides(R.builtin_rules(spark), R.set_mode(no_changes, "aws-access-token", "track"))
    listed = R.list_rules(rules, "KEY").select("ord", "rule_id", R.rule_label().alias("label"), "severity", "mode")
    found = detect.findings(documents(spark, sf_dir), rules, ["doc_id"]).groupBy("rule_id").agg(F.count("*").alias("docs"))
    return listed.join(found, "rule_id", "left").select("ord", "rule_id", "label", "severity", "mode", F.coalesce("docs", F.lit(0)).alias("docs"))


def scan_status(spark, sf_dir):
    return detect.scan_text(documents(spark, sf_dir), R.builtin_rules(spark)).select("doc_id", "status")


def severity_of_documents(spark, sf_dir):
    rows = detect.detect(documents(spark, sf_dir), R.builtin_rules(spark))
    return rows.select("doc_id", detect.max_severity(F.col("matches")).alias("severity"))


def leak_rate_by_label(spark, sf_dir):
    found = detect.findings(documents(spark, sf_dir), R.builtin_rules(spark), ["doc_id"]).select("doc_id").distinct()
    labels = table(spark, sf_dir, "labels").join(found.withColumn("hit", F.lit(1)), "doc_id", "left")
    return labels.groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.count("hit").alias("leaks"))


def safe_pages(spark, sf_dir):
    """Pages without tags, with what rules find in them."""
    rows = spread(table(spark, sf_dir, "pages")).select("page_id", requests.squeezed(F.col("html")).alias("text"))
    return detect.findings(rows, R.builtin_rules(spark), ["page_id"]).select("page_id", "rule_id", "severity", "mode")


def overrides(spark, sf_dir):
    """The catalogue with a custom rule and overrides, counted against the documents' own findings of two rules."""
    custom = spark.createDataFrame([R.rule_row(0, "long-number", "Long number", "Twelve digits", r"\b\d{12}\b", "low", "track", R.REDACTED, "", [])], R.SCHEMA)
    changes = spark.createDataFrame([(0, "email", "block", ""), (1, "credit-card", "track", "medium"), (2, "email", "", "high"), (3, "no-such-rule", "track", "low")], "n int, rule_id string, mode string, severity string")
    rules = R.apply_overrides(R.add_rules(R.builtin_rules(spark), custom), changes).where(F.col("rule_id").isin("email", "credit-card", "long-number"))
    return detect.findings(documents(spark, sf_dir), rules, ["doc_id"]).groupBy("rule_id", "mode", "severity").agg(F.count("*").alias("docs"))


# Pages and conversations


def clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", requests.squeezed(F.coalesce("html", F.lit(""))).alias("text"))


def page_host(spark, sf_dir):
    url = F.coalesce("url", F.lit(""))
    host = F.regexp_extract(url, "https?://([^/]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), requests.is_target_host(host).alias("is_target"), audit.mask_path(url).alias("masked"))


def current_turn(spark, sf_dir):
    return audit.latest_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


def conversation_findings(spark, sf_dir) -> DataFrame:
    rows = spread(audit.with_current(planted_turns(spark, sf_dir)))
    return detect.findings(rows, R.builtin_rules(spark), ["conv_id", "turn", "now"])


def history_only(spark, sf_dir):
    """Rules that earlier turns hold and the current turn of the conversation does not."""
    rows = conversation_findings(spark, sf_dir).where("mode = 'block'")
    now = rows.where("now").select("conv_id", "rule_id").distinct()
    return rows.where("NOT now").select("conv_id", "rule_id").distinct().join(now, ["conv_id", "rule_id"], "left_anti")


def turn_verdict(spark, sf_dir):
    rows = conversation_findings(spark, sf_dir)
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    found = rows.groupBy("conv_id").agg(
        any_(F.col("now") & (F.col("mode") == "block")).alias("b"), any_(F.col("now") & (F.col("mode") == "track")).alias("t"), any_(~F.col("now") & (F.col("mode") == "block")).alias("h")
    )
    all_ = table(spark, sf_dir, "conversations").select("conv_id").distinct().join(found, "conv_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = verdict.status_of(flag("b"), flag("t"), flag("h"), F.lit(False), flag("b") | flag("t") | flag("h"))
    return all_.select("conv_id", status.alias("status"))


# Bodies built from the conversations


def bodies(spark, sf_dir) -> DataFrame:
    turns = planted_turns(spark, sf_dir).where("text IS NOT NULL")
    message = F.struct("turn", "role", F.col("text").alias("content"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x.role.alias("role"), x.content.alias("content")))
    user = F.to_json(F.struct(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id")))
    body = F.to_json(F.struct(F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"), (F.col("conv_id") % 2 == 0).alias("stream"), F.struct(user.alias("user_id")).alias("metadata"), messages.alias("messages")))
    return spread(grouped.select("conv_id", body.alias("body")), table(spark, sf_dir, "conversations"))


def parse_request(spark, sf_dir):
    rows = requests.parse_request(bodies(spark, sf_dir))
    return rows.select("conv_id", "request.model", "request.streaming", "request.session_id", F.array_join("request.prompts", "\n\n").alias("now"), F.array_join("request.full_body", "\n\n").alias("everything"))


def request_verdict(spark, sf_dir):
    rows = verdict.verdict(requests.parse_request(bodies(spark, sf_dir)), R.builtin_rules(spark))
    ids = F.array_join(F.transform("matches", lambda m: m.rule_id), ",")
    return rows.select("conv_id", "status", ids.alias("rules"))


def responses(spark, sf_dir) -> DataFrame:
    """Server-sent events of each conversation's assistant turns, one delta for each turn and a usage line."""
    turns = planted_turns(spark, sf_dir).where("role = 'assistant' AND text IS NOT NULL")
    delta = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"), F.struct(F.lit("text_delta").alias("type"), F.col("text")).alias("delta")))
    count = F.to_json(F.struct(F.lit("message_delta").alias("type"), F.struct(F.length("text").alias("input_tokens"), (F.col("turn") + 1).cast("int").alias("output_tokens")).alias("usage")))
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("data: "), delta, F.lit("\ndata: "), count).alias("line"))))
    grouped = turns.groupBy("conv_id").agg(lines.alias("l"))
    return grouped.select("conv_id", F.concat(F.array_join(F.transform("l", lambda x: x.line), "\n\n"), F.lit("\n\ndata: [DONE]\n")).alias("response"))


def response_text(spark, sf_dir):
    return responses(spark, sf_dir).select("conv_id", requests.response_text(F.col("response")).alias("text"))


def usage(spark, sf_dir):
    u = requests.usage(F.col("response"))
    return responses(spark, sf_dir).select("conv_id", u.input_tokens.alias("input_tokens"), u.output_tokens.alias("output_tokens"))


def audit_of_requests(spark, sf_dir):
    """Audit rows of the bodies with their responses, by status."""
    logged = {"request_id": F.col("conv_id").cast("string"), "ts": F.lit("2024-01-01").cast("timestamp"), "host": F.lit("claude.ai:443"), "path": F.lit("/v1"), "headers": F.lit(None).cast("map<string,string>")}
    judged = audit_job.audit_requests(bodies(spark, sf_dir).withColumns(logged), R.builtin_rules(spark))
    answers = responses(spark, sf_dir).select(F.col("conv_id").cast("string").alias("request_id"), (F.col("conv_id") % 9).alias("duration_ms"), "response")
    return audit_job.attach_responses(judged, answers).groupBy("status", "host").agg(
        F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("duration_ms").alias("duration"),
        F.sum(F.length("llm_response")).alias("said"),
    )


def block_notices(spark, sf_dir):
    """What a blocked request gets as an answer, and what an export shows of it."""
    rows = verdict.verdict(requests.parse_request(bodies(spark, sf_dir)), R.builtin_rules(spark))
    return rows.where("status = 'blocked'").select("conv_id", "notice", "safe_text")


def redact_body(spark, sf_dir):
    """The texts of redacted bodies, by all rules."""
    rows = redact_bodies(bodies(spark, sf_dir), R.builtin_rules(spark), agent_mode=True)
    return text_leaves_of(rows, ["conv_id"], "redacted_body").select("conv_id", "pos", "text")


def history_bodies(spark, sf_dir):
    """The texts of the bodies that are stored because earlier turns held something: nothing of it is left in them."""
    rules = R.builtin_rules(spark)
    rows = verdict.scrubbed_bodies(verdict.verdict(requests.parse_request(bodies(spark, sf_dir)), rules), rules)
    rows = verdict.keep_response(rows.where("size(history) > 0").withColumn("response", F.lit("")))
    leaves = text_leaves_of(rows, ["conv_id"], "raw_body")
    return detect.detect(leaves, rules, modes=["block"]).select("conv_id", "pos", "text", F.size("matches").alias("left"))


def nested_results(spark, sf_dir):
    """Turns as texts in tool results in tool results, up to eleven deep."""
    rows = spread(planted_turns(spark, sf_dir).where("text IS NOT NULL"), table(spark, sf_dir, "conversations"))
    depth = ((F.col("conv_id") + F.col("turn")) % 12).cast("int")
    block = F.concat(F.lit('[{"type":"text",'), F.substring(F.to_json(F.struct("text")), 2, 1 << 30), F.lit("]"))
    body = F.concat(F.lit('{"messages":[{"role":"user","content":'), F.repeat(F.lit('[{"type":"tool_result","content":'), depth), block, F.repeat(F.lit("}]"), depth), F.lit("}]}"))
    rows = verdict.verdict(requests.parse_request(rows.select("conv_id", "turn", body.alias("body"))), R.builtin_rules(spark))
    return rows.select("conv_id", "turn", "status", F.array_join("request.prompts", "\n\n").alias("now"))


def odd_bodies(spark, sf_dir):
    """Turns in bodies that VARIANT refuses, of six kinds, and in one that is cut off: none of them goes uninspected."""
    rows = spread(planted_turns(spark, sf_dir).where("text IS NOT NULL"), table(spark, sf_dir, "conversations"))
    block = F.concat(F.lit('[{"type":"text",'), F.substring(F.to_json(F.struct("text")), 2, 1 << 30), F.lit("]"))
    said = lambda content: F.concat(F.lit('"messages":[{"role":"user","content":'), content, F.lit("}]"))
    deep = F.concat(F.repeat(F.lit('[{"type":"tool_result","content":'), 2000), block, F.repeat(F.lit("}]"), 2000))
    heads = [
        F.lit('{"x":1,"x":2,'), F.lit('{"messages":[{"role":"user","content":"an earlier value"}],'), F.concat(F.lit('{"x":'), F.repeat(F.lit("7"), 1500), F.lit(",")),
        F.concat(F.lit('{"'), F.repeat(F.lit("k"), 70_000), F.lit('":0,')), F.concat(F.lit('{"x":'), F.repeat(F.lit("["), 1200), F.repeat(F.lit("]"), 1200), F.lit(",")),
    ]
    kind = (F.col("conv_id") * 5 + F.col("turn")) % 7
    body = F.when(kind == 5, F.concat(F.lit("{"), said(deep), F.lit("}"))).when(kind == 6, F.concat(F.lit('{"messages":['), "text"))
    for n, head in enumerate(heads):
        body = body.when(kind == n, F.concat(head, said(block), F.lit("}")))
    rows = verdict.verdict(requests.parse_request(rows.select("conv_id", "turn", body.alias("body"))), R.builtin_rules(spark), body_col="body")
    return rows.select("conv_id", "turn", "status", "request.unread", F.array_join("request.prompts", "\n\n").alias("now"))


def user_queries(spark, sf_dir):
    """Turns as requests of four kinds: a tagged query, a background task, items of the responses API, a legacy prompt."""
    rows = spread(planted_turns(spark, sf_dir).where("text IS NOT NULL"))
    said = lambda text: F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages")))
    part = lambda role, text: F.struct(F.lit(role).alias("role"), F.array(F.struct(F.lit("input_text").alias("type"), text.alias("text"))).alias("content"))
    text = F.col("text")
    items = F.array(part("user", F.lit("first")), part("assistant", F.lit("second")), part("user", text))
    body = (
        F.when(F.col("turn") % 4 == 0, said(F.concat(F.lit("<context>c</context><user_query> "), text, F.lit(" </user_query>"))))
        .when(F.col("turn") % 4 == 1, said(F.concat(F.lit("Summarize the following: "), text)))
        .when(F.col("turn") % 4 == 2, F.to_json(F.struct(F.lit("be brief").alias("instructions"), items.alias("input"))))
        .otherwise(F.to_json(F.struct(text.alias("prompt"))))
    )
    rows = requests.parse_request(rows.select("conv_id", "turn", body.alias("body")))
    return rows.select("conv_id", "turn", "request.user_query", "request.background", F.array_join("request.prompts", "\n\n").alias("now"))


def telemetry(spark, sf_dir):
    """Events as telemetry bodies; every fifth has no key and so is none."""
    events = table(spark, sf_dir, "events")
    rows = spread(events, events, 50_000)
    n = F.col("event_id")
    traits = F.struct(F.when(n % 2 == 0, F.lit("x")).alias("name"), F.when(n % 3 == 0, F.lit("a@b.example")).alias("email"), F.lit("").alias("ip"))
    event = lambda name: F.struct(name.alias("event"), F.struct(traits.alias("traits")).alias("context"))
    batch = F.array(event(F.col("event_type")), event(F.lit("seen")), event(F.col("event_type")))
    body = F.to_json(F.struct(F.when(n % 5 == 0, "").otherwise("k").alias("writeKey"), batch.alias("batch")))
    rows = rows.select("event_id", body.alias("body"))
    return rows.select("event_id", requests.is_telemetry(F.col("body")).alias("is_telemetry"), verdict.telemetry(F.col("body")).prompt.alias("summary"))


def sessions(spark, sf_dir):
    """Sessions and clients from headers of four kinds."""
    events = table(spark, sf_dir, "events")
    rows, n = spread(events, events, 50_000), F.col("event_id") % 4
    user = F.col("user_id").cast("string")
    agent = [F.lit("User-Agent"), F.concat(F.lit("agent/"), user, F.lit(" linux"))]
    headers = (
        F.when(n == 0, F.create_map(F.lit("Vscode-Sessionid"), F.concat(F.lit("v"), user), *agent))
        .when(n == 1, F.create_map(F.lit("x-client-session-id"), F.concat(F.lit("c"), user), F.lit("Copilot-Integration-Id"), F.lit("cli one"), *agent))
        .when(n == 2, F.create_map(F.lit("X-Client-Session-Id"), F.concat(F.lit("c"), user), *agent))
        .otherwise(F.create_map(*agent))
    )
    body = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("b"), user)).otherwise("")
    rows = requests.session_and_client(rows.select("event_id", headers.alias("headers"), body.alias("s")), session=F.col("s"))
    return rows.select("event_id", "session_id", "client")


def text_leaves(spark, sf_dir):
    rows = text_leaves_of(bodies(spark, sf_dir), ["conv_id"])
    return rows.groupBy("conv_id").agg(F.count("*").alias("leaves"), F.sum(F.length("text")).alias("chars"))


# Audit log


def _audit(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(audit_view(spark, sf_dir))


def _named_page(rows: DataFrame) -> DataFrame:
    return audit.list_prompts(rows, 3, 40, "blocked", "view").select("id", "ts", "host", "client")


def _context(rows: DataFrame) -> DataFrame:
    rows = audit.with_context_limit(rows, rows.sparkSession.createDataFrame(list(LIMITS.items()), "key string, tokens long"))
    use = audit.context_use(F.col("input_tokens"), F.col("context_limit"))
    return rows.groupBy(audit.context_band(use).alias("band"), "client").agg(F.count("*").alias("n"), F.sum(use).alias("percents"))


def _export(rows: DataFrame) -> DataFrame:
    text = verdict.safe_text(*map(F.col, ("status", "matches", "prompt", "redacted_prompt")))
    return audit.export_lines(audit.time_range(rows.withColumn("safe_text", text), "2024-01-05", "2024-01-12"))


def _bands(rows: DataFrame) -> DataFrame:
    return audit.model_latency(rows).select("client", "model", audit.latency_band(F.col("p95") * 10).alias("band"))


def _previews(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'flagged'").select("id", audit.preview(F.col("prompt"), 12).alias("preview"), audit.short_session(F.col("session_id")).alias("session"))


def _history_flags(rows: DataFrame) -> DataFrame:
    flag = verdict.history_only(*map(F.col, ("status", "matches", "prompt", "redacted_prompt")))
    return rows.groupBy("status", flag.alias("history_only")).agg(F.count("*").alias("n"))


def _header(rows: DataFrame) -> DataFrame:
    return audit.export_header(audit.time_range(rows, "2024-01-05", "2024-01-12"), "2024-01-05", "2024-01-12")


def _one_prompt(rows: DataFrame) -> DataFrame:
    return audit.get_prompt(rows, 7).select("id", "ts", "host", "status", "client", "prompt")


def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watch list: a rule for each word of ``conversations`` of six or more characters, which stands between white space or the ends of a text."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", r"[\t\n\f\r ]+")).alias("w")).where("length(w) >= 6").distinct()
    quoted = F.regexp_replace("w", r"([^\p{L}\p{N}_])", r"\\$1")
    pattern = lambda space, end: F.concat(F.lit(f"(?:^|{space})"), quoted, F.lit(f"(?:{space}|{end})"))
    known = {
        "ord": F.xxhash64("w"), "rule_id": F.col("w"), "rule_name": F.col("w"), "pattern_re2": pattern(r"\s", "$"), "pattern_java": pattern(r"[\t\n\f\r ]", r"\z"),
        "severity": F.lit("low"), "mode": F.lit("track"), "keywords": F.array(detect.fold(F.col("w"))),
    }
    return words.select(*[known.get(c, F.lit("")).alias(c) for c in spark.createDataFrame([], R.SCHEMA).columns])


def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the number of rules of ``word_rules`` that fire (16,080 rules at sf0.01), and the length of their words."""
    found = indexed_findings(documents(spark, sf_dir), word_rules(spark, sf_dir), ["doc_id"])
    return found.groupBy("doc_id").agg(F.count("*").alias("rules"), F.sum(F.length("rule_id")).alias("chars"), F.min("start").cast("long").alias("first"))


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that the session names; a local one only where the master is local and none is named."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return f"{top or tempfile.mkdtemp(prefix='spark-')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def late_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stored log; every third one is answered twice after it was written, and the newer answer is merged in."""
    path, e = scratch(spark), table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("request_id"), "*")
    zero = {c: F.lit(0).cast("long") for c in ("duration_ms", "input_tokens", "output_tokens")}
    audit_log.write_audit(e.select("request_id", "ts", F.when(F.col("event_id") % 2 == 0, "redacted").otherwise("clean").alias("status")).withColumns(zero | {"llm_response": F.lit("")}), path)
    used = F.struct((F.col("event_id") % 7).alias("input_tokens"), (F.col("event_id") % 11).alias("output_tokens"))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("event_type").alias("text"))).alias("content"), used.alias("usage")))
    answers = e.where("event_id % 3 = 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(2)))).select(
        "request_id", (F.col("ts") + F.expr("make_interval(0, 0, 0, n)")).alias("response_ts"), (F.col("event_id") % 100 + F.col("n")).alias("duration_ms"), F.when(F.col("n") == 2, body).otherwise("").alias("response"))
    audit_log.merge_responses(spark, path, answers)
    return audit_log.read_audit(spark, path, ["request_id", "status", *zero, "llm_response"])


QUERIES: dict[str, Query] = {
    "late_responses": late_responses,
    "many_rules": many_rules,
    "rule_hits": rule_hits,
    "hits_by_lang_severity": hits_by_lang_severity,
    "first_match_pos": first_match_pos,
    "snippets": snippets,
    "luhn_cards": luhn_cards,
    "redact_track": redact_track,
    "redact_all": redact_all,
    "redact_groups": redact_groups,
    "scan_status": scan_status,
    "severity_of_documents": severity_of_documents,
    "leak_rate_by_label": leak_rate_by_label,
    "page_findings": safe_pages,
    "overrides": overrides,
    "clean_pages": clean_pages,
    "page_host": page_host,
    "current_turn": current_turn,
    "history_only": history_only,
    "turn_verdict": turn_verdict,
    "parse_request": parse_request,
    "request_verdict": request_verdict,
    "response_text": response_text,
    "usage": usage,
    "audit_of_requests": audit_of_requests,
    "rule_report": rule_report,
    "block_notices": block_notices,
    "redact_body": redact_body,
    "history_bodies": history_bodies,
    "nested_results": nested_results,
    "odd_bodies": odd_bodies,
    "user_queries": user_queries,
    "telemetry": telemetry,
    "sessions": sessions,
    "text_leaves": text_leaves,
    "audit_stats": _audit(audit.audit_stats),
    "most_flagged_host": _audit(audit.most_flagged_host),
    "model_latency": _audit(audit.model_latency),
    "latency_bands": _audit(_bands),
    "latency_pivot": _audit(lambda rows: audit.latency_pivot(rows, ["click", "view"]).select("model", "click_p50", "click_p95", "click_n", "view_p50", "view_p95", "view_n")),
    "list_page": _audit(_named_page),
    "search_count": _audit(lambda rows: audit.count_prompts(rows, "", "ANTHROPIC")),
    "export_lines": _audit(_export),
    "export_counts": _audit(lambda rows: audit.export_counts(audit.time_range(rows, "2024-01-05", "2024-01-12"))),
    "context_use": _audit(_context),
    "previews": _audit(_previews),
    "history_flags": _audit(_history_flags),
    "export_header": _audit(_header),
    "get_prompt": _audit(_one_prompt),
}

_LATENCY = f"""SELECT client, model, list_sort(list(duration_ms)) AS d, count(*) AS sample FROM (
  SELECT *, row_number() OVER (PARTITION BY client, model ORDER BY ts DESC, id DESC) AS k FROM {AUDIT} WHERE model <> '' AND duration_ms > 0) WHERE k <= 50 GROUP BY client, model"""
_AT = "d[least(CAST(floor(sample * {q}::DOUBLE) AS BIGINT), sample - 1) + 1]"
_ALL_HITS = hits_sql("documents", "doc_id", ROWS)
_NOW = f"(SELECT *, coalesce(turn > max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id), true) AS now FROM {TURNS})"
_TURN_HITS = " UNION ALL ".join(f"SELECT conv_id, now, {sql_text(r[1])} AS rule_id, '{r[7]}' AS mode FROM turns WHERE {rule_sql(r)}" for r in ROWS)


def _redact_sql(rows: list[tuple], text: str) -> str:
    for r in rows:
        if r[10] == "luhn":
            found = f"list_filter(list_distinct(regexp_extract_all({{x}}, {sql_text(r[4])})), lambda m: {LUHN.format(m='m')})"
            text = f"(SELECT list_reduce(list_prepend(x, {found.format(x='x')}), lambda t, m: regexp_replace(t, '\\b' || m || '\\b', '[REDACTED]', 'g')) FROM (SELECT {text} AS x))"
        else:
            text = f"regexp_replace({text}, {sql_text(r[4])}, {sql_text(replacement_to_re2(r[8]))}, 'g')"
    return text


def _places_sql(what: str) -> str:
    """Each document and rule with the first match (``hit``) and where it starts, from 1."""
    parts = []
    for r in ROWS:
        if r[10] == "luhn":
            hit = f"list_filter(regexp_extract_all(text, {sql_text(r[4])}), lambda m: {LUHN.format(m='m')})[1]"
            start = f"length(regexp_extract(text, '(?s:^(.*?))\\b' || {hit} || '\\b', 1)) + 1"
        else:
            hit = f"regexp_extract(text, {sql_text(r[4])})"
            start = f"length(regexp_extract(text, {sql_text('(?s:^(.*?))(?:' + r[4] + ')')}, 1)) + 1"
        parts.append(f"SELECT doc_id, {sql_text(r[1])} AS rule_id, text, {hit} AS hit, {start} AS start FROM documents WHERE {rule_sql(r)}")
    return f"SELECT {what} FROM ({' UNION ALL '.join(parts)})"


def _fired_list(rows: list[tuple], text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {rule_sql(r, text)} THEN {sql_text(r[1])} END" for r in rows) + "], lambda x: x IS NOT NULL)"


_CLEANED = f"""(SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t,
  coalesce(turn > max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id), true) AS now FROM {TURNS} WHERE text IS NOT NULL)"""
_PARSED = f"""(SELECT conv_id, 'm' || (conv_id % 3) AS model, conv_id % 2 = 0 AS streaming, 's' || conv_id AS session_id,
  coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (now AND k_now = 1 AND t <> ''), '') AS now, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (k = 1 AND t <> ''), '') AS everything
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, now, t ORDER BY turn) AS k_now, row_number() OVER (PARTITION BY conv_id, t ORDER BY turn) AS k FROM {_CLEANED}) GROUP BY conv_id)"""
_VERDICTS = f"""(WITH p AS MATERIALIZED {_PARSED},
  v AS (SELECT conv_id, now, {_fired_list(BLOCK, 'now')} AS b, {_fired_list(TRACK, 'now')} AS t, CASE WHEN everything <> now THEN {_fired_list(BLOCK, 'everything')} ELSE [] END AS h FROM p),
  w AS (SELECT conv_id, now, b, t, CASE WHEN len(b) = 0 THEN h ELSE [] END AS h FROM v)
  SELECT conv_id, CASE WHEN len(b) > 0 THEN 'blocked' WHEN len(t) + len(h) > 0 THEN 'redacted' ELSE 'clean' END AS status, array_to_string(b || t || h, ',') AS rules
  FROM w WHERE now <> '' OR len(b) + len(t) + len(h) > 0)"""
_USAGE = f"SELECT conv_id, CAST(max(length(text)) AS INT) AS input_tokens, CAST(max(turn + 1) AS INT) AS output_tokens FROM {TURNS} WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id"
_CARDS = f"list_filter(list_distinct(regexp_extract_all(text, pattern)), lambda m: {LUHN.format(m='m')})"


def _fold_sql(source: str, keys: str, rows: list[tuple], where: str = "true") -> str:
    """The fold as recursion: each step applies the next rule to what the one before left."""
    values = ", ".join(f"({n}, {sql_text(r[4])}, {sql_text(replacement_to_re2(r[8]))}, '{r[10]}')" for n, r in enumerate(rows))
    return f"""WITH RECURSIVE rules(ord, pattern, replacement, validator) AS (VALUES {values}),
  f AS (SELECT {keys}, 0 AS k, text, 0 AS fired FROM {source} UNION ALL
    SELECT {keys}, k + 1, after, fired + CASE WHEN after <> text THEN 1 ELSE 0 END FROM (SELECT {keys}, k, text, fired, CASE WHEN validator = 'luhn'
      THEN list_reduce(list_prepend(text, {_CARDS}), lambda t, m: regexp_replace(t, '\\b' || m || '\\b', '[REDACTED]', 'g'))
      ELSE regexp_replace(text, pattern, replacement, 'g') END AS after FROM f JOIN rules ON ord = k))
  SELECT {keys}, text, CAST(fired AS INT) AS fired FROM f WHERE k = {len(rows)} AND {where}"""


_LEAVES = f"(SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS pos, text FROM {TURNS} WHERE text IS NOT NULL)"
_HISTORY = _VERDICTS.replace("SELECT conv_id, CASE WHEN len(b) > 0", "SELECT conv_id, h, b, CASE WHEN len(b) > 0")
_NAMES = "MAP {" + ", ".join(f"{sql_text(r[1])}: {sql_text(r[2])}" for r in ROWS) + "}"
_SQUEEZED = "trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


def _report_sql() -> str:
    rank = {"high": 0, "medium": 1, "low": 2}
    shown = sorted((r for r in ROWS if any("key" in r[k].lower() for k in (1, 2, 3))), key=lambda r: (rank[r[6]], r[2].lower()))
    label = lambda r: " ".join(w.capitalize() for w in r[1].split("-")) if r[1] == r[2] else r[2]
    return " UNION ALL ".join(
        f"SELECT CAST({r[0]} AS INT) AS ord, {sql_text(r[1])} AS rule_id, {sql_text(label(r))} AS label, '{r[6]}' AS severity, "
        f"'{'track' if r[1] == 'aws-access-token' else r[7]}' AS mode, count(*) AS docs FROM documents WHERE {rule_sql(r)}" for r in shown)


SQL: dict[str, str] = {
    "late_responses": """SELECT CAST(event_id AS VARCHAR) AS request_id, CASE WHEN event_id % 2 = 0 THEN 'redacted' ELSE 'clean' END AS status,
      CASE WHEN event_id % 3 = 0 THEN event_id % 100 + 2 ELSE 0 END AS duration_ms, CASE WHEN event_id % 3 = 0 THEN event_id % 7 ELSE 0 END AS input_tokens,
      CASE WHEN event_id % 3 = 0 THEN event_id % 11 ELSE 0 END AS output_tokens, CASE WHEN event_id % 6 = 0 THEN event_type ELSE '' END AS llm_response FROM events""",
    "many_rules": r"""WITH words AS (SELECT DISTINCT doc_id, text, unnest(regexp_split_to_array(text, '[\t\n\f\r ]+')) AS w FROM documents),
      rules AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[\t\n\f\r ]+')) AS w FROM conversations)
      SELECT doc_id, count(*) AS rules, CAST(sum(length(w)) AS BIGINT) AS chars,
        min(CASE WHEN starts_with(text, w) AND regexp_matches(substring(text, length(w) + 1, 1), '^(\s|$)') THEN 1
          ELSE length(regexp_extract(text, '(?s)^(.*?)\s' || regexp_escape(w) || '(\s|$)', 1)) + 1 END) AS first
      FROM words JOIN rules USING (w) WHERE length(w) >= 6 GROUP BY doc_id""",
    "rule_hits": " UNION ALL ".join(f"SELECT doc_id, {sql_text(r[1])} AS rule_id, '{r[6]}' AS severity, '{r[7]}' AS mode FROM documents WHERE {rule_sql(r)}" for r in ROWS),
    "hits_by_lang_severity": f"SELECT lang, severity, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM ({_ALL_HITS}) h JOIN documents USING (doc_id) GROUP BY ALL",
    "first_match_pos": _places_sql("doc_id, rule_id, CAST(start AS INT) AS start"),
    "snippets": _places_sql("""doc_id, rule_id, CASE WHEN start > 21 THEN '…' ELSE '' END || substring(text, greatest(start - 20, 1), start + length(hit) + 19 - greatest(start - 20, 1) + 1)
        || CASE WHEN start + length(hit) + 19 < length(text) THEN '…' ELSE '' END AS snippet"""),
    "luhn_cards": f"SELECT doc_id, card FROM (SELECT doc_id, unnest(regexp_extract_all(text, {sql_text(BY_ID['credit-card'][4])})) AS card FROM documents) WHERE {LUHN.format(m='card')}",
    "redact_track": f"SELECT doc_id, {_redact_sql(TRACK, 'text')} AS redacted FROM documents WHERE " + " OR ".join(rule_sql(r) for r in TRACK),
    "redact_groups": f"SELECT doc_id, CAST(length(t) AS INT) AS chars, md5(t) AS digest FROM (SELECT doc_id, {_redact_sql([BY_ID['generic-secret']], f'(text || {sql_text(PLANTED)})')} AS t FROM documents)",
    "rule_report": _report_sql(),
    "redact_body": f"SELECT conv_id, pos, text FROM ({_fold_sql(_LEAVES, 'conv_id, pos', ROWS)})",
    "history_bodies": f"SELECT conv_id, pos, text, 0 AS left FROM ({_fold_sql(_LEAVES, 'conv_id, pos', BLOCK)}) WHERE conv_id IN (SELECT conv_id FROM {_HISTORY} WHERE len(h) > 0)",
    "block_notices": f"""SELECT conv_id, 'This request was blocked. It held values that these rules find:' || chr(10) || array_to_string(list_transform(b, lambda x: '- ' || ({_NAMES})[x]), chr(10)) AS notice,
      '[blocked — content withheld. Rules matched: ' || array_to_string(list_transform(string_split(rules, ','), lambda x: ({_NAMES})[x]), ', ') || ']' AS safe_text FROM {_HISTORY} WHERE status = 'blocked'""",
    "nested_results": f"""SELECT conv_id, turn, CASE WHEN {' OR '.join(rule_sql(r, 'now') for r in BLOCK)} THEN 'blocked' WHEN {' OR '.join(rule_sql(r, 'now') for r in TRACK)} THEN 'redacted' ELSE 'clean' END AS status, now
      FROM (SELECT conv_id, turn, {_SQUEEZED} AS now FROM {TURNS} WHERE text IS NOT NULL) WHERE now <> ''""",
    "odd_bodies": f"""SELECT conv_id, turn, CASE WHEN {' OR '.join(rule_sql(r, 'seen') for r in BLOCK)} THEN 'blocked' WHEN {' OR '.join(rule_sql(r, 'seen') for r in TRACK)} THEN 'redacted' ELSE 'clean' END AS status,
      unread, CASE WHEN unread THEN '' ELSE now END AS now
      FROM (SELECT *, CASE WHEN unread THEN '{{"messages":[' || text ELSE now END AS seen
        FROM (SELECT conv_id, turn, text, (conv_id * 5 + turn) % 7 = 6 AS unread, {_SQUEEZED} AS now FROM {TURNS} WHERE text IS NOT NULL)) WHERE seen <> ''""",
    "user_queries": f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN CASE WHEN raw <> '' THEN raw ELSE 'c' END WHEN 1 THEN trim('Summarize the following: ' || t) WHEN 2 THEN t ELSE text END AS user_query, turn % 4 = 1 AS background,
      CASE turn % 4 WHEN 0 THEN trim('c ' || t) WHEN 1 THEN trim('Summarize the following: ' || t) WHEN 2 THEN 'be brief' || CASE WHEN t NOT IN ('', 'be brief') THEN chr(10) || chr(10) || t ELSE '' END ELSE t END AS now
      FROM (SELECT conv_id, turn, text, {_SQUEEZED} AS t, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS raw FROM {TURNS} WHERE text IS NOT NULL)""",
    "telemetry": """SELECT event_id, event_id % 5 <> 0 AS is_telemetry, 'Events: ' || event_type || ', seen' || CASE WHEN event_id % 6 = 0 THEN ' | PII fields: email, name'
      WHEN event_id % 2 = 0 THEN ' | PII fields: name' WHEN event_id % 3 = 0 THEN ' | PII fields: email' ELSE '' END AS summary FROM events""",
    "sessions": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'v' || user_id WHEN 1 THEN 'c' || user_id WHEN 2 THEN 'c' || user_id ELSE CASE WHEN user_id % 2 = 0 THEN 'b' || user_id ELSE '' END END AS session_id,
      CASE WHEN event_id % 4 = 1 THEN 'cli' WHEN event_id % 4 = 3 AND user_id % 2 <> 0 THEN '' ELSE 'agent/' || user_id END AS client FROM events""",
    "history_flags": f"SELECT status, status = 'redacted' AND (id % 2 = 0 OR prompt = 'changed') AS history_only, count(*) AS n FROM {AUDIT} GROUP BY ALL",
    "export_header": f"""SELECT CAST(0 AS BIGINT) AS n, 'Days: 2024-01-05 to 2024-01-12' || chr(10) || 'Prompts: ' || count(*) || ', of which ' || count(*) FILTER (status = 'blocked') || ' blocked and '
      || count(*) FILTER (status = 'redacted') || ' redacted' || chr(10) AS line FROM {AUDIT} WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'""",
    "get_prompt": f"SELECT id, ts, host, status, client, prompt FROM {AUDIT} WHERE id = 7",
    "redact_all": _fold_sql("documents", "doc_id", ROWS, "fired > 0").replace("text, CAST(fired", "text AS redacted, CAST(fired"),
    "parse_request": f"SELECT * FROM {_PARSED}",
    "request_verdict": f"SELECT * FROM {_VERDICTS}",
    "audit_of_requests": f"""SELECT status, 'claude.ai' AS host, count(*) AS n, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens,
      CAST(sum(CASE WHEN input_tokens IS NULL THEN 0 ELSE conv_id % 9 END) AS BIGINT) AS duration, CAST(sum(CASE WHEN status = 'redacted' THEN coalesce(said, 0) ELSE 0 END) AS BIGINT) AS said
      FROM {_VERDICTS} LEFT JOIN ({_USAGE}) USING (conv_id)
      LEFT JOIN (SELECT conv_id, sum(length(text)) AS said FROM {TURNS} WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id) USING (conv_id) GROUP BY status""",
    "scan_status": f"SELECT doc_id, CASE WHEN {' OR '.join(rule_sql(r) for r in BLOCK)} THEN 'blocked' WHEN {' OR '.join(rule_sql(r) for r in TRACK)} THEN 'redacted' ELSE 'clean' END AS status FROM documents",
    "severity_of_documents": "SELECT doc_id, CASE " + " ".join(
        f"WHEN {' OR '.join(rule_sql(r) for r in ROWS if r[6] == s)} THEN '{s}'" for s in ("high", "medium", "low")) + " ELSE '' END AS severity FROM documents",
    "leak_rate_by_label": f"SELECT quality, toxic, count(*) AS docs, count(h.doc_id) AS leaks FROM labels LEFT JOIN (SELECT DISTINCT doc_id FROM ({_ALL_HITS})) h USING (doc_id) GROUP BY quality, toxic",
    "page_findings": "WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages) " + " UNION ALL ".join(
        f"SELECT page_id, {sql_text(r[1])} AS rule_id, '{r[6]}' AS severity, '{r[7]}' AS mode FROM p WHERE {rule_sql(r)}" for r in ROWS),
    "overrides": f"""SELECT rule_id, mode, severity, count(*) AS docs FROM (
      SELECT 'email' AS rule_id, 'block' AS mode, 'high' AS severity FROM documents WHERE {rule_sql(BY_ID['email'])} UNION ALL
      SELECT 'credit-card', 'track', 'medium' FROM documents WHERE {rule_sql(BY_ID['credit-card'])} UNION ALL
      SELECT 'long-number', 'track', 'low' FROM documents WHERE regexp_matches(text, '\\b\\d{{12}}\\b')) GROUP BY ALL""",
    "clean_pages": "SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages",
    "page_host": "SELECT page_id, regexp_extract(coalesce(url, ''), 'https?://([^/]+)', 1) AS host, " + " OR ".join(
        f"regexp_replace(regexp_extract(coalesce(url, ''), 'https?://([^/]+)', 1), ':\\d+$', '') LIKE '%{s}'" for s in requests.TARGET_SUFFIXES)
        + " AS is_target, regexp_replace(coalesce(url, ''), '/[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '/…', 'g') AS masked FROM pages",
    "current_turn": "SELECT conv_id, turn, role, text FROM (SELECT *, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS a FROM conversations) WHERE a IS NULL OR turn > a",
    "history_only": f"""WITH turns AS {_NOW}, hits AS ({_TURN_HITS}) SELECT DISTINCT conv_id, rule_id FROM hits h WHERE mode = 'block' AND NOT now
      AND NOT EXISTS (SELECT 1 FROM hits n WHERE n.now AND n.mode = 'block' AND n.conv_id = h.conv_id AND n.rule_id = h.rule_id)""",
    "turn_verdict": f"""WITH turns AS {_NOW}, hits AS ({_TURN_HITS}) SELECT c.conv_id, CASE WHEN coalesce(bool_or(now AND mode = 'block'), false) THEN 'blocked'
      WHEN count(h.conv_id) FILTER (now OR mode = 'block') > 0 THEN 'redacted' ELSE 'clean' END AS status
      FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN hits h USING (conv_id) GROUP BY c.conv_id""",
    "response_text": f"SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM {TURNS} WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id",
    "usage": _USAGE,
    "text_leaves": f"SELECT conv_id, count(*) AS leaves, CAST(sum(length(text)) AS BIGINT) AS chars FROM {TURNS} WHERE text IS NOT NULL GROUP BY conv_id",
    "audit_stats": f"""SELECT count(*) AS total, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ('clean', 'flagged', 'redacted', 'blocked', 'telemetry'))},
      CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM {AUDIT}""",
    "most_flagged_host": f"SELECT host, count(*) AS n FROM {AUDIT} WHERE status NOT IN ('clean', 'telemetry') GROUP BY host ORDER BY n DESC, host LIMIT 1",
    "model_latency": f"SELECT client, model, {_AT.format(q='0.5')} AS p50, {_AT.format(q='0.95')} AS p95, {_AT.format(q='0.99')} AS p99, sample FROM ({_LATENCY})",
    "latency_bands": f"SELECT client, model, CASE WHEN {_AT.format(q='0.95')} * 10 > 10000 THEN 'danger' WHEN {_AT.format(q='0.95')} * 10 > 5000 THEN 'warning' ELSE 'ok' END AS band FROM ({_LATENCY})",
    "latency_pivot": f"""SELECT model, {', '.join(f"max({v}) FILTER (client = '{c}') AS {c}_{n}" for c in ('click', 'view') for v, n in (('p50', 'p50'), ('p95', 'p95'), ('sample', 'n')))}
      FROM (SELECT client, model, {_AT.format(q='0.5')} AS p50, {_AT.format(q='0.95')} AS p95, sample FROM ({_LATENCY})) GROUP BY model""",
    "list_page": f"SELECT id, ts, host, client FROM {AUDIT} WHERE status = 'blocked' AND (prompt ILIKE '%view%' OR host ILIKE '%view%' OR client ILIKE '%view%' OR session_id ILIKE '%view%') ORDER BY ts DESC, id DESC LIMIT 40 OFFSET 80",
    "search_count": f"SELECT count(*) AS n FROM {AUDIT} WHERE prompt ILIKE '%ANTHROPIC%' OR host ILIKE '%ANTHROPIC%' OR client ILIKE '%ANTHROPIC%' OR session_id ILIKE '%ANTHROPIC%'",
    "export_lines": f"""SELECT row_number() OVER (ORDER BY ts, id) AS n, '[' || row_number() OVER (ORDER BY ts, id) || '] ' || strftime(ts, '%Y-%m-%d %H:%M') || ' | ' || host || ' | ' || status || chr(10)
      || CASE WHEN status = 'blocked' THEN '[blocked — content withheld. Rules matched: ' || client || ']' WHEN id % 2 = 1 THEN 'changed' ELSE prompt END AS line FROM {AUDIT} WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'""",
    "export_counts": f"SELECT count(*) AS total, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'redacted') AS redacted FROM {AUDIT} WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'",
    "context_use": f"""WITH u AS (SELECT client, CASE WHEN input_tokens > 0 THEN CAST(least(floor(input_tokens / CAST(CASE WHEN contains(lower(client), 'click') THEN 400 WHEN contains(lower(client), 'view') THEN 150 ELSE 200000 END AS DOUBLE) * 100 + 0.5), 100) AS INT) END AS p FROM {AUDIT})
      SELECT CASE WHEN p >= 90 THEN 'red' WHEN p >= 75 THEN 'amber' WHEN p IS NOT NULL THEN 'green' END AS band, client, count(*) AS n, CAST(sum(p) AS BIGINT) AS percents FROM u GROUP BY ALL""",
    "previews": f"SELECT id, CASE WHEN length(prompt) > 12 THEN substring(prompt, 1, 12) || '…' ELSE prompt END AS preview, substring(session_id, 1, 8) AS session FROM {AUDIT} WHERE status = 'flagged'",
}
