"""From request and response logs to audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.operators import requests, verdict
from hushlake.sources.audit_log import AUDIT


def audit_requests(rows: DataFrame, rules: DataFrame, agent_mode: bool = False) -> DataFrame:
    """Audit rows of requests to the watched hosts, before any response: verdicts of prompts, and summaries of telemetry.

    Narrow throughout and with one read of the log, so the same plan serves batches and streams. Bodies go no further:
    rows with history matches have a scrubbed_body. A body that no reader finds a request in is judged as a text, and its row is ``unread``.
    """
    rows = rows.where(requests.is_target_host(F.col("host"))).withColumn("host", requests.strip_port(F.col("host")))
    rows = requests.readable(rows, "body", "_readable")
    rows = rows.withColumn("_telemetry", requests.is_telemetry(F.col("_readable"))).withColumn("_prompt", F.when(~F.col("_telemetry"), F.col("body")))
    rows = rows.withColumn("_asked", F.when(~F.col("_telemetry"), F.col("_readable")))
    parsed = requests.session_and_client(requests.parse_request(rows, "_prompt", "_asked"))
    whole = F.when(F.col("_telemetry"), verdict.telemetry(F.col("_readable"))).otherwise(verdict.judged(rules, agent_mode, "_prompt"))
    found = verdict.scrubbed_bodies(verdict.with_columns(parsed, whole), rules)
    own = lambda c: F.when(F.col("_telemetry"), F.lit("")).otherwise(c)
    named = {"model": own(F.col("request.model")), "session_id": own(F.col("session_id")), "client": own(F.col("client")), "agent_mode": F.lit(agent_mode), "unread": F.col("request.unread")}
    return found.withColumns(named).drop("body", "headers", "request", "_telemetry", "_prompt", "_readable", "_asked")


def attach_responses(judged: DataFrame, responses: DataFrame) -> DataFrame:
    """Audit rows with duration, tokens and, where kept, the response: a left join on request_id, the only shuffle."""
    return finished(judged.join(responses, "request_id", "left"))


def finished(joined: DataFrame) -> DataFrame:
    u = requests.usage(F.col("response"))
    rows = joined.withColumns({
        "input_tokens": F.coalesce(u.input_tokens, F.lit(0)), "output_tokens": F.coalesce(u.output_tokens, F.lit(0)),
        "duration_ms": F.coalesce("duration_ms", F.lit(0)), "said": requests.response_text(F.col("response")),
    })
    return verdict.keep_response(rows, "said").select(*AUDIT)
