"""The verdict on a request: blocked, redacted, flagged or clean, and what is stored of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.operators.bodies import redact_bodies
from hushlake.operators.detect import MATCH, inspect, let, redact, rule_array
from hushlake.operators.requests import telemetry_summary

CAP = 512 * 1024


def none() -> Column:
    return F.from_json(F.lit("[]"), f"array<struct<{MATCH}>>")


def verdict(df: DataFrame, rules: DataFrame, agent_mode: bool = False, body_col: str | None = None) -> DataFrame:
    """``df`` with the columns of ``judged``; rows without text and matches are left out. Give ``body_col`` so that bodies
    that are no request are judged as texts and stay."""
    return with_columns(df, judged(rules, agent_mode, body_col))


def with_columns(df: DataFrame, whole: Column) -> DataFrame:
    """``df`` with a struct's fields. Out of a generator the struct is computed once, and the filter on it stays behind it."""
    rows = df.select("*", F.explode(F.array(whole)).alias("_a")).where("_a IS NOT NULL")
    return rows.select(*df.columns, "_a.*")


def judged(rules: DataFrame, agent_mode: bool = False, body_col: str | None = None) -> Column:
    """Audit columns for a row with ``request`` (see parse_request): struct<status, matches, history, prompt, redacted_prompt,
    safe_text, notice>, null for a row without text and matches.

    The current turn blocks (unless the request is a background one) or redacts; matches of block rules that only
    earlier turns hold redact. Agent mode inspects nothing and redacts with all rules. All of it is narrow, and each
    text is inspected once. A body that is no request (``request.unread``) is judged as one plain text.
    """
    block = rule_array(rules, ["block"])
    track = rule_array(rules, None if agent_mode else ["track"])
    names = lambda ms: F.transform(F.filter(ms, lambda m: m.mode == "block"), lambda m: F.concat(F.lit("- "), m.rule_name))
    heading = F.lit("This request was blocked. It held values that these rules find:\n")
    query = F.coalesce(F.col("request.user_query"), F.lit(""))

    def audit(now: Column, full: Column, found: Column, scrubbed: Column, history: Column) -> Column:
        matches = F.concat(found, scrubbed.matches, history)
        status = status_of(F.size(found) > 0, F.size(scrubbed.matches) > 0, F.size(history) > 0, F.col("request.background"), F.size(matches) > 0)
        prompt = F.when(query != "", query).otherwise(now)
        redacted = F.when(query != "", redact(query, track).text).otherwise(scrubbed.text)
        texts = let(redacted, lambda r: F.struct(r.alias("redacted"), redact(r, block).text.alias("safe")))
        fields = lambda s, t: F.struct(
            s.alias("status"), matches.alias("matches"), history.alias("history"), prompt.alias("prompt"), t.redacted.alias("redacted_prompt"),
            F.when(s == "blocked", withheld(matches)).otherwise(t.safe).alias("safe_text"),
            F.when(s == "blocked", F.concat(heading, F.array_join(names(found), "\n"))).otherwise("").alias("notice"),
        )
        whole = let(status, lambda s: let(texts, lambda t: fields(s, t)))
        return F.when((now != "") | (F.size(matches) > 0), whole)

    def with_history(now: Column, full: Column, found: Column, scrubbed: Column) -> Column:
        ask = (F.size(found) == 0) & (full != "") & (full != now)
        history = none() if agent_mode else F.when(ask, inspect(full, block)).otherwise(none())
        return let(history, lambda h: audit(now, full, found, scrubbed, h))

    def of(now: Column, full: Column) -> Column:
        found = none() if agent_mode else inspect(now, block)
        return let(found, lambda f: let(redact(now, track), lambda r: with_history(now, full, f, r)))

    plain = F.coalesce(F.col(body_col), F.lit("")) if body_col else F.lit("")
    joined = lambda c: F.when(F.col("request.unread"), plain).otherwise(F.array_join(F.col(f"request.{c}"), "\n\n"))
    return let(joined("prompts"), lambda now: let(joined("full_body"), lambda full: of(now, full)))


def status_of(block: Column, track: Column, history: Column, background: Column, any_match: Column) -> Column:
    return F.when(block & ~F.coalesce(background, F.lit(False)), "blocked").when(block | track | history, "redacted").when(any_match, "flagged").otherwise("clean")


def withheld(matches: Column) -> Column:
    names = F.array_join(F.transform(matches, lambda m: m.rule_name), ", ")
    # The form of the line.
    return F.concat(F.lit("[blocked — content withheld. Rules matched: "), names, F.lit("]"))


def safe_text(status: Column, matches: Column, prompt: Column, redacted_prompt: Column) -> Column:
    """What an export may show of a stored row."""
    return F.when(status == "blocked", withheld(matches)).when(F.coalesce(redacted_prompt, F.lit("")) != "", redacted_prompt).otherwise(prompt)


def history_only(status: Column, matches: Column, prompt: Column, redacted_prompt: Column) -> Column:
    same = (F.coalesce(redacted_prompt, F.lit("")) == "") | (redacted_prompt == prompt)
    return (status == "redacted") & (F.size(matches) > 0) & same


def telemetry(body: Column) -> Column:
    """The audit columns (see judged) of a telemetry body: its summary as prompt."""
    summary, empty = telemetry_summary(body), F.lit("")
    fields = {"status": F.lit("telemetry"), "matches": none(), "history": none(), "prompt": summary, "redacted_prompt": empty, "safe_text": summary, "notice": empty}
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def scrubbed_bodies(df: DataFrame, rules: DataFrame, body_col: str = "body") -> DataFrame:
    """``df`` with scrubbed_body: the body of a row with history matches, its texts redacted by the block rules. It is
    empty for other rows, and where the rules still find something in the body's texts taken together."""
    rows = df.withColumn("_h", F.when(F.size("history") > 0, F.col(body_col)))
    return redact_bodies(rows, rules, "_h", block=True, out_col="scrubbed_body", sure=True).drop("_h")


def keep_response(df: DataFrame, response_col: str = "response", body_col: str = "scrubbed_body") -> DataFrame:
    """llm_response stays for redacted rows only; raw_body is the scrubbed body (see scrubbed_bodies), where history had
    matches. Both are cut at CAP characters."""
    return df.withColumns({
        "llm_response": F.when(F.col("status") == "redacted", F.substring(response_col, 1, CAP)).otherwise(""),
        "raw_body": F.when(F.size("history") > 0, F.substring(body_col, 1, CAP)).otherwise(""),
    })
