"""Queries over the audit log."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE, MAX_PAGE = 25, 200
LAST = 50
DEFAULT_LIMIT = 200_000


def status_filter(df: DataFrame, status: str = "") -> DataFrame:
    return df if status in ("", "all") else df.where(F.col("status") == status)


def search_filter(df: DataFrame, word: str = "") -> DataFrame:
    """Rows whose prompt, host, client or session_id holds the word; case is ignored, % and _ are wildcards."""
    if not word:
        return df
    pattern = f"%{word}%".replace("\\", "\\\\")
    hit = F.lit(False)
    for c in ("prompt", "host", "client", "session_id"):
        hit = hit | F.col(c).ilike(pattern)
    return df.where(hit)


def time_range(df: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows from the first day to the end of the last one; days that are none are ignored. Where the log is partitioned
    by day (``dt``), only the folders of these days are read."""
    day = lambda s: F.try_to_timestamp(F.lit(s), F.lit("yyyy-MM-dd"))
    by_day = "dt" in df.columns
    if first:
        df = df.where(day(first).isNull() | (F.col("ts") >= day(first)))
        df = df.where(day(first).isNull() | (F.col("dt") >= F.to_date(day(first)))) if by_day else df
    if last:
        df = df.where(day(last).isNull() | (F.col("ts") < day(last) + F.expr("INTERVAL 1 DAY")))
        df = df.where(day(last).isNull() | (F.col("dt") <= F.to_date(day(last)))) if by_day else df
    return df


def preset(name: str, today: date) -> tuple[str | None, str | None]:
    """First and last day of a named range; ``all`` and unknown names have neither."""
    days = {"today": 0, "last 7 days": 6, "last 30 days": 29}.get(name)
    return (None, None) if days is None else (str(today - timedelta(days=days)), str(today))


def get_prompt(df: DataFrame, row_id: int) -> DataFrame:
    return df.where(F.col("id") == row_id)


def list_prompts(df: DataFrame, page: int = 1, per_page: int = PAGE, status: str = "", search: str = "") -> DataFrame:
    """A page, newest first. A page below 1 is 1; a size outside 1 to MAX_PAGE is PAGE."""
    page, per_page = max(page, 1), per_page if 1 <= per_page <= MAX_PAGE else PAGE
    rows = search_filter(status_filter(df, status), search).orderBy(F.desc("ts"), F.desc("id"))
    return rows.offset((page - 1) * per_page).limit(per_page)


def count_prompts(df: DataFrame, status: str = "", search: str = "") -> DataFrame:
    return search_filter(status_filter(df, status), search).agg(F.count("*").alias("n"))


def audit_stats(df: DataFrame) -> DataFrame:
    """One row: total, a count for each status, and token sums. One pass."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return df.agg(
        F.count("*").alias("total"), *[is_(s).alias(s) for s in ("clean", "flagged", "redacted", "blocked", "telemetry")],
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def most_flagged_host(df: DataFrame) -> DataFrame:
    """The host with most rows that are neither clean nor telemetry; the first by name of equals."""
    rows = df.where(~F.col("status").isin("clean", "telemetry")).groupBy("host").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "host").limit(1)


def last_per_key(df: DataFrame, n: int = LAST) -> DataFrame:
    """The newest ``n`` rows with a duration of each client and model."""
    newest = Window.partitionBy("client", "model").orderBy(F.desc("ts"), F.desc("id"))
    rows = df.where((F.col("model") != "") & (F.col("duration_ms") > 0))
    return rows.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= n).drop("_k")


def model_latency(df: DataFrame, n: int = LAST) -> DataFrame:
    """p50, p95 and p99 (nearest rank, no interpolation) over the newest ``n`` rows of each client and model."""
    at = lambda q: F.get("d", F.least(F.floor(F.col("sample") * q), F.col("sample") - 1).cast("int"))
    rows = last_per_key(df, n).groupBy("client", "model").agg(F.array_sort(F.collect_list("duration_ms")).alias("d"), F.count("*").alias("sample"))
    return rows.select("client", "model", at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), "sample")


def latency_band(p95: Column) -> Column:
    return F.when(p95 > 10_000, "danger").when(p95 > 5_000, "warning").otherwise("ok")


def latency_pivot(df: DataFrame, clients: list[str]) -> DataFrame:
    """Models as rows, and p50, p95 and n of each client as columns."""
    cells = [F.first("p50").alias("p50"), F.first("p95").alias("p95"), F.first("sample").alias("n")]
    return model_latency(df).groupBy("model").pivot("client", clients).agg(*cells)


def context_limit(client: Column, limits: Mapping[str, int] | None = None) -> Column:
    """The limit of the first key (by name) that the client's name holds, else the default."""
    out = F.lit(DEFAULT_LIMIT)
    for key in sorted(limits or {}, reverse=True):
        out = F.when(F.contains(F.lower(client), F.lit(key.lower())), F.lit(limits[key])).otherwise(out)
    return out


def with_context_limit(df: DataFrame, limits: DataFrame, client_col: str = "client", out_col: str = "context_limit") -> DataFrame:
    """``df`` with the limit of the first key (by name) of ``limits`` (key, tokens) that the client's name holds, else the default.

    Case does not count. Each distinct client is cut into its pieces of the lengths that keys have, and these meet the
    keys by equality, so that neither table is gone through for each row of the other. Null keys and tokens count for
    nothing, of keys that differ in case only the first by name counts; a null client has the default.
    """
    lower, at = F.col("_lower"), F.col("_length")
    keys = limits.where("key IS NOT NULL AND tokens IS NOT NULL").select("key", F.lower("key").alias("_piece"), F.col("tokens").cast("long").alias("_tokens"))
    lengths = keys.agg(F.sort_array(F.collect_set(F.length("_piece"))).alias("_lengths"))  # one row, of as many numbers as the longest key has letters
    clients = df.select(F.col(client_col).alias("_client")).where("_client IS NOT NULL").distinct().withColumn("_lower", F.lower("_client"))
    cut = clients.join(F.broadcast(lengths)).select("_client", "_lower", F.explode("_lengths").alias("_length")).where(F.length(lower) >= at)
    starts = F.sequence(F.lit(1), F.length(lower) - at + 1)
    cut = cut.select("_client", F.explode(F.array_distinct(F.transform(starts, lambda k: F.substring(lower, k, at)))).alias("_piece"))
    found = cut.join(keys, "_piece").groupBy("_client").agg(F.min(F.struct("key", "_tokens"))["_tokens"].alias("_tokens"))
    rows = df.join(found, F.col(client_col) == F.col("_client"), "left")
    return rows.withColumn(out_col, F.coalesce("_tokens", F.lit(DEFAULT_LIMIT).cast("long"))).drop("_client", "_tokens")


def context_use(tokens: Column, limit: Column) -> Column:
    """Percent of the context that is used, rounded half up, at most 100; null without tokens."""
    return F.when(tokens > 0, F.least(F.floor(tokens / limit * 100 + 0.5), F.lit(100)).cast("int"))


def context_band(percent: Column) -> Column:
    return F.when(percent >= 90, "red").when(percent >= 75, "amber").when(percent.isNotNull(), "green")


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def mask_path(path: Column) -> Column:
    return F.regexp_replace(path, r"/[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "/…")


def short_session(session: Column) -> Column:
    return F.substring(session, 1, 8)


def export_lines(df: DataFrame, text_col: str = "safe_text") -> DataFrame:
    """Rows (n, line) of an export in time order: ``[n] time | host | status`` and the text.

    A row's number is its place within its minute and the rows of all minutes before: rows are counted by minute and
    day, so no task numbers more than a minute's rows, and the running sums see minutes and days only.
    """
    minute = F.date_trunc("minute", "ts")
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    minutes = df.groupBy(minute.alias("_minute")).agg(F.count("*").alias("_n")).withColumn("_day", F.to_date("_minute"))
    days = minutes.groupBy("_day").agg(F.sum("_n").alias("_n")).select("_day", earlier(Window.orderBy("_day")).alias("_before_day"))
    minutes = minutes.withColumn("_before", earlier(Window.partitionBy("_day").orderBy("_minute"))).join(days, "_day")
    minutes = minutes.select("_minute", (F.col("_before") + F.col("_before_day")).alias("_before"))
    rows = df.withColumn("_m", minute).join(minutes, F.col("_m") == F.col("_minute"))
    n = F.row_number().over(Window.partitionBy("_minute").orderBy("ts", "id")) + F.col("_before")
    head = F.format_string("[%d] %s | %s | %s\n%s", n, F.date_format("ts", "yyyy-MM-dd HH:mm"), F.col("host"), F.col("status"), F.col(text_col))
    return rows.select(n.alias("n"), head.alias("line"))


def export_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "blocked").alias("blocked"), F.count_if(F.col("status") == "redacted").alias("redacted"))


def export_header(df: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The line (n = 0, line) that comes before an export of these rows: the range of days and the counts."""
    counts = F.format_string(
        "Days: %s to %s\nPrompts: %d, of which %d blocked and %d redacted\n", F.lit(first or "the first"), F.lit(last or "the last"), F.col("total"), F.col("blocked"), F.col("redacted")
    )
    return export_counts(df).select(F.lit(0).cast("long").alias("n"), counts.alias("line"))


def with_current(df: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, ...) with now: whether a turn comes after the last assistant one, or there
    is none. The last one is an aggregate with map-side combine, joined back, so no task holds a conversation's texts."""
    last = df.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("_last"))
    rows = df.join(last, "conv_id", "left")
    return rows.withColumn("now", F.coalesce(F.col("turn") > F.col("_last"), F.lit(True))).drop("_last")


def latest_turns(df: DataFrame) -> DataFrame:
    """Conversation rows of the current turn: after the last assistant one, or all without one."""
    return with_current(df).where("now").drop("now")
