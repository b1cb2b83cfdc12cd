"""Reading and writing requests, responses and the audit log."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hushlake.operators import requests
from hushlake.operators.verdict import CAP

REQUESTS = "request_id string, ts timestamp, host string, path string, headers map<string, string>, body string"
RESPONSES = "request_id string, response_ts timestamp, duration_ms long, response string"
AUDIT = [
    "request_id", "ts", "host", "path", "prompt", "redacted_prompt", "safe_text", "status", "matches", "duration_ms", "agent_mode", "input_tokens", "output_tokens",
    "session_id", "client", "model", "llm_response", "raw_body", "unread",
]


def read_requests(spark: SparkSession, path: str, stream: bool = False, kind: str = "json") -> DataFrame:
    """The request log (json or parquet files), as a batch or as a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(REQUESTS).format(kind).load(path)


def read_responses(spark: SparkSession, path: str, stream: bool = False, kind: str = "json") -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(RESPONSES).format(kind).load(path)


def read_lines(spark: SparkSession, path: str, schema: str = REQUESTS, stream: bool = False) -> DataFrame:
    """A log of JSON lines with its columns, file and bad_line: the line where it is no JSON object or a value has another type,
    else null. Blank lines are no lines. See split_lines."""
    reader = spark.readStream if stream else spark.read
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
    read = F.from_json("value", f"{schema}, bad_line string", {"columnNameOfCorruptRecord": "bad_line", "mode": "PERMISSIVE"})
    rows = lines.select("file", "value", F.explode(F.array(read)).alias("r")).select("file", "value", "r.*")
    whole = F.startswith(F.ltrim("value"), F.lit("{"))
    return rows.withColumn("bad_line", F.when(whole, F.col("bad_line")).otherwise(F.col("value"))).drop("value")


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that could be read, and (file, bad_line) of the others, to be stored and counted; no line is in both or neither."""
    return lines.where("bad_line IS NULL").drop("file", "bad_line"), lines.where("bad_line IS NOT NULL").select("file", "bad_line")


def with_day(df: DataFrame) -> DataFrame:
    """Seconds are the log's resolution, days its partitions."""
    return df.withColumn("ts", F.date_trunc("second", "ts")).withColumn("dt", F.to_date("ts"))


def write_audit(df: DataFrame, path: str) -> None:
    """Append; one folder for each day, so that a range of days reads only its own. In a day's folder, each batch of a stream has its own (see audit_sink)."""
    with_day(df).withColumn("batch", F.lit("appended")).write.mode("append").partitionBy("dt", "batch").parquet(path)


def audit_sink(path: str, name: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that writes each row once: a batch that is given again replaces what it wrote before.

    ``name`` tells the streams of one log apart and stays the same when a stream is started again from its checkpoint. Batches are numbered by the
    checkpoint, which gives a batch the same rows each time, so the folders of its days are the same too.
    """

    def write(df: DataFrame, number: int) -> None:
        rows = with_day(df).withColumn("batch", F.lit(f"stream-{name}-{number}"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch").parquet(path)

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def merge_responses(spark: SparkSession, path: str, responses: DataFrame, since: str | None = None) -> list[str]:
    """Give stored rows the responses that came after they were written; returns the days that were rewritten.

    Of several responses to a request the newest counts, and it replaces what is stored. Only days with a row that changes are rewritten, so the same
    responses given again change nothing; ``since`` keeps the search for them to later days. The new days are written beside the log first and then take
    the old ones' place. If that is cut short, the next call completes it before anything else. One merge or writer at a time.
    Responses to unknown requests, and those without an id, change nothing.
    """
    staged = f"{path}/_merged"
    if _exists(spark, f"{staged}/_SUCCESS"):
        _swap(spark, path)
    log = spark.read.parquet(path)
    log = log if since is None else log.where(F.col("dt") >= F.lit(since).cast("date"))
    newest = responses.groupBy("request_id").agg(F.max(F.struct("response_ts", "duration_ms", "response")).alias("r")).select("request_id", "r.*")
    u = requests.usage(F.col("response"))
    given = {
        "duration_ms": F.coalesce("duration_ms", F.lit(0)), "input_tokens": F.coalesce(u.input_tokens, F.lit(0)), "output_tokens": F.coalesce(u.output_tokens, F.lit(0)),
        "llm_response": F.substring(requests.response_text(F.col("response")), 1, CAP),
    }
    new = newest.select("request_id", F.struct(*[c.alias(k) for k, c in given.items()]).alias("_new"))

    joined = log.join(new, "request_id", "left")
    kept = {k: F.col(f"_new.{k}") for k in given} | {"llm_response": F.when(F.col("status") == "redacted", F.col("_new.llm_response")).otherwise("")}
    after = {k: F.when(F.col("_new").isNotNull(), c).otherwise(F.col(k)).cast(log.schema[k].dataType) for k, c in kept.items()}
    differs = F.lit(False)
    for k, c in after.items():
        differs = differs | ~c.eqNullSafe(F.col(k))
    days = sorted(str(r.dt) for r in joined.where(differs).select("dt").distinct().collect() if r.dt is not None)
    if days:
        touched = joined.where(F.col("dt").isin([F.lit(d).cast("date") for d in days]))
        touched.withColumns(after).select(log.columns).write.mode("overwrite").partitionBy("dt", "batch").parquet(staged)
        _swap(spark, path)
    return days


def _swap(spark: SparkSession, path: str) -> None:
    """Put the finished days of a merge in the place of the old ones. It may be done again at any point."""
    staged = spark.read.parquet(f"{path}/_merged")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch").parquet(path)
    _remove(spark, f"{path}/_merged")


def stream_audit(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = with_day(df).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("dt").outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_audit(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path).drop("batch")
    return df.select(*columns) if columns else df


def purge_audit(spark: SparkSession, path: str, day: str | None = None) -> None:
    """Delete the log, or one day of it. The log must be this function's to delete: the path is removed."""
    _remove(spark, f"{path}/dt={day}" if day else path)


def export_text(lines: DataFrame, path: str, header: DataFrame | None = None) -> None:
    """Write export lines (n, line) in order as text files, after the header (see export_header): ranges of n are sorted apart."""
    lines = lines if header is None else header.unionByName(lines)
    lines.repartitionByRange("n").sortWithinPartitions("n").select("line").write.mode("overwrite").text(path)
