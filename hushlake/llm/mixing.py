"""Operator 1: mix sources to target weights by Pareto order sampling, with DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushlake.llm.common import join_small, written

#: Runs of anything but these six ASCII white-space characters are words.
WORD = r"[^\x20\x09-\x0D]+"


def ranked(df: DataFrame, order) -> DataFrame:
    """``df`` with ``rank`` (from 0) in the given order. Sampled ranges are sorted apart; only the number of rows of each
    range is summed over the ranges, so no task sees all rows."""
    mid = F.col("_mid")
    rows = written(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(mid, 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = rows.join(F.broadcast(parts), part == F.col("_part"))  # a row for each range of the sort
    return joined.withColumn("rank", F.col("_before") + mid.bitwiseAND((1 << 33) - 1)).drop("_mid", "_part", "_before")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size), one row each, with ``target``.

    Sources in order (code points, null last) weigh ``weights`` in turn and share ``share`` times all sizes; a target
    stops at ``most`` times its source's size and what is over goes to the others by weight, until none is above.
    The state of that loop is two sums; a source once full stays full.
    """
    rows = ranked(sizes, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = written(rows.select("source", "source_size", weight.alias("weight")))
    full = F.col("source_size") * most
    total, all_weights = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(share), F.sum("weight")).first()
    level = total / all_weights if all_weights else 0.0
    while True:
        at = full <= level * F.col("weight")
        taken, open_weight = rows.agg(F.sum(F.when(at, full).otherwise(0.0)), F.sum(F.when(at, 0.0).otherwise(F.col("weight")))).first()
        now = (total - taken) / open_weight if open_weight else level
        if now <= level:
            break
        level = now
    return rows.select("source", "source_size", F.least(full, level * F.col("weight")).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    odds_col: str | None = None,
    buckets: int = 4096,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, inclusion, copies, taken.

    A source whose target is f times its size gives every document floor(f) certain whole copies. What is left of the
    target is a Pareto order sample: a document of inclusion probability p and uniform draw u ranks by
    (u / (1 - u)) / (p / (1 - p)), and the lowest ranks are taken until their words fill the rest. The draw is a hash
    of ``seed`` and doc_id, so reruns agree. p is the fractional part of f; ``odds_col`` (positive, null as 1) multiplies
    a document's inclusion odds where documents of one source shall differ. The document at the border is taken if that
    brings the source nearer to its target, so a source misses it by at most half of that document.

    Order is found without sorting a source in one place: words are summed by source and bucket of the rank (map-side
    combined), a running sum over at most ``buckets`` rows a source finds the bucket that holds the border, and only that
    bucket's rows, about one in ``buckets``, are put in order.

    Null text has size 0; null sources form one source; rows of size 0 take 0 words. Repeated rows are each drawn with
    the same number and ordered one after another. Empty input gives no rows. Further columns are left out.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10)
    odds = F.greatest(F.coalesce(F.col(odds_col).cast("double"), F.lit(1.0)), F.lit(1e-9)) if odds_col else F.lit(1.0)
    rows = written(docs.select("doc_id", "source", size.alias("size"), (draw.cast("double") / float(2**52)).alias("u"), odds.alias("odds")))

    by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    by_source = by_source.withColumn("certain", F.floor(factor)).withColumn("part", factor - F.col("certain"))
    by_source = written(by_source.withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size")).withColumnRenamed("source", "_source"))
    n_sources = by_source.count()

    same = F.col("source").eqNullSafe(F.col("_source"))
    rows = join_small(rows, by_source, n_sources, same).drop("_source")
    inclusion_odds = F.col("part") / (1 - F.col("part")) * F.col("odds")
    rows = rows.withColumn("inclusion", F.when(F.col("part") > 0, inclusion_odds / (1 + inclusion_odds)).otherwise(0.0))
    rank = F.when(F.col("part") > 0, F.col("u") / (1 - F.col("u")) / inclusion_odds)
    rows = rows.withColumn("rank", rank).withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * buckets))

    sums = rows.where("part > 0").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("upto", upto).where(F.col("upto") >= F.col("rest"))
    border = sums.groupBy(F.col("source").alias("_source")).agg(
        F.min("bucket").alias("border"), F.min_by(F.col("upto") - F.col("words"), "bucket").alias("before")
    )
    rows = join_small(rows, written(border), n_sources, same).drop("_source")

    at = F.coalesce(F.col("bucket") == F.col("border"), F.lit(False))
    sure = rows.where(~at).withColumn("extra", F.coalesce(F.col("bucket") < F.coalesce("border", F.lit(buckets + 1)), F.lit(False)))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(order) - F.col("size") / 2
    edge = rows.where(at).withColumn("extra", middle <= F.col("rest"))
    copies = (F.col("certain") + F.col("extra").cast("long")).cast("long")
    out = sure.unionByName(edge).withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "inclusion", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same draw and rule in SQL. With sources sorted by size per weight, the level is the highest that filling a first few leaves.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST(('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         ([3.0, 1.0, 2.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         coalesce(sum(source_size * 2.0::DOUBLE) OVER w, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT max((total - filled) / open_weight) AS level FROM c
), t AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, level * weight) AS target FROM s, l
), f AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS certain,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS part
  FROM t
), r AS (
  SELECT d.doc_id, d.size, f.source_size, f.target, f.certain, f.part, f.target - f.certain * f.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY CASE WHEN part > 0 THEN u / (1 - u) / (part / (1 - part)) END, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((certain + CASE WHEN part > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""
