"""Blocks of rows that share a bucket, so that pairs are compared inside tasks and never written out one by one.

Rows fall into buckets of several tables (a band of MinHash values, a set of hyperplane signs). A bucket is cut into blocks of a bounded
size, and a unit is one block or two blocks of one bucket: whoever holds a unit's rows can compare them. A bucket of m
rows makes about m * m / (2 * block) unit rows instead of m * m / 2 pairs, and no unit grows with the bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.llm.common import join_sorted, written

#: Rows of a block; a unit has at most about twice as many.
BLOCK = 1024

#: The columns that name a unit, and the block of a row in it. A bucket's number tells its table, too.
UNIT = ["bucket", "i", "j"]
UNIT_SCHEMA = "table int, bucket long, i int, j int, block int"


def units(members: DataFrame, block: int = BLOCK, weights: DataFrame | None = None, weight_limit: int | None = None) -> DataFrame:
    """Rows (id, table, bucket, i, j, block) from ``members`` (id, table, bucket), a row for each unit of an id.

    Buckets of different tables have different numbers. Buckets of one row are left out first, so that most rows move
    only twice, with nothing but these columns. Of buckets with the same rows only the one of the first table remains: the
    first table in which two rows meet always keeps its bucket. A block holds about ``block`` rows, fewer where the sum of
    ``weights`` (id, weight) would pass ``weight_limit``. All steps on a bucket are aggregates with map-side combine, or
    sort-merge joins whose hot partitions adaptive execution can split.
    """
    ids = F.col("id")
    shared = members.groupBy("bucket").count().where("count > 1").select("bucket")
    rows = written(join_sorted(members.select("id", "table", "bucket"), shared, "bucket"))
    weighed = join_sorted(rows, weights, "id") if weights is not None and weight_limit else rows.withColumn("weight", F.lit(0).cast("long"))
    buckets = weighed.groupBy("bucket").agg(
        F.min("table").alias("table"), F.count("*").alias("n"), F.sum("weight").alias("w"), F.bit_xor(F.xxhash64(ids)).alias("x"), F.bit_xor(F.xxhash64(ids, F.lit(1))).alias("y")
    )
    kept = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("table", "bucket", "w")).alias("b"))
    blocks = F.ceil(F.col("n") / block)
    if weight_limit:
        blocks = F.greatest(blocks, F.least(F.ceil(F.col("b.w") / weight_limit), F.col("n")))
    kept = kept.select("b.bucket", blocks.cast("int").alias("blocks"))
    placed = join_sorted(rows, kept, "bucket")
    own = F.pmod(F.xxhash64(ids, F.lit(2)), F.col("blocks")).cast("int")
    placed = placed.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select("id", "table", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
