"""Operator 2: exact duplicates by content sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushlake.llm.common import join_small, written

#: Leading bytes of a text that take part in the sampled splitters. With the digest they tell texts apart, and the sample
#: that Spark sends to the driver stays small however long the texts are.
HEAD = 64

#: Marks of a row: its run of equal texts touches the first row of its partition, the last one, or both.
FIRST, LAST = 1, 2


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("id"), batch.column("text").to_pylist()
        norm = [t.lower() for t in texts]  # bytes.lower() changes A-Z only
        sha = [hashlib.sha256(t).hexdigest() for t in norm]
        head = pa.array([t[:HEAD] for t in norm], pa.binary())
        yield pa.RecordBatch.from_arrays([ids, pa.array(norm, pa.binary()), head, pa.array(sha)], ["id", "norm", "head", "sha"])


def _labelled():
    """Runs of equal neighbours of one sorted partition; the row that stays comes first in a run."""

    schema = pa.schema({"id": pa.int64(), "sha": pa.string(), "part": pa.int64(), "keep": pa.int64(), "size": pa.int64(), "edge": pa.int32(), "text": pa.binary()})

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.Array] = []  # ids of the run that is still open; its text is in `last`
        last = sha = None
        first_run = True

        def rows(closing: bool) -> pa.RecordBatch:
            ids = pa.concat_arrays(held)
            n = len(ids)
            edge = FIRST * first_run + LAST * closing
            text = pa.array([last] + [None] * (n - 1) if edge else [None] * n, pa.binary())
            fill = lambda x, kind: pa.array(np.full(n, x), kind)
            keep = pa.array([ids[0].as_py()] * n, pa.int64())
            columns = [ids, pa.array([sha] * n), fill(part, pa.int64()), keep, fill(n, pa.int64()), fill(edge, pa.int32()), text]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            norm, ids, shas = batch.column("norm"), batch.column("id"), batch.column("sha")
            new = np.ones(len(norm), bool)
            new[1:] = ~pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)  # whole texts are compared
            new[0] = last is None or norm[0].as_py() != last
            starts = np.flatnonzero(new)
            bounds = [*starts.tolist(), len(norm)]
            if bounds[0]:
                held.append(ids[: bounds[0]])
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if held:
                    yield rows(False)
                    first_run = False
                held, last, sha = [ids[a:b]], norm[a].as_py(), shas[a].as_py()
        if held:
            yield rows(True)

    return label, "id long, sha string, part long, keep long, size long, edge int, text binary"


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z. Rows are range-partitioned by sampled splitters over
    (first bytes of the normalised text, its digest, id) and sorted by these and the whole text, so equal texts are
    adjacent, and neighbours are compared in full. As the id takes part, many copies of one text spread over several
    partitions; a run that goes over a border is joined with the next partition's by comparing the texts at the border,
    each border apart. The smallest id of a group stays, or the largest with ``keep='largest'``.

    A null text counts as empty; all empty texts form one group. Rows that repeat an id count apart in group_size, and
    each of them is kept if that id stays. A null id sorts behind all others and stays only if its group has no other.
    Empty input gives no rows; further columns are left out.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    ids = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = raw.mapInArrow(_normalised, "id long, norm binary, head binary, sha string")
    rows = rows.repartitionByRange("head", "sha", ids).sortWithinPartitions("head", "sha", "norm", ids)
    label, schema = _labelled()
    rows = written(rows.mapInArrow(label, schema))

    edges = rows.where("text IS NOT NULL")
    touches = lambda mark: edges.where(F.col("edge").bitwiseAND(mark) > 0)
    run = F.struct("keep", "size", "edge")
    firsts = touches(FIRST).select("part", F.col("text").alias("text"), F.col("sha").alias("sha"), run.alias("first"))
    lasts = touches(LAST).select("part", F.col("text").alias("last_text"), F.col("sha").alias("last_sha"), run.alias("last"))
    # Texts at a border meet by a join on the border; what is put in order has a few numbers for each partition.
    parts = firsts.select("part", F.lag("part").over(Window.orderBy("part")).alias("before"))
    borders = firsts.drop("first").join(parts.where("before IS NOT NULL"), "part").join(lasts.select(F.col("part").alias("before"), "last_text", "last_sha"), "before")
    joined = borders.where((F.col("sha") == F.col("last_sha")) & (F.col("text") == F.col("last_text"))).select("part", F.lit(True).alias("joined"))
    chains = firsts.select("part", "first").join(lasts.select("part", "last"), "part").join(joined, "part", "left").withColumn("joined", F.coalesce("joined", F.lit(False)))
    # A run that covers its whole partition may go on to the one after it.
    ends = F.inline(F.array(F.struct(F.lit(0).alias("at"), F.col("first").alias("run")), F.struct(F.lit(1).alias("at"), F.col("last").alias("run"))))
    # The runs at both borders in order: a first run continues the chain before it, a last run of its own opens one.
    seq = chains.select("part", "joined", ends).where("at = 0 OR run.edge != 3")
    opens = ~F.col("joined") | (F.col("at") == 1)
    at = Window.orderBy("part", "at")
    seq = seq.withColumn("chain", F.sum(opens.cast("long")).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("chain")
    total = written(seq.select(
        F.col("part").alias("_part"), F.col("run.edge").alias("_edge"),
        F.first("run.keep").over(chain.orderBy("part", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_keep"),
        F.sum("run.size").over(chain).alias("_size"),
    ))
    out = join_small(rows.drop("text"), total, total.count(), (F.col("part") == F.col("_part")) & (F.col("edge") == F.col("_edge")))
    kept_id = F.when(F.col("_part").isNull(), F.col("keep")).otherwise(F.col("_keep"))
    return out.select(
        F.col("id").alias(id_col), kept_id.alias("keep_id"), F.coalesce("_size", "size").alias("group_size"),
        F.col("id").eqNullSafe(kept_id).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_duplicates(docs, keep="largest")


OP2_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
