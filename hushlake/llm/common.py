"""What several operators share: tables written to shared storage, sizes checked before a broadcast, links to classes."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when it is known to have at most this many rows.
BROADCAST_ROWS = 100_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is spark.checkpoint.dir where the session has it, or the checkpoint folder that has been set. A temporary folder
    is made only where all tasks run in the driver's process (a ``local`` master, as in tests); elsewhere executors would
    not see it, and the missing setting is an error.
    """
    shared, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not sc.getCheckpointDir():
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return shared or sc.getCheckpointDir()


#: For each thread, the lists of tables of the blocks of scratch_of that are open, the innermost last.
_noted = threading.local()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and outlives lost executors.

    Tables stay under ``<shared folder>/<application id>`` until the caller removes that folder, or discards those noted.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if lists := getattr(_noted, "lists", None):
        lists[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_of() -> Iterator[list[str]]:
    """The tables that this thread writes within the block; checkpoints are not among them."""
    lists = _noted.__dict__.setdefault("lists", [])
    lists.append([])
    try:
        yield lists[-1]
    finally:
        lists.pop()


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete such tables, once nothing reads them any more."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_small(rows: DataFrame, small: DataFrame, n_small: int, on: Column) -> DataFrame:
    """Left join with a table of ``n_small`` rows (already counted): broadcast up to BROADCAST_ROWS, else left to
    Spark's sort-merge join, whose skewed partitions adaptive execution splits."""
    return rows.join(F.broadcast(small) if n_small <= BROADCAST_ROWS else small, on, "left")


def join_sorted(rows: DataFrame, other: DataFrame, on: str, how: str = "inner", n_most: int | None = None) -> DataFrame:
    """Join by sort-merge, for tables whose number of rows grows with the input; left to Spark where they are known to have ``n_most`` rows
    at most and that is no more than BROADCAST_ROWS.

    Spark guesses the size of a table by its files: one that an explode makes 150 times longer, or that is stored well
    compressed, looks small enough for a broadcast, which adaptive execution does not take back, and the driver then holds all of it.
    """
    return rows.join(other if n_most is not None and n_most <= BROADCAST_ROWS else other.hint("merge"), on, how)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


T = TypeVar("T")
_kept: list[tuple[Hashable, object]] = []


def kept(key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` gives, kept from task to task by a Python worker as long as no task asks for another key.

    A worker outlives stages: were each operator to keep its own memory of words, a job of many stages would hold all of
    them at once.
    """
    if not _kept or _kept[0][0] != key:
        _kept.clear()  # before the next one is made
        _kept.append((key, make()))
    return _kept[0][1]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of adjacent rows with equal (non-null) keys, across batch borders, from rows sorted by the keys."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            change[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        if held and any(held[-1].column(k)[-1] != table.column(k)[0] for k in keys):
            yield pa.concat_tables(held).combine_chunks()
            held = []
        for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
            held.append(table.slice(a, b - a))
            if b < table.num_rows:
                yield pa.concat_tables(held).combine_chunks()
                held = []
    if held:
        yield pa.concat_tables(held).combine_chunks()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component): each node that has a link, with the smallest node reachable from it.

    Large-star and small-star steps alternate until nothing changes. Each step is an aggregate with map-side combine
    and a join on the same key, so a hub costs no more than its own links. Rows that
    are doubled, reversed, null or loops change nothing; no links give no rows.
    """
    scratch_dir(links.sparkSession)  # for checkpoint()
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(u != v).distinct().checkpoint()
    most = 2 * edges.count()  # of nodes, and of rows of a side of the joins
    state = None
    while True:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(u, F.min("v")).alias("m"))
        large = join_sorted(both.where(v > u), least, "u", n_most=most).select(v.alias("u"), m.alias("v")).where(u != v).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_sorted(large, least, "u", n_most=most).where(v != m).select(v.alias("u"), m.alias("v"))
        edges = small.unionByName(least.select("u", m.alias("v"))).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(v.alias("node"), v.alias("component")).distinct()
    return edges.select(u.alias("node"), v.alias("component")).unionByName(roots)
