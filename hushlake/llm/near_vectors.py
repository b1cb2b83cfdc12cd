"""Operator 7: near-duplicate vectors by random-hyperplane signs, exact cosines and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm.blocks import UNIT, units
from hushlake.llm.common import connected_components, join_sorted, runs, written
from hushlake.llm.jaccard import _spanning

#: The chance that a pair of exactly the threshold shares no bucket.
MISS = 1e-6


def table_sizes(rows: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(tables, bits) for at most ``rows`` vectors of a label.

    Bits follow the number of rows, so that a vector meets about one unrelated one in 50 in a table however many there
    are; a pair of cosine c agrees in a sign with probability 1 - acos(c) / pi, and as many tables are used as make the chance to miss it ``miss``.
    """
    bits = min(62, max(8, int(np.ceil(np.log2(max(rows, 1) * 50)))))
    agree = (1 - np.arccos(min(threshold, 1 - 1e-9)) / np.pi) ** bits
    return int(np.ceil(np.log(miss) / np.log1p(-agree))), bits


@lru_cache(maxsize=8)
def planes(dims: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dims)).standard_normal((dims, tables * bits))


def sign_keys(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """One key for each table: the signs of the vector against the table's planes."""
    out = np.empty((len(vectors), tables), np.int64)
    for lo in range(0, len(vectors), 1024):
        signs = (vectors[lo : lo + 1024] @ planes(vectors.shape[1], tables, bits, seed) >= 0).reshape(-1, tables, bits)
        out[lo : lo + 1024] = signs @ (1 << np.arange(bits, dtype=np.int64))
    return out


def near_vectors(
    rows: DataFrame,
    threshold: float = 0.93,
    miss: float = MISS,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
) -> DataFrame:
    """One row per row of ``rows`` with an id: id_col, n_links, component_id, kept.

    Vectors of equal, non-null labels (of all rows, without ``label_col``) and equal lengths are linked when their
    cosine in double precision is ``threshold`` or more and they fall into one bucket of a table; ``miss`` bounds the
    chance that a pair of exactly that cosine falls into none. Equal vectors of a label form one entry that carries their number. Pairs are compared inside units of bounded size
    (see blocks.py), each pair in the first table that it shares, and a unit returns counts of links and links to one entry for each connected part.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with
    nothing, copies of their own included, and are components of their own. Rows that repeat an id are vectors of their own and come back
    once each. Rows with a null id are left out; empty input gives no rows; further columns are ignored.
    """
    vector = F.col("vector")
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    base = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    base = base.withColumn("key", F.when(usable, F.sha2(F.to_json(F.struct("label", F.transform(vector, lambda x: x + 0.0).alias("v"))), 256)))
    entries = base.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    entries = written(entries.withColumn("entry", F.monotonically_increasing_id()))

    most = entries.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables, bits = table_sizes(most, threshold, miss)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            lengths = np.diff(vectors.offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                data = part.column("vector").flatten().to_numpy().reshape(-1, d)
                keys = sign_keys(data / np.abs(data).max(axis=1, keepdims=True), tables, bits, seed)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), keys.ravel())
                yield pa.RecordBatch.from_arrays([part.column("entry"), part.column("label"), pa.array(np.full(len(data), d, np.int32)), lists], ["id", "label", "dims", "keys"])

    keyed = entries.select("entry", "label", "vector").mapInArrow(signed, "id long, label string, dims int, keys array<long>")
    members = keyed.select("id", "label", "dims", F.posexplode("keys").alias("table", "signs"))
    members = members.select("id", "table", F.xxhash64("label", "dims", "table", "signs").alias("bucket"))
    vectors = entries.select(F.col("entry").alias("id"), "copies", F.xxhash64("label").alias("label_no"), "vector")
    placed = join_sorted(units(members), vectors, "id")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, UNIT):
            lists = unit.column("vector").chunk(0)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            table, i, j = (unit.column(c)[0].as_py() for c in ("table", "i", "j"))
            labels = unit.column("label_no").to_numpy()
            block = unit.column("block").to_numpy()
            dims = np.diff(offsets)
            found_a, found_b = [], []
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                data = values[offsets[at][:, None] + np.arange(d)]
                data = data / np.abs(data).max(axis=1, keepdims=True)
                unit_length = data / np.sqrt((data * data).sum(axis=1, keepdims=True))
                left = np.flatnonzero(block[at] == i)
                right = left if i == j else np.flatnonzero(block[at] == j)
                a, b = np.nonzero(unit_length[left] @ unit_length[right].T >= threshold)
                a, b = left[a], right[b]
                same = labels[at[a]] == labels[at[b]]
                if i == j:
                    same &= a < b
                a, b = a[same], b[same]
                if len(a):
                    used, where = np.unique(np.concatenate([a, b]), return_inverse=True)
                    keys = sign_keys(data[used], tables, bits, seed)
                    wa, wb = where[: len(a)], where[len(a) :]
                    first = np.concatenate([(keys[wa[k : k + 4096]] == keys[wb[k : k + 4096]]).argmax(axis=1) == table for k in range(0, len(a), 4096)])
                    a, b = a[first], b[first]
                found_a.append(at[a])
                found_b.append(at[b])
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            if not len(a):
                continue
            copies, ids = unit.column("copies").to_numpy(), unit.column("id").to_numpy()
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            to = ids[_spanning(len(ids), a, b)]
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(to[at]), pa.array(links[at])], ["id", "to", "links"])

    linked = placed.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(compared, "id long, to long, links long")
    linked = written(linked)
    parts = connected_components(linked, "id", "to").select(F.col("node").alias("entry"), "component")
    light = entries.select("entry", "key", "id", "copies")
    classes = written(join_sorted(light, parts, "entry"))
    lowest = classes.groupBy("component").agg(F.min("id").alias("lowest"))
    classes = join_sorted(classes, lowest, "component", n_most=2 * linked.count()).select("entry", "lowest")
    links = linked.groupBy(F.col("id").alias("entry")).agg(F.sum("links").alias("links"))
    known = join_sorted(join_sorted(light, links, "entry", "left"), classes, "entry", "left")
    known = known.select("key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("lowest", "id").alias("lowest"))
    out = join_sorted(base.select("id", "key"), known, "key", "left")
    component = F.coalesce("lowest", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("id") == component).alias("kept"),
    )


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
