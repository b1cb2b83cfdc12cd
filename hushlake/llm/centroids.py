"""Operator 11: k-means with exact integer distances by bit-plane popcounts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm.common import written

#: Components of a vector: one plane holds a bit of each in one unsigned 64-bit number.
DIMS = 64
#: Integer components lie below this in magnitude, so that a squared distance of 64 of them is a long.
LIMIT = 1 << 27
#: Rows whose bits are unpacked, or compared with all centroids, at a time.
ROWS = 4096
LARGEST = (1 << 63) - 1


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits) numbers: number b of a row holds bit b of its 64 two's-complement components."""
    out = np.empty((len(values), bits), np.uint64)
    for b in range(bits):
        out[:, b] = np.packbits(((values >> b) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def components(packed: np.ndarray) -> np.ndarray:
    """The (n, 64) components of rows of planes; the last plane is the sign's."""
    n, bits = packed.shape
    unpacked = np.unpackbits(np.ascontiguousarray(packed, "<u8").view(np.uint8).reshape(n, bits, 8), axis=2, bitorder="little")
    return np.tensordot(unpacked.astype(np.int64), weights(bits), axes=(1, 0))


def weights(bits: int) -> np.ndarray:
    """What a bit of each plane counts: powers of two, the sign's plane negative."""
    w = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) exact dot products of rows of planes: the bits that two planes share, counted and weighted."""
    wa, wb = weights(a.shape[1]), weights(b.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            out += np.bitwise_count(a[:, i, None] & b[None, :, j]).astype(np.int64) * (wa[i] * wb[j])
    return out


def norms(a: np.ndarray) -> np.ndarray:
    """Squared lengths of rows of planes."""
    w = weights(a.shape[1])
    shared = np.bitwise_count(a[:, :, None] & a[:, None, :]).astype(np.int64)
    return (shared * (w[:, None] * w[None, :])).sum(axis=(1, 2))


def nearest(packed: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance to it) for each row; of equally near ones the smaller number."""
    numbers, distances = np.empty(len(packed), np.int32), np.empty(len(packed), np.int64)
    lengths = norms(centroids)
    for at in range(0, len(packed), ROWS):
        part = packed[at : at + ROWS]
        far = norms(part)[:, None] + lengths[None, :] - 2 * dots(part, centroids)
        best = far.argmin(axis=1)
        numbers[at : at + ROWS], distances[at : at + ROWS] = best, far[np.arange(len(part)), best]
    return numbers, distances


def _planes_of(batch: pa.RecordBatch, bits: int) -> np.ndarray:
    lists = batch.column("planes")
    return lists.flatten().to_numpy().view(np.uint64).reshape(len(lists), bits)


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2
) -> DataFrame:
    """One row per kept vector: id_col, cluster int, distance long (squared, in scaled integers), cluster_inertia, inertia,
    centroid_sha256.

    A component x becomes the integer floor(scale * x). The integers' bits lie in as many planes of one 64-bit number each as
    the largest of all takes, which are written once (80 bytes a vector where the integers have 10 bits); every round reads
    them, and a task sends no more than ``k`` rows of sums on. Dot products are weighted counts of the bits that planes of vector and centroid share, so
    all results are exact and no order of rows or tasks changes them. Only the centroids (k rows) reach the driver. Rounds end early when no
    centroid moves, as further ones would change nothing.

    Left out are vectors that are null, have other than 64 components, or hold one that is null, not finite or 2^27 or more as a scaled
    integer, whose distances need not be longs. Rows that repeat an id are vectors of their own; which of them is a first centroid is settled by their
    components. Rows with a null id come last among the first centroids. Fewer kept vectors than ``k`` give fewer centroids, none give no
    rows. Equal centroids all stay; the one with the smallest number gets the vectors. A sum of distances past the largest long is given as that. Further columns are ignored.
    """
    vector = F.col(vector_col).cast("array<double>")
    usable = (F.size(vector) == DIMS) & F.forall(vector, lambda x: F.coalesce(F.abs(F.floor(x * scale).cast("double")) < LIMIT, F.lit(False)) & ~F.isnan(x) & (F.abs(x) < LIMIT))
    kept = rows.where(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x * scale).cast("int")).alias("v")
    )
    spark = rows.sparkSession
    bound = kept.agg(F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    if bound[0] is None:
        return kept.select(
            F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")
        )
    bits = max(bound[0], -1 - bound[1]).bit_length() + 1
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = [list(r.v) for r in first]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            values = planes(lists.flatten().to_numpy().reshape(len(lists), DIMS), bits).view(np.int64)
            offsets = np.arange(0, values.size + 1, bits, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, values.ravel())], ["id", "planes"])

    table = written(kept.mapInArrow(packed, "id long, planes array<long>"))

    def sums(centres: np.ndarray):
        """A function for tasks: for each cluster its number of vectors, the sums of their components and of their distances."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total, far = np.zeros(len(centres), np.int64), np.zeros((len(centres), DIMS), np.int64), [0] * len(centres)
            for batch in batches:
                vectors = _planes_of(batch, bits)
                for at in range(0, len(vectors), ROWS):
                    part = vectors[at : at + ROWS]
                    number, distance = nearest(part, centres)
                    by = np.argsort(number, kind="stable")
                    held, starts = np.unique(number[by], return_index=True)
                    count[held] += np.diff(starts, append=len(part))
                    total[held] += np.add.reduceat(components(part)[by], starts, axis=0)
                    for c, d in zip(held.tolist(), np.split(distance[by], starts[1:]), strict=True):
                        far[c] += sum(d.tolist())  # of any size
            held = np.flatnonzero(count)
            lists = pa.ListArray.from_arrays(np.arange(0, held.size * DIMS + 1, DIMS, dtype=np.int32), total[held].ravel())
            distances = pa.array([min(far[c], LARGEST) for c in held], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(count[held]), lists, distances], ["cluster", "n", "sums", "far"])

        return of

    schema = "cluster int, n long, sums array<long>, far long"
    whole = "decimal(38,0)"

    def gathered(centres: np.ndarray, *columns) -> list:
        parts = table.mapInArrow(sums(centres), schema)
        return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *columns).collect()  # at most k rows

    for _ in range(rounds):
        found = gathered(planes(np.array(centroids, np.int64), bits), F.array(*[F.sum(F.col("sums")[i].cast(whole)) for i in range(DIMS)]).alias("sums"))
        moved = list(centroids)
        for r in found:
            moved[r.cluster] = [int(s) // r.n for s in r.sums]
        if moved == centroids:
            break
        centroids = moved

    centres = planes(np.array(centroids, np.int64), bits)
    inertia = {r.cluster: int(r.far) for r in gathered(centres, F.sum(F.col("far").cast(whole)).alias("far"))}
    by_cluster = np.array([min(inertia.get(c, 0), LARGEST) for c in range(len(centroids))], np.int64)
    over_all, names = min(sum(inertia.values()), LARGEST), np.array([digest(c) for c in centroids], object)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = nearest(_planes_of(batch, bits), centres)
            columns = [number, distance, by_cluster[number], np.full(len(number), over_all), names[number]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, columns)], ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    out = table.mapInArrow(assigned, "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_KEPT = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h, v LIMIT 40)
)"""
_FAR = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_ROUND = """, a{n} AS (
  SELECT vec_id, v, unnest(best).c AS cluster, unnest(best).d AS distance
  FROM (SELECT vec_id, v, [min({{'d': d, 'c': c}})] AS best FROM (
    SELECT k.i, k.vec_id, k.v, c.c, CAST({far} AS BIGINT) AS d FROM (SELECT *, row_number() OVER () AS i FROM kept) k, c{n} c
  ) GROUP BY i, vec_id, v)
)"""
_MOVED = """, s{n} AS (
  SELECT cluster, list(s ORDER BY i) AS v FROM (
    SELECT cluster, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS s FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY cluster, i
  ) GROUP BY cluster
), c{m} AS (
  SELECT c.c, coalesce(s.v, c.v) AS v FROM c{n} c LEFT JOIN s{n} s ON s.cluster = c.c
)"""
_FAR_KC = _FAR.format(a="k.v", b="c.v")
OP11_SQL = (
    _KEPT
    + "".join(_ROUND.format(n=n, far=_FAR_KC) + _MOVED.format(n=n, m=n + 1) for n in range(5))
    + _ROUND.format(n=5, far=_FAR_KC)
    + """
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a5 a JOIN c5 c ON c.c = a.cluster
"""
)
