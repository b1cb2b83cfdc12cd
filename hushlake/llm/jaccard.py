"""Operator 3: Jaccard self-join on word n-grams with Bayesian pruning of candidates."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm.blocks import UNIT, UNIT_SCHEMA, units
from hushlake.llm.common import connected_components, kept, runs, written

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS

#: Words whose hash a worker remembers; beyond it the memory starts anew.
REMEMBERED = 500_000

#: Shingles of a unit's documents, at about which its blocks become smaller.
SHINGLES = 1_000_000

#: Pairs compared at a time.
PAIRS = 1 << 15

_rng = np.random.default_rng(20)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)], np.uint64)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingler(n: int):
    """A function from a text to its sorted distinct word n-gram hashes (64 bits); fewer than n words are one n-gram."""
    known: dict[str, int] = {}

    def shingles(text: str) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > REMEMBERED:
            known.clear()
        try:
            ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            known.update((w, xxhash.xxh64_intdigest(w)) for w in set(words).difference(known))
            ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(n, len(words))
        grams = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            grams += ids[k : len(words) - size + 1 + k] * _POWERS[size - k]
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(29)
        return np.unique(grams)

    return shingles


def minhash(grams: np.ndarray) -> np.ndarray:
    """HASHES MinHash values (32 bits) of n-gram hashes."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 256):
        h = np.multiply.outer(_A, low[k : k + 256])
        h += _B[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(out, h.min(axis=1), out=out)
    return out


def needed_matches(threshold: float, tolerance: float, step: int) -> dict[int, int]:
    """After n compared values, the fewest matches with which a pair may still reach the threshold.

    With a uniform prior, m of n matches give the similarity a Beta(m + 1, n - m + 1) posterior. Its mass from the
    threshold up equals the chance of at most m successes in n + 1 draws of that probability.
    """
    out = {}
    for n in range(step, HASHES + 1, step):
        mass, m = 0.0, 0
        while m <= n:
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def _candidates(unit: pa.Table, threshold: float, needed: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) of the unit's pairs that pass the posterior test and meet first in this unit's table."""
    table, i, j = (unit.column(c)[0].as_py() for c in ("table", "i", "j"))
    size = unit.column("n").to_numpy()
    sketch = np.frombuffer(b"".join(unit.column("sketch").to_pylist()), np.uint16).reshape(-1, HASHES)
    block = unit.column("block").to_numpy()
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = next(iter(needed))
    rows = max(1, PAIRS // max(1, len(right)))
    for lo in range(0, len(left), rows):
        a, b = (x.ravel() for x in np.meshgrid(left[lo : lo + rows], right, indexing="ij"))
        near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
        if i == j:
            near &= a < b
        a, b = a[near], b[near]
        matches = np.zeros(len(a), np.int32)
        for n, least in needed.items():
            if not len(a):
                break
            matches += (sketch[a, n - step : n] == sketch[b, n - step : n]).sum(axis=1, dtype=np.int32)
            stay = matches >= least
            a, b, matches = a[stay], b[stay], matches[stay]
        if len(a):
            first = (sketch[a] == sketch[b]).reshape(len(a), BANDS, ROWS).all(axis=2).argmax(axis=1) == table
            found_a.append(a[first])
            found_b.append(b[first])
    return np.concatenate(found_a), np.concatenate(found_b)


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row number that each row reaches by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def jaccard_join(
    docs: DataFrame, threshold: float = 0.8, words: int = 5, tolerance: float = 1e-6, step: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs`` with an id: id_col, class_id, n_links, n_shingles.

    Two documents are linked when the Jaccard similarity of their sets of ``words``-word n-grams (lower-cased, split at
    white space; a shorter text is one n-gram) is ``threshold`` or more. n_links counts the other documents that one is
    linked to, copies included; class_id is the smallest id that it reaches by links, itself included.

    Documents of equal sets form one entry that carries its number of documents. Of each MinHash value its low 16 bits
    are kept: equal values stay equal, and the few unequal ones that look equal only make more candidates. Entries with
    equal bands of values are candidates: at the default threshold a pair of exactly that similarity is missed with
    probability 1.4e-7, one above it with less. Inside a unit of bounded size (see blocks.py) the MinHash values of its pairs are compared ``step`` at a
    time and a pair is dropped once the posterior probability that it reaches the threshold is below ``tolerance``. For what remains
    the whole n-gram sets are brought to the unit and compared exactly. Pairs never leave a unit: it returns a count
    of links for each entry and links to one entry for each connected part, and connected components join these.

    A null or empty text has no n-grams, no links and its own class. Rows that repeat an id are documents of their own
    and come back once each. Rows with a null id are left out; empty input gives no rows; further columns are ignored.
    """
    needed = needed_matches(threshold, tolerance, step)
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = kept(("shingles", words), lambda: shingler(words))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                sketches = [minhash(s).astype(np.uint16).tobytes() if len(s) else None for s in sets]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                columns = [part.column("id"), part.column("h"), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "h", "n", "key", "sketch"])

    sketches = written(source.mapInArrow(sketched, "id long, h long, n int, key binary, sketch binary"))
    # One entry for each n-gram set, and its smallest id and that text's hash to find it by. Equal sets have equal sketches.
    entries = sketches.where("n > 0").groupBy("key").agg(F.min(F.struct("id", "h")).alias("at"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = written(entries.select(F.monotonically_increasing_id().alias("entry"), "at.id", "at.h", "key", "copies", "n", "sketch"))
    entries = reps.select("entry", "id", "key", "copies")

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.col("sketch").substr(b * (2 * ROWS) + 1, F.lit(2 * ROWS)), b))
    members = reps.select(F.col("entry").alias("id"), F.posexplode(bands).alias("table", "bucket"))
    placed = units(members, weights=reps.select(F.col("entry").alias("id"), F.col("n").cast("long").alias("weight")), weight_limit=SHINGLES)
    placed = placed.join(reps.select(F.col("entry").alias("id"), "n", "copies", "sketch"), "id")

    columns = ["id", "table", *UNIT, "block", "n", "copies", "sketch"]

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, UNIT):
            a, b = _candidates(unit, threshold, needed)
            if len(a):
                yield unit.select(columns).take(np.unique(np.concatenate([a, b]))).combine_chunks().to_batches()[0]

    survivors = placed.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(pruned, f"id long, {UNIT_SCHEMA}, n int, copies long, sketch binary")
    survivors = written(survivors)

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = kept(("shingles", words), lambda: shingler(words))
        done: set[int] = set()  # repeated rows: each task gives an entry's set once
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = []
                for entry, key, text in zip(part.column("entry").to_pylist(), part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if entry not in done and xxhash.xxh3_128_digest(grams := shingles(text).tobytes()) == key:
                        done.add(entry)
                        out.append((entry, grams))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["entry", "grams"])

    wanted = reps.select("entry", "id", "h", "key").join(survivors.select(F.col("id").alias("entry")).distinct(), "entry")
    texts = source.join(wanted, ["id", "h"]).select("entry", "key", "text")
    sets = texts.mapInArrow(with_sets, "entry long, grams binary").withColumnRenamed("entry", "id")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, UNIT):
            # A set that several tasks gave, as its row is repeated, counts once.
            unit = unit.take(np.sort(np.unique(unit.column("id").to_numpy(), return_index=True)[1])).combine_chunks()
            a, b = _candidates(unit, threshold, needed)
            grams = [np.frombuffer(x, np.uint64) for x in unit.column("grams").to_pylist()]
            size = np.array([len(g) for g in grams])
            common = np.array([np.intersect1d(grams[x], grams[y], assume_unique=True).size for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
            true = common >= threshold * (size[a] + size[b] - common) - 1e-9 if len(a) else np.zeros(0, bool)
            a, b = a[true], b[true]
            if not len(a):
                continue
            copies, ids = unit.column("copies").to_numpy(), unit.column("id").to_numpy()
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            to = ids[_spanning(len(ids), a, b)]
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(to[at]), pa.array(links[at])], ["id", "to", "links"])

    joined = survivors.join(sets, "id").repartition(*UNIT).sortWithinPartitions(*UNIT)
    linked = written(joined.mapInArrow(verified, "id long, to long, links long"))
    parts = connected_components(linked, "id", "to").select(F.col("node").alias("entry"), "component")
    classes = written(entries.join(parts, "entry").select("entry", "id", "component"))
    lowest = classes.groupBy("component").agg(F.min("id").alias("class_id"))
    classes = classes.join(lowest, "component").select("entry", "class_id")
    links = linked.groupBy(F.col("id").alias("entry")).agg(F.sum("links").alias("links"))
    known = entries.join(links, "entry", "left").join(classes, "entry", "left")
    known = known.select("key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_id", "id").alias("class_id"))
    out = sketches.select("id", "n", "key").join(known, "key", "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"), F.col("n").cast("long").alias("n_shingles"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
