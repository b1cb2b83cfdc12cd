"""Operator 6: pack token sequences by vector best fit."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm.common import kept, written
from hushlake.llm.token_count import byte_letters

#: White-space chunks whose ids a task remembers; beyond it the memory starts anew.
REMEMBERED = 800_000

#: Pieces that one task packs together. A sequence stays open in each such group at the most, so the loss is one in
#: a few thousand, whatever the input's size.
GROUP = 10_000


#: The pre-token pattern of this vocabulary, and the byte order of the byte-level alphabet (token_count.py).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Ids(dict):
    """White-space chunk -> its ids as little-endian 32-bit words, by the tokenizers library.

    A vocabulary that drops white space gives a text the ids of its chunks in turn, and a chunk the ids of its
    pre-tokens. Chunks of Latin letters below U+0250 are lower-cased and split here and only new pre-tokens go through the library's
    model; all others, and those that may hold a special string, go through the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.plain = re.compile(r"[!-;=-~\xA1-\u012F\u0131-\u024F]+").fullmatch
        self.split = regex.compile(PRE_TOKEN).findall
        self.letters = dict(byte_letters())

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if self.plain(chunk):
            parts = self.split(chunk.lower())
            if parts == [chunk]:
                tokens = self.model.tokenize(chunk.encode().decode("latin-1").translate(self.letters))
                ids = array("I", [t.id for t in tokens]).tobytes()
            else:
                ids = b"".join(map(self.__getitem__, parts))
        else:
            ids = array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = ids
        return ids


def encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids, which remembers those of chunks."""
    #: The code points that Unicode counts as white space, as the library does.
    chunks = regex.compile(r"[^\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+").findall
    #: What str.split() takes as white space beyond that.
    odd = re.compile(r"[\x1C-\x1F]").search
    ids = Ids(path)

    def encode(text: str) -> bytes:
        return b"".join(map(ids.__getitem__, chunks(text) if odd(text) else text.split()))

    return encode


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each text's ids and ``end_id``, cut after every ``size`` ids."""
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept(("ids", path), lambda: encoder(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = memoryview(encode(text) + end)
                    for n, at in enumerate(range(0, len(ids), 4 * size)):
                        piece = ids[at : at + 4 * size]
                        rows.append((doc_id, n, at // 4, len(piece) // 4, zlib.crc32(piece)))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(run, schema)


def vector_best_fit(sizes: np.ndarray, capacity: Sequence[float], rule: str = "dot", weights: Sequence[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; row i of ``sizes`` holds (tokens, documents, attention cost) of item i.

    Items come in descending order of tokens. An item looks at all open bins that hold it under every capacity, and takes the
    one of the highest score (of equal ones the first), with all sizes as parts of the capacity: ``dot`` is the weighted
    dot product of the item and of what the bin has used up (one less its residual, so that full bins come first),
    ``norm`` the negative weighted norm of the residual that would be left. Where nothing fits, a bin opens. An item
    that no empty bin holds raises ValueError. Bins that are full are not looked at any more.
    """
    capacity = np.asarray(capacity, float)
    weights = np.ones(len(capacity)) if weights is None else np.asarray(weights, float)
    if (sizes > capacity).any():
        raise ValueError("an item is larger than the capacity")
    order = np.lexsort((np.arange(len(sizes)), -sizes[:, 0]))
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    parts = sizes / capacity
    left = np.empty((1024, len(capacity)))  # residuals of open bins
    names = np.empty(1024, np.int64)
    count = opened = 0
    for i in order.tolist():
        item, open_ = sizes[i], left[:count]
        # Without bins that are too full in tokens, which are many.
        near = np.flatnonzero(open_[:, 0] >= item[0])
        near = near[(open_[near, 1:] >= item[1:]).all(axis=1)]
        if len(near):
            score = (1 - open_[near] / capacity) @ (weights * parts[i]) if rule == "dot" else -(((open_[near] - item) / capacity) ** 2 @ weights)
            best = near[np.argmax(score)]
        else:
            if count == len(left):
                left, names = np.concatenate([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
            best, left[count], names[count] = count, capacity, opened
            count, opened = count + 1, opened + 1
        bins[i], offsets[i] = names[best], int(capacity[0] - left[best, 0])
        left[best] -= item
        if left[best, 0] <= 0:  # the last open bin takes its place
            count -= 1
            left[best], names[best] = left[count], names[count]
    return bins, offsets


def pack(
    docs: DataFrame,
    path: str,
    size: int = 4096,
    end_id: int = 1,
    max_docs: int | None = None,
    max_attention: float | None = None,
    rule: str = "dot",
    weights: Sequence[float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids by the library and ``end_id``; only longer ones are cut, into ``size`` ids each and a rest. A
    sequence holds at most ``size`` ids, ``max_docs`` pieces (default: as many as fit) and ``max_attention`` attention
    cost, the sum of squared lengths (default: size squared, which whole sequences reach but never pass).

    Only lengths are moved: full pieces are sequences of their own where they are, the others are dealt by a hash of
    document and piece into groups of some ten thousand, and each group is packed by vector best fit in one task. The
    number of groups follows the number of pieces, so a task's work is bounded; a document's pieces may lie in several
    sequences. A null or empty text is ``end_id`` alone. Repeated rows are packed each on its own. Null ids are allowed;
    empty input gives no rows; further columns are left out.
    """
    max_docs, max_attention = max_docs or size, max_attention or float(size) ** 2
    if max_attention < float(size) ** 2:
        raise ValueError("a full piece costs size squared; choose a smaller size instead")
    pieces = written(token_pieces(docs, path, size, end_id, id_col, text_col).withColumn("n", F.monotonically_increasing_id()))
    open_pieces = pieces.where(F.col("length") < size)
    groups = max(1, round(open_pieces.count() / GROUP))
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", -1 - F.col("n")).withColumn("offset", F.lit(0).cast("long"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n")
        length = part["length"].to_numpy(float)
        bins, offsets = vector_best_fit(np.column_stack([length, np.ones(len(part)), length**2]), (size, max_docs, max_attention), rule, weights)
        return part.assign(sequence_id=part["g"].to_numpy() * (1 << 32) + bins, offset=offsets)[out]

    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    dealt = open_pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "n"), F.lit(groups)))
    packed = dealt.groupBy("g").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.unionByName(full.select(*out)).withColumnRenamed("doc_id", id_col)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
