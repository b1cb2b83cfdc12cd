"""Operator 4: token counts by merging ragged arrays, all sequences of a batch at once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm.common import kept

#: The pre-token pattern and the byte order of the byte-level alphabet of this family of vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]

#: Pre-tokens whose count a task remembers; beyond it the memory starts anew.
REMEMBERED = 500_000

#: Bytes of new pre-tokens that are merged in one go.
MERGED_BYTES = 1 << 21

NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[int, str]:
    """Byte -> letter: printable bytes stand for themselves, the others for the code points from 256 on."""
    printable = [b for low, high in PRINTABLE for b in range(low, high + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class Merges:
    """The merge table of a byte-level BPE file as arrays: sorted pairs, their ranks and the symbols they make."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        parts = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.base = np.int64(max(vocab.values()) + 1)
        pairs = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in parts], np.int64)
        made = np.array([vocab[a + b] for a, b in parts], np.int32)
        order = np.argsort(pairs, kind="stable")
        first = np.concatenate([[True], np.diff(pairs[order]) != 0]) if len(order) else np.zeros(0, bool)
        order = order[first]  # of a pair listed twice the earlier rank counts
        self.pairs, self.ranks, self.made = pairs[order], order.astype(np.int32), made
        letters = byte_letters()
        self.symbol = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it is no merge."""
        if not len(self.pairs):
            return np.full(len(left), NONE)
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.ranks[at], NONE).astype(np.int32)

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that survive in each word.

        Symbols of all words lie in one array. In each round every word merges its own lowest-ranked pair, at all places
        where it occurs (in a row of overlaps every second one, from the left); words without a pair leave the array.
        """
        counts = np.zeros(len(words), np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.symbol[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(symbols), NONE)  # of the pair that starts here
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(starts, len(owner)))
            best = np.minimum.reduceat(rank, starts)
            ended = best == NONE
            if ended.any():
                counts[owner[starts[ended]]] = sizes[ended]
                stay = np.repeat(~ended, sizes)
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                if not len(symbols):
                    break
                best, sizes = best[~ended], sizes[~ended]
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            fresh = np.concatenate([[True], np.diff(hit) != 1])
            place = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(fresh, place, 0))
            hit = hit[(place - run_start) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            gone = np.zeros(len(symbols), bool)
            gone[hit + 1] = True
            moved = np.cumsum(~gone) - 1
            symbols, owner, rank = symbols[~gone], owner[~gone], rank[~gone]
            hit = moved[hit]
            again = np.concatenate([hit, hit[hit > 0] - 1])
            last = again == len(symbols) - 1
            rank[again[last]] = NONE
            again = again[~last]
            joined = owner[again] == owner[again + 1]
            rank[again[~joined]] = NONE
            again = again[joined]
            rank[again] = self.rank(symbols[again], symbols[again + 1])
        return counts


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts and remembers the counts of pre-tokens."""
    table, known = merges(path), {}
    find = regex.compile(PRE_TOKEN).findall
    cut = regex.compile("|".join(regex.escape(s) for s in sorted(table.special, key=len, reverse=True))) if table.special else None

    def learn(words: set[str]) -> None:
        batch, held = [], 0
        for w in chain(words, [None]):
            if batch and (w is None or held > MERGED_BYTES):
                known.update(zip(batch, table.count([x.encode() for x in batch]).tolist(), strict=True))
                batch, held = [], 0
            if w is not None:
                batch.append(w)
                held += len(w)

    def count(texts: list[str]) -> list[int]:
        if len(known) > REMEMBERED:
            known.clear()
        split = [cut.split(t) if cut else [t] for t in texts]
        words = [[w for part in parts for w in find(part)] if len(parts) > 1 else find(parts[0]) for parts in split]
        new: set[str] = set()
        for ws in words:
            new.update(ws)
        learn(new.difference(known))
        # special strings inside a text are one token each
        return [len(parts) - 1 + sum(map(known.__getitem__, ws)) for parts, ws in zip(split, words, strict=True)]

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_bytes, n_tokens, over_limit (n_tokens above ``limit``).

    ``path`` is a byte-level BPE file that every executor has. Whole texts are counted, however long; a null text counts
    as empty and has no bytes and no tokens. Special strings of the file count as one token each where a text holds them.
    Repeated rows and null ids are counted like all others, empty input gives no rows, further columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = kept(("counts", path), lambda: counter(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n = pa.array(count(part.column("text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), n], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
