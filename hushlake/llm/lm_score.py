"""Operator 9: masked pseudo-likelihood of documents under a bidirectional window network trained in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm.common import fresh, kept, written

#: The network predicts one of CLASSES classes, then one of LEAVES leaves of that class.
CLASSES, LEAVES = 32, 32

#: Of these leaves the most frequent words have one each; the last holds all words beyond the vocabulary, and the SHARED
#: ones before it hold the rest of the vocabulary in bands of about equal counts.
SHARED = 63
OWN = CLASSES * LEAVES - SHARED - 1

#: The most frequent words of the corpus, which travel to the tasks. Beyond them words are looked up by a join.
VOCABULARY = 1 << 17

#: Words that the network sees as themselves; further ones are hashed into HASHED embeddings. The last is a text's border.
SEEN, HASHED = 8192, 1024
BORDER = SEEN + HASHED

#: Tokens on each side that predict one, and the size of embeddings and of the hidden layer (16 with its column of ones).
SIDE, DIMS = 2, 15

#: Tokens of a step, in training and in scoring, and about how many are handled at a time.
STEP, CHUNK = 8192, 1 << 17

#: White-space chunks, or words, that a task remembers; beyond it the memory starts anew.
REMEMBERED = 500_000

_tokens = re.compile(r"\w+|[^\w\s]").findall


class Hasher(dict):
    """White-space chunk -> the numbers of its tokens, little-endian 32-bit words. No token has white space inside."""

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        tokens = [chunk] if chunk.isalnum() else _tokens(chunk)
        self[chunk] = out = b"".join([zlib.crc32(t.encode()).to_bytes(4, "little") for t in tokens])
        return out

    def numbers(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.lower().split()))


def tokenised(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` replaced by lm_words, the numbers of its tokens (words and signs, lower-cased) as
    little-endian 32-bit words, and with lm_row, a number for each row. It is written once and read by all later steps."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers = kept("token numbers", Hasher).numbers
        for part in parts:
            yield pa.array([numbers(t) for t in part.to_pylist()], pa.binary())

    rows = docs.withColumn(fresh(docs, "lm_words"), F.arrow_udf(run, "binary")(F.coalesce(F.col(text_col), F.lit(""))))
    return written(rows.drop(text_col).withColumn(fresh(docs, "lm_row"), F.monotonically_increasing_id()))


def chunks(part: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tokens of successive texts one after another, and how many each has, about CHUNK tokens at a time."""
    if not len(part):
        return
    places = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1] // 4
    words = np.frombuffer(part.buffers()[2] or b"", "<u4")[places[0] : places[-1]]
    ends, sizes = places[1:] - places[0], np.diff(places)
    lo = 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
        yield words[before : ends[hi - 1]], sizes[lo:hi]
        lo = hi


@dataclass
class Vocabulary:
    """The most frequent words by number: each one's rank, leaf and log share of its leaf. Words beyond share the last leaf."""

    words: np.ndarray  # ascending
    rank: np.ndarray
    leaf: np.ndarray
    log_share: np.ndarray
    rare_tokens: int  # tokens, and distinct words, beyond the vocabulary
    rare_words: int

    @staticmethod
    def from_counts(words: np.ndarray, counts: np.ndarray, tokens: int, distinct: int) -> Vocabulary:
        """From the most frequent words and their counts, most frequent first, and the corpus' totals."""
        leaf = np.minimum(np.arange(len(words)), OWN)
        rest = counts[OWN:].astype(float)
        leaf[OWN:] += np.minimum((np.cumsum(rest) - rest) / max(1.0, rest.sum()) * SHARED, SHARED - 1).astype(int)
        share = np.log(counts / np.bincount(leaf, counts, CLASSES * LEAVES)[leaf]) if len(words) else np.zeros(0)
        order = np.argsort(words)
        rank = np.arange(len(words), dtype=np.int32)
        return Vocabulary(words[order], rank[order], leaf[order].astype(np.int32), share[order].astype(np.float32), tokens - int(counts.sum()), distinct - len(words))

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token what the network sees, its leaf, and its log share of the leaf (nan for a word beyond)."""
        if not len(self.words):
            return SEEN + (tokens % HASHED).astype(np.int32), np.full(len(tokens), OWN + SHARED, np.int32), np.full(len(tokens), np.nan, np.float32)
        unique, where = np.unique(tokens, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, unique), len(self.words) - 1)
        known = self.words[at] == unique
        rank = np.where(known, self.rank[at], SEEN)
        seen = np.where(rank < SEEN, rank, SEEN + unique % HASHED).astype(np.int32)
        leaf = np.where(known, self.leaf[at], OWN + SHARED).astype(np.int32)
        return seen[where], leaf[where], np.where(known, self.log_share[at], np.float32(np.nan))[where]


def windows(seen: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What windows are cut from: what the network sees, with borders around each text, and each token's place in it."""
    place = np.arange(len(seen)) + SIDE + np.repeat(np.arange(len(sizes)) * 2 * SIDE, sizes)
    padded = np.full(len(seen) + 2 * SIDE * len(sizes), BORDER, np.int32)
    padded[place] = seen
    return padded, place


def window(padded: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows of the embeddings that stand for what is around these places: 2 * SIDE x places, words before and then after."""
    return np.stack([padded[place + k] + (BORDER + 1) * (k > 0) for k in SHIFTS.tolist()])


#: Places of the window, and how much a word at each counts.
SHIFTS = np.array([k for k in range(-SIDE, SIDE + 1) if k])
NEARNESS = (1 / np.abs(SHIFTS)).astype(np.float32)


@dataclass
class Network:
    """Embeddings of the words before and after, nearer ones counting more -> hidden layer -> softmax over classes, and
    over the leaves of a class."""

    embed: np.ndarray  # 2 * (BORDER + 1) x DIMS: words before, words after
    bias: np.ndarray  # DIMS
    upper: np.ndarray  # (DIMS + 1) x CLASSES; the last row is the intercept
    lower: np.ndarray  # CLASSES x (DIMS + 1) x LEAVES

    @staticmethod
    def new(seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
        return Network(draw(2 * (BORDER + 1), DIMS), np.zeros(DIMS, np.float32), draw(DIMS + 1, CLASSES), draw(CLASSES, DIMS + 1, LEAVES))

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.bias, self.upper, self.lower]

    def copy(self) -> Network:
        return Network(*(a.copy() for a in self.arrays()))

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """tanh of the weighted sum of the embeddings, and a column of ones for the intercepts. ``around`` is 2 * SIDE x n."""
        out = np.ones((around.shape[1], DIMS + 1), np.float32)
        total = self.embed[around[0]] * NEARNESS[0]
        for rows, near in zip(around[1:], NEARNESS[1:], strict=True):
            more = self.embed[rows]
            if near != 1:
                more *= near
            total += more
        total += self.bias
        np.tanh(total, out=out[:, :DIMS])
        return out

    def log_probability(self, around: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        order, cuts = _by_class(leaf)
        hidden, leaf = self.hidden(around[:, order]), leaf[order]
        found = _log_softmax(hidden @ self.upper, leaf // LEAVES)
        for c, lo, hi in cuts:
            found[lo:hi] += _log_softmax(hidden[lo:hi] @ self.lower[c], leaf[lo:hi] % LEAVES)
        out = np.empty_like(found)
        out[order] = found
        return out

    def step(self, around: np.ndarray, leaf: np.ndarray, rate: float, state: list[np.ndarray]) -> None:
        """One step of gradient descent on the mean log loss, scaled by past gradients (Adagrad)."""
        order, cuts = _by_class(leaf)
        around, leaf, n = around[:, order], leaf[order], len(leaf)
        hidden = self.hidden(around)
        d = _softmax_gradient(hidden @ self.upper, leaf // LEAVES, n)
        back, d_upper, d_lower = d @ self.upper.T, hidden.T @ d, np.zeros_like(self.lower)
        for c, lo, hi in cuts:
            d = _softmax_gradient(hidden[lo:hi] @ self.lower[c], leaf[lo:hi] % LEAVES, n)
            d_lower[c] = hidden[lo:hi].T @ d
            back[lo:hi] += d @ self.lower[c].T
        back = back[:, :DIMS] * (1 - hidden[:, :DIMS] ** 2)
        # The gradient of an embedding is the sum over its places: rows are sorted by word and added up.
        words = around.ravel()
        by_word = np.argsort(words.astype(np.uint16), kind="stable")
        starts = np.flatnonzero(np.diff(words[by_word], prepend=-1))
        rows = back[by_word % n] * NEARNESS[by_word // n][:, None]
        touched, d_embed = words[by_word[starts]], np.add.reduceat(rows, starts)
        s = state[0][touched] + d_embed * d_embed
        state[0][touched] = s
        self.embed[touched] -= rate * d_embed / (np.sqrt(s) + 1e-6)
        for a, g, s in zip(self.arrays()[1:], [back.sum(axis=0), d_upper, d_lower], state[1:], strict=True):
            s += g * g
            a -= rate * g / (np.sqrt(s) + 1e-6)


def _by_class(leaf: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by class, and where each class that occurs starts and ends in it."""
    kind = (leaf // LEAVES).astype(np.uint8)
    ends = np.cumsum(np.bincount(kind, minlength=CLASSES)).tolist()
    return np.argsort(kind, kind="stable"), [(c, lo, hi) for c, (lo, hi) in enumerate(zip([0, *ends], ends, strict=False)) if hi > lo]


def _log_softmax(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    own = z[np.arange(len(z)), target]  # tanh bounds the hidden layer, so z needs no shift before exp
    return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32))


def _softmax_gradient(z: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    np.exp(z, out=z)
    z *= (1 / (z @ np.full(z.shape[1], n, np.float32)))[:, None]
    z[np.arange(len(z)), target] -= np.float32(1 / n)
    return z


@dataclass
class Scorer:
    vocabulary: Vocabulary
    network: Network
    counts: DataFrame  # word, n: how often each word of the corpus occurs


def count_words(tokens: DataFrame) -> DataFrame:
    """Rows (word, n) for every word of the corpus, written; each task adds up its own tokens first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(known.astype(np.int64)), pa.array(counts)], ["word", "n"])

        for batch in batches:
            for words, _ in chunks(batch.column(0)):
                more, n = np.unique(words, return_counts=True)
                all_words, where = np.unique(np.concatenate([known, more]), return_inverse=True)
                known, counts = all_words, np.bincount(where, np.concatenate([counts, n]), len(all_words)).astype(np.int64)
                if len(known) > REMEMBERED:
                    yield out()
                    known, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        yield out()

    return written(tokens.select("lm_words").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))


def fit(tokens: DataFrame, rounds: int = 1, rate: float = 0.1, vocabulary: int = VOCABULARY) -> Scorer:
    """Word counts, vocabulary and network from every token of the corpus (see tokenised).

    In each round every task trains a copy of the network on all tokens of its rows, and the copies are averaged: each
    number with the tokens as weight that touched it, as sums over the tasks, so that only the sums reach the driver. Counts
    are a table with a row for each word. Both grow with the corpus; the driver sees the ``vocabulary`` most frequent words.
    """
    spark = tokens.sparkSession
    counts = count_words(tokens)
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(vocabulary).toPandas()
    words = Vocabulary.from_counts(top["word"].to_numpy(np.uint32), top["n"].to_numpy(np.int64), totals[0], totals[1])
    network = Network.new()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((words, network))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, network = shared.value
            network = network.copy()
            state, seen_n = [np.zeros_like(a) for a in network.arrays()], np.zeros(BORDER + 1)
            for batch in batches:
                for tokens, sizes in chunks(batch.column(0)):
                    seen, leaf, _ = words.of(tokens)
                    padded, place = windows(seen, sizes)
                    seen_n += np.bincount(padded, minlength=BORDER + 1)
                    order = np.random.default_rng(len(tokens)).permutation(len(tokens))
                    for k in range(0, len(tokens), STEP):
                        at = order[k : k + STEP]
                        network.step(window(padded, place[at]), leaf[at], rate, state)
            if seen_n.any():
                n = np.concatenate([np.repeat(np.tile(seen_n, 2), DIMS), np.full(sum(a.size for a in network.arrays()[1:]), seen_n.sum())])
                flat = np.concatenate([a.ravel() for a in network.arrays()]).astype(np.float64)
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(flat[k] * n[k]), pa.array(n[k])], ["k", "v", "n"])

        sums: pd.DataFrame = tokens.select("lm_words").mapInArrow(run, "k int, v double, n double").groupBy("k").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
        flat, at = np.concatenate([a.ravel() for a in network.arrays()]), 0
        flat[sums["k"].to_numpy()] = (sums["v"] / sums["n"]).to_numpy(np.float32)
        arrays = []
        for a in network.arrays():
            arrays.append(flat[at : at + a.size].reshape(a.shape))
            at += a.size
        network = Network(*arrays)
        shared.unpersist()
    return Scorer(words, network, counts)


def score(tokens: DataFrame, scorer: Scorer) -> DataFrame:
    """``tokens`` (see tokenised) with lm_tokens, lm_logprob and lm_mean instead of lm_words.

    A task computes for each text the sum over its tokens of the log-probability of the token's leaf given the SIDE
    tokens on both sides, and of the vocabulary word's share of its leaf. What words beyond the vocabulary have of
    theirs is looked up in the counts by a join, one row for each such token.
    """
    shared = tokens.sparkSession.sparkContext.broadcast((scorer.vocabulary, scorer.network))

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary, network = shared.value
        for part in parts:
            n, sums, rare, rare_n = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for words, sizes in chunks(part):
                seen, leaf, found = vocabulary.of(words)
                padded, place = windows(seen, sizes)
                beyond = np.isnan(found)
                found[beyond] = 0
                for k in range(0, len(words), STEP):
                    found[k : k + STEP] += network.log_probability(window(padded, place[k : k + STEP]), leaf[k : k + STEP])
                doc = np.repeat(np.arange(len(sizes)), sizes)
                n.append(sizes)
                sums.append(np.bincount(doc, found, len(sizes)))
                rare.append(words[beyond].astype(np.int64))
                rare_n.append(np.bincount(doc[beyond], minlength=len(sizes)))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(rare_n))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rare)))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(sums)), lists], ["tokens", "logprob", "rare"])

    rows = tokens.withColumn("_lm", F.arrow_udf(run, "tokens long, logprob double, rare array<long>")(F.col("lm_words"))).drop("lm_words")
    rows = written(rows.select(*[c for c in rows.columns if c != "_lm"], "_lm.*"))
    v = scorer.vocabulary
    total = float(v.rare_tokens + v.rare_words + 1)  # every word counts once more, and so does one that was never seen
    rare = rows.select("lm_row", F.explode("rare").alias("word")).join(scorer.counts, "word", "left")
    rare = rare.groupBy(F.col("lm_row").alias("_row")).agg(F.sum(F.log((F.coalesce("n", F.lit(0)) + 1) / total)).alias("_rare"))
    rows = rows.join(rare, F.col("lm_row") == F.col("_row"), "left")
    whole = F.col("logprob") + F.coalesce("_rare", F.lit(0.0))
    out = {"lm_tokens": F.col("tokens"), "lm_logprob": whole, "lm_mean": F.when(F.col("tokens") > 0, whole / F.col("tokens"))}
    return rows.withColumns(out).drop("lm_row", "_row", "_rare", "tokens", "logprob", "rare")


def lm_score(docs: DataFrame, text_col: str = "text", rounds: int = 1, vocabulary: int = VOCABULARY) -> DataFrame:
    """``docs`` without ``text_col``, with lm_tokens, lm_logprob and lm_mean under a network trained on ``docs``.

    Every token (a word or a sign, lower-cased) is predicted from SIDE tokens on both sides. lm_logprob is the sum of the
    tokens' conditional log-probabilities, the pseudo-likelihood's logarithm, and lm_mean that for each token. Whole texts
    are trained on and scored, however long. A null or empty text, or one of white space, has no tokens, lm_logprob 0 and
    a null lm_mean. Repeated rows score alike; empty input gives no rows. A column of ``docs`` that has one of the new
    names, or one that this operator uses on the way, gets underscores in front.
    """
    used = {"lm_words", "lm_row", "lm_tokens", "lm_logprob", "lm_mean", "tokens", "logprob", "rare", "_lm", "_row", "_rare"}
    for c in docs.columns:
        if c.lower() in used and c != text_col:
            name = f"_{c}"
            while name.lower() in used or name.lower() in {x.lower() for x in docs.columns}:
                name = f"_{name}"
            docs = docs.withColumnRenamed(c, name)
    if text_col.lower() in used:
        docs, text_col = docs.withColumnRenamed(text_col, fresh(docs, "lm_text")), fresh(docs, "lm_text")
    tokens = tokenised(docs, text_col)
    return score(tokens, fit(tokens, rounds, vocabulary=vocabulary))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm_score(docs).select("doc_id", F.col("lm_tokens").alias("n_tokens"), F.col("lm_logprob").alias("log_prob"), F.col("lm_mean").alias("mean_log_prob"))
