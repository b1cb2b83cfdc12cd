"""Operator 8: toxicity by a convolutional text classifier trained in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm.common import BROADCAST_ROWS, fresh, kept

FEATURES, DIMS, FILTERS, WIDTHS = 1 << 15, 16, 12, (1, 2, 3)
PAD = max(WIDTHS) - 1
POOLED = FILTERS * len(WIDTHS)

#: Words whose filter responses a worker remembers; beyond it the memory starts anew.
REMEMBERED = 150_000

#: Bytes of texts, about, that are split into words at a time, and words whose pieces are hashed at a time.
SLICE, HASHED = 1 << 20, 2000

#: Tokens that are convolved at a time; a longer document goes in slices that overlap by PAD, with the same maxima.
TOKENS = 1 << 16

#: Scores are counted in bins of their logit for the thresholds: PER_LOGIT bins in each unit, from -REACH to REACH.
REACH, PER_LOGIT = 16, 32
BINS = 2 * REACH * PER_LOGIT

_words = re.compile(r"\w+").findall


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, one word after another, and how many each has: the word itself and its pieces of 3 to 6
    bytes, the borders marked."""
    coded = [b"<%b>" % w.encode() for w in words]
    sizes = np.array([len(c) for c in coded])
    owner = np.repeat(np.arange(len(words)), sizes)
    letters = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    ids, owners = [np.array([zlib.crc32(c) for c in coded], np.uint32)], [np.arange(len(words))]
    for n in range(3, 7):
        if len(letters) < n:
            break
        h = np.full(len(letters) - n + 1, n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + letters[k : len(letters) - n + 1 + k]
        inside = owner[: len(h)] == owner[n - 1 :]
        h = h[inside] * np.uint32(0x9E3779B1)
        ids.append(h ^ (h >> np.uint32(15)))
        owners.append(owner[: len(inside)][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (np.concatenate(ids)[order] % FEATURES).astype(np.int64), np.bincount(owners, minlength=len(words))


@dataclass
class Model:
    embed: np.ndarray  # FEATURES x DIMS
    filters: list[np.ndarray]  # for each width w: w x DIMS x FILTERS
    bias: np.ndarray  # POOLED
    out: np.ndarray  # POOLED
    shift: float

    def digest(self) -> int:
        """A number that tells models apart."""
        return zlib.crc32(b"".join(p.tobytes() for p in (self.embed, *self.filters, self.bias, self.out, np.float64(self.shift))))

    def responses(self, words: list[str]) -> np.ndarray:
        """For each word, what it adds to each filter at each of its places: sum(WIDTHS) * FILTERS numbers."""
        feats, counts = features(words)
        vectors = np.add.reduceat(self.embed[feats], np.cumsum(counts) - counts) / counts[:, None]
        weights = np.concatenate([f.transpose(1, 0, 2).reshape(DIMS, -1) for f in self.filters], axis=1).astype(np.float32)
        # Added up one dimension after another: a matrix product's rounding would depend on the words beside.
        out = np.zeros((len(words), weights.shape[1]), np.float32)
        for x, w in zip(vectors.astype(np.float32).T, weights, strict=True):
            out += x[:, None] * w
        return out


class Scorer:
    """Scores texts; a word's responses are computed once and then added up."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 14, sum(WIDTHS) * FILTERS), np.float32)  # row 0 is padding

    def pooled(self, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The filters' maxima over each document; documents are followed by PAD paddings."""
        best, at = [], 0
        rows = self.table[places]
        for w in WIDTHS:
            sums = rows[:, at : at + FILTERS].copy()
            for k in range(1, w):
                sums[:-k] += rows[k:, at + k * FILTERS : at + (k + 1) * FILTERS]
            best.append(np.maximum.reduceat(sums, starts))
            at += w * FILTERS
        return np.concatenate(best, axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        split = [_words(t.lower()) for t in texts]
        if len(self.known) > REMEMBERED:
            self.clear()
        new = list(set(chain.from_iterable(split)).difference(self.known))
        if new:
            first = len(self.known) + 1
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            while len(self.table) < first + len(new):
                grown = np.zeros((2 * len(self.table), self.table.shape[1]), np.float32)  # rows not yet used take no memory
                grown[: len(self.table)] = self.table
                self.table = grown
            for k in range(0, len(new), HASHED):
                self.table[first + k : first + min(k + HASHED, len(new))] = self.model.responses(new[k : k + HASHED])
        best = np.full((len(texts), POOLED), -np.inf, np.float32)
        owners, held, size = [], [], 0

        def flush() -> None:
            if owners:
                starts = np.cumsum([0, *map(len, held[:-1])])
                np.maximum.at(best, owners, self.pooled(np.concatenate(held), starts))
                owners.clear()
                held.clear()

        for n, ws in enumerate(split):
            ids = np.zeros(max(len(ws), 1) + PAD, np.int64)
            ids[: len(ws)] = list(map(self.known.__getitem__, ws))
            for lo in range(0, max(len(ws), 1), TOKENS):
                part = ids[lo : lo + TOKENS + PAD]
                owners.append(n)
                held.append(part)
                size += len(part)
                if size > TOKENS:
                    flush()
                    size = 0
        flush()
        hidden = np.maximum(best.astype(float) + self.model.bias, 0)
        return 1 / (1 + np.exp(-np.clip((hidden * self.model.out).sum(axis=1) + self.model.shift, -30, 30)))


def numbered(texts: Iterable[str], vocab: dict[str, int]) -> list[np.ndarray]:
    """Each text as the numbers of its words; ``vocab`` takes new words up. A text can go once the next one is asked for."""
    return [np.array([vocab.setdefault(w, len(vocab)) for w in _words(t.lower())], np.int32) for t in texts]


def train(docs: list[np.ndarray], vocab: list[str], labels: np.ndarray, steps: int = 500, batch: int = 32, rate: float = 0.01, seed: int = 0) -> Model:
    """Adam on the log loss, lazily for embeddings, over documents whose words are places in ``vocab``. Windows that reach
    past a document's end see zeros, as in Scorer."""
    rng = np.random.default_rng(seed)
    labels, epochs = labels.astype(np.float32), max(2, round(steps * batch / max(1, len(docs))))
    # Hashed some words at a time: what hashing holds besides its result is many times that.
    parts = [features(vocab[k : k + HASHED]) for k in range(0, len(vocab), HASHED)]
    flat_feats = np.concatenate([np.zeros(0, np.int32), *(f.astype(np.int32) for f, _ in parts)])
    ends = np.cumsum(np.concatenate([np.zeros(1, int), *(n for _, n in parts)]))
    del parts
    model = Model(
        rng.normal(0, 0.1, (FEATURES, DIMS)).astype(np.float32),
        [rng.normal(0, (2 / (w * DIMS)) ** 0.5, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(POOLED, np.float32), rng.normal(0, 0.3, POOLED).astype(np.float32), 0.0,
    )
    shift = np.zeros(1, np.float32)
    params = [*model.filters, model.bias, model.out, shift]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    embed_moments = np.zeros_like(model.embed), np.zeros_like(model.embed)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            chosen = order[lo : lo + batch]
            types, places = np.unique(np.concatenate([docs[k] for k in chosen]), return_inverse=True)
            sizes = np.array([len(docs[k]) for k in chosen])
            own = [flat_feats[ends[k] : ends[k + 1]] for k in types]
            counts = np.array([len(f) for f in own], int)
            flat = np.concatenate(own) if own else np.zeros(0, np.int32)
            vectors = np.zeros((len(types) + 1, DIMS), np.float32)  # the last row is padding
            if len(own):
                vectors[:-1] = np.add.reduceat(model.embed[flat], np.cumsum([0, *counts[:-1]])) / counts[:, None].astype(np.float32)
            padded, starts, at = [], [], 0
            for part in np.split(places, np.cumsum(sizes)[:-1]):
                starts.append(sum(map(len, padded)) if not padded else starts[-1] + len(padded[-1]))
                padded.append(np.concatenate([part, np.full(PAD + (not len(part)), len(types))]))
            rows = np.concatenate(padded)
            starts = np.array(starts)
            real = rows != len(types)
            real[starts] = True
            doc = np.repeat(np.arange(len(chosen)), np.diff(np.append(starts, len(rows))))
            x = vectors[rows]
            pooled, where = np.zeros((len(chosen), POOLED), np.float32), np.zeros((len(chosen), POOLED), np.int64)
            for n, (w, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
                sums = x @ f[0]
                for k in range(1, w):
                    sums[:-k] += (x @ f[k])[k:]
                sums[~real] = -np.inf
                top = np.maximum.reduceat(sums, starts)
                row, unit = np.nonzero(sums == top[doc])
                pooled[:, n * FILTERS : (n + 1) * FILTERS] = top
                where[doc[row][::-1], n * FILTERS + unit[::-1]] = row[::-1]  # the first place of the maximum
            hidden = np.maximum(pooled + model.bias, 0)
            z = hidden @ model.out + shift
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) / len(chosen)
            d_out, d_shift = hidden.T @ g, np.array([g.sum()])
            d_pooled = np.outer(g, model.out) * (pooled + model.bias > 0)
            d_bias = d_pooled.sum(axis=0)
            d_vectors, d_filters = np.zeros_like(vectors), []
            for n, (w, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
                cut = slice(n * FILTERS, (n + 1) * FILTERS)
                gp, pos = d_pooled[:, cut], where[:, cut]
                d_f = np.zeros_like(f)
                for k in range(w):
                    token = rows[np.minimum(pos + k, len(rows) - 1)]
                    d_f[k] = np.einsum("bhd,bh->dh", vectors[token], gp)
                    np.add.at(d_vectors, token.ravel(), (gp[:, :, None] * f[k].T[None]).reshape(-1, DIMS))
                d_filters.append(d_f)
            touched = np.flatnonzero(np.abs(d_vectors[:-1]).sum(axis=1))
            step += 1
            if len(touched):
                # Only embeddings with a gradient move, and only their moments decay.
                share = np.repeat(d_vectors[touched] / counts[touched, None], counts[touched], axis=0)
                moved, where = np.unique(np.concatenate([own[k] for k in touched]), return_inverse=True)
                grad = np.zeros((len(moved), DIMS), np.float32)
                np.add.at(grad, where, share)
                m, v = (x[moved] for x in embed_moments)
                m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
                for x, new in zip(embed_moments, (m, v), strict=True):
                    x[moved] = new
                model.embed[moved] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            for p, grad, (m, v) in zip(params, [*d_filters, d_bias, d_out, d_shift], moments, strict=True):
                m *= 0.9
                m += 0.1 * grad
                v *= 0.99
                v += 0.01 * grad * grad
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.shift = float(shift[0])
    return model


def best_threshold(toxic: np.ndarray, clean: np.ndarray) -> float:
    """The threshold with the highest F1, from the weights of toxic and clean rows in each score bin: halfway, in logits,
    between the lowest bin it takes and the next below it that has rows."""
    hits, named = np.cumsum(toxic[::-1])[::-1], np.cumsum((toxic + clean)[::-1])[::-1]
    used = np.flatnonzero(toxic + clean > 0)[::-1]
    k = int(np.argmax(2 * hits[used] / (named[used] + toxic.sum())))
    low = used[k + 1] + 1 if k + 1 < len(used) else used[k]
    return float(1 / (1 + np.exp(REACH - (used[k] + low) / 2 / PER_LOGIT)))


def thresholds(counts: dict[str, np.ndarray], least: float) -> tuple[float, dict[str, float]]:
    """The threshold of all rows and of each language, from the weights of clean and toxic rows (2 x BINS) by language.

    A language's own rows are joined by as many rows of all languages as hold ``least`` toxic ones (``least`` is in the
    unit of the weights), so a language with few toxic rows stays near the threshold of all.
    """
    every = sum(counts.values(), np.zeros((2, BINS)))
    if not every.sum(axis=1).all():
        return 0.5, {}
    prior = every * (least / every[1].sum())
    return best_threshold(every[1], every[0]), {k: best_threshold(c[1] + prior[1], c[0] + prior[0]) for k, c in sorted(counts.items())}


@dataclass
class Toxicity:
    model: Model
    threshold: float
    by_lang: dict[str, float]


def labelled(labels: DataFrame, fit_rows: Column | None) -> DataFrame:
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if fit_rows is not None:
        rows = rows.where(fit_rows)
    return rows.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()


def learn(docs: DataFrame, labels: DataFrame, fit_rows: Column | None = None, per_class: int = 2000, calibrate: float = 0.2) -> tuple[Model, DataFrame | None, int]:
    """The model, the ids of the rows it was trained on (None without labels of both classes) and the number of labels.

    It learns from at most ``per_class`` toxic and as many clean labelled rows, drawn by a hash of doc_id, but for a
    share ``calibrate`` of them. The score's intercept is moved to the labelled rows' own rate. Labels other than 0 and
    1 and null texts or ids are left out. Without labels of both classes every score is their rate (0 without any).
    """
    rows = labelled(labels, fit_rows)
    totals = dict(rows.groupBy("toxic").count().collect())
    n_labels = sum(totals.values())
    draw = F.xxhash64("doc_id", F.lit(8))
    chosen = [rows.where(F.col("toxic") == t).orderBy(draw, "doc_id").limit(per_class) for t in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])  # at most 2 * per_class rows
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id")
    # Of rows that repeat an id the first text counts, so that no more rows come than the sample has.
    found = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id", "toxic")
    # Texts come a partition at a time and stay as numbers of their words.
    ids, toxic, vocab = [], [], {}

    def texts() -> Iterator[str]:
        for row in found.toLocalIterator():
            ids.append(row["doc_id"])
            toxic.append(row["toxic"])
            yield row["text"]

    words, y = numbered(texts(), vocab), np.array(toxic, float)
    if not 0 < y.sum() < len(y):
        rate = totals.get(1, 0) / max(1, n_labels)
        logit = np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
        empty = Model(np.zeros((FEATURES, DIMS), np.float32), [np.zeros((w, DIMS, FILTERS)) for w in WIDTHS], np.zeros(POOLED), np.zeros(POOLED), float(logit))
        return empty, None, n_labels
    drawn = {t: min(per_class, totals[t]) for t in (0, 1)}
    held = np.array([zlib.crc32(f"fold{i}".encode()) % 1000 < 1000 * calibrate for i in ids], bool)
    if len(np.unique(y[~held])) < 2:
        held[:] = False
    model = train([w for w, h in zip(words, held, strict=True) if not h], list(vocab), y[~held])
    model.shift += float(np.log(totals[1] / drawn[1]) - np.log(totals[0] / drawn[0]))
    trained = [(i,) for i in dict.fromkeys(i for i, h in zip(ids, held, strict=True) if not h)]
    return model, docs.sparkSession.createDataFrame(trained, docs.select("doc_id").schema), n_labels


def fit(docs: DataFrame, labels: DataFrame, fit_rows: Column | None = None, per_class: int = 2000, calibrate: float = 0.2, least: int = 25) -> Toxicity:
    """The model of ``learn``, with a threshold for all rows and one for each language that has labelled rows.

    Thresholds come from every labelled row that was not trained on: Spark scores them and counts them by language,
    class and score bin. Rows of a class count by how many labelled rows of the class each of them stands for. A
    language with few toxic rows is drawn towards the threshold of all, as if ``least`` toxic rows of all came to its own.
    """
    model, trained, n_labels = learn(docs, labels, fit_rows, per_class, calibrate)
    if trained is None:
        return Toxicity(model, 0.5, {})
    rows = labelled(labels, fit_rows)
    rows = rows.join(F.broadcast(trained.withColumn("trained", F.lit(True))), "doc_id", "left")  # at most 2 * per_class ids
    rows = docs.select("doc_id", "text", "lang").where("text IS NOT NULL").join(F.broadcast(rows) if n_labels <= BROADCAST_ROWS else rows, "doc_id")
    # A row that was trained on is not scored: its text is emptied and its bin is null.
    seen = F.coalesce("trained", F.lit(False))
    rows = rows.select("toxic", F.coalesce("lang", F.lit("")).alias("lang"), seen.alias("seen"), F.when(seen, F.lit("")).otherwise(F.col("text")).alias("text"))
    rows = score(rows, Toxicity(model, 0.5, {}))
    place = F.floor((F.log(F.col("tox_score") / (1 - F.col("tox_score"))) + REACH) * PER_LOGIT)
    place = F.when(~F.col("seen"), F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)).cast("int"))
    found = rows.groupBy("lang", "toxic", place.alias("bin")).count().collect()
    counts: dict[str, np.ndarray] = {}
    every, fresh_rows = np.zeros(2), np.zeros(2)
    for lang, toxic, at, n in found:
        every[toxic] += n
        if at is not None:
            fresh_rows[toxic] += n
            counts.setdefault(lang, np.zeros((2, BINS)))[toxic, at] += n
    weight = every / np.maximum(fresh_rows, 1)
    return Toxicity(model, *thresholds({k: c * weight[:, None] for k, c in counts.items()}, least * weight[1]))


def score(docs: DataFrame, fitted: Toxicity) -> DataFrame:
    """``docs`` with tox_score (0 to 1) and tox_rejected (the score reaches the threshold of the row's ``lang``, or the
    one for all languages). Where ``docs`` has such columns already, underscores go before the new names.

    Only the text enters the score, whole texts however long; a null text counts as empty and has the score of no
    words. Repeated rows score alike; empty input gives no rows; all columns of ``docs`` stay.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(fitted.model), fitted.model.digest()

    def run(texts: Iterator["pa.Array"]) -> Iterator["pa.Array"]:
        scorer = kept(("toxicity", name), lambda: Scorer(shared.value))
        for part in texts:
            # A slice ends where its texts pass SLICE bytes, so that a few long ones do not fill the memory.
            at = np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False)) // SLICE
            ends = np.append(np.flatnonzero(np.diff(at)) + 1, len(part)).tolist()
            cuts = zip([0, *ends[:-1]], ends, strict=True)
            yield pa.array(np.concatenate([np.zeros(0), *(scorer.scores(part[a:b].to_pylist()) for a, b in cuts if a < b)]))

    udf = F.arrow_udf(run, "double")
    column = fresh(docs, "tox_score")
    rows = docs.withColumn(column, udf(F.coalesce("text", F.lit(""))))
    limits = [F.lit(x) for k, v in sorted(fitted.by_lang.items()) for x in (k, v)]
    limit = F.coalesce(F.element_at(F.create_map(*limits), F.coalesce("lang", F.lit(""))), F.lit(fitted.threshold)) if limits else F.lit(fitted.threshold)
    return rows.withColumn(fresh(docs, "tox_rejected"), F.col(column) >= limit)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model, *_ = learn(docs, labels, fit_rows=fold != 0)
    scored = score(docs.select("doc_id", "text", "lang"), Toxicity(model, 0.5, {}))
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))
