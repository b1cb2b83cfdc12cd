import random
import zlib

import numpy as np

from hushlake.llm import toxicity as T

_rng = random.Random(2)
COMMON = ["".join(_rng.choice("aeioulnrst") for _ in range(_rng.randrange(2, 8))) for _ in range(300)]
BAD = ["skrumpo", "vadlik", "grobben"]


def make(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words, bad = [rng.choice(COMMON) for _ in range(rng.randrange(5, 60))], rng.random() < 0.25
        if bad:
            for _ in range(1 + len(words) // 15):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ish"]))
        rows.append((k, " ".join(words), "en" if k % 2 else "de", int(bad)))
    return rows


def test_learns_and_holds_on_unseen_rows(spark):
    rows = make(1500, 1)
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, *_, y in rows if i < 1000] + [(5000, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    fitted = T.fit(docs, labels, least=10)
    assert set(fitted.by_lang) == {"en", "de"}
    truth = {i: y for i, *_, y in rows}
    scored = T.score(docs.where("doc_id >= 1000"), fitted).collect()
    assert np.mean([(r.tox_score >= 0.5) == truth[r.doc_id] for r in scored]) > 0.97
    assert np.mean([r.tox_rejected == bool(truth[r.doc_id]) for r in scored]) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "xx"), (3, "w " * 200_000 + "grobben", "en"), (3, "w " * 200_000 + "grobben", "en"), (None, "!!", "en")], "doc_id long, text string, lang string")
    docs = docs.withColumn("tox_score", docs.doc_id).withColumn("score", docs.doc_id)
    rows = make(300, 3)
    train = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows], "doc_id long, text string, lang string")
    fitted = T.fit(train, spark.createDataFrame([(i, y) for i, *_, y in rows], "doc_id long, toxic int"))
    out = T.score(docs, fitted)
    assert out.columns == ["doc_id", "text", "lang", "tox_score", "score", "_tox_score", "tox_rejected"]
    got = out.collect()
    assert len(got) == 5 and all(0 <= r["_tox_score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.text or "", set()).add(r["_tox_score"])
    assert len(by[""]) == 1 and all(len(v) == 1 for v in by.values())
    assert T.score(docs.limit(0), fitted).collect() == []


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    none = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert T.score(docs, none).first().tox_score < 0.01
    ones = T.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert T.score(docs, ones).first().tox_score > 0.99


def test_slices_of_long_texts_have_the_same_maxima(monkeypatch):
    rows = make(200, 4)
    vocab = {}
    words = T.numbered((t for _, t, *_ in rows), vocab)
    model = T.train(words, list(vocab), np.array([y for *_, y in rows], float), steps=60)
    texts = [" ".join(t for _, t, *_ in rows), "grobben", "", "a b"]
    whole = T.Scorer(model).scores(texts)
    monkeypatch.setattr(T, "TOKENS", 50)
    assert np.allclose(whole, T.Scorer(model).scores(texts))


def test_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = T.op8_toxicity(spark, sf_dir).collect()
    assert len(rows) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_thresholds_cover_all_rows_that_were_not_trained_on(spark):
    langs = {1: "de", 2: "de", 3: "fr", 7: None}
    rows = [(i, t, langs.get(i % 50, "en"), y) for i, t, _, y in make(2000, 6)]
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, *_, y in rows], "doc_id long, toxic int")
    fitted = T.fit(docs, labels, per_class=100)
    assert set(fitted.by_lang) == {lang or "" for *_, lang, _ in rows}  # also those with few toxic rows

    trained = {r.doc_id for r in T.learn(docs, labels, per_class=100)[1].collect()}
    rest = [r for r in rows if r[0] not in trained]
    assert len(trained) <= 200 and len(rest) >= 1800
    scores, truth = T.Scorer(fitted.model).scores([r[1] for r in rest]), np.array([r[3] for r in rest])
    weight = np.array([sum(r[3] == y for r in rows) / np.sum(truth == y) for y in (0, 1)])[truth]

    def f1(limit):
        named = scores >= limit
        return 2 * weight[named & (truth == 1)].sum() / (weight[named].sum() + weight[truth == 1].sum())

    assert f1(fitted.threshold) > max(map(f1, scores)) - 0.005


def test_language_thresholds_go_from_that_of_all_to_their_own():
    for size, low, high in ((1, 601, 900), (100_000, 51, 300)):
        counts = {k: np.zeros((2, T.BINS)) for k in ("en", "fr")}
        counts["en"][0, 600], counts["en"][1, 900] = 9000, 1000
        counts["fr"][0, 50], counts["fr"][1, 300] = 9 * size, size  # a toxic row of fr scores below clean rows of en
        limit, own = T.thresholds(counts, 25)
        edges = [1 / (1 + np.exp(T.REACH - k / T.PER_LOGIT)) for k in (low, high)]
        assert set(own) == {"en", "fr"} and edges[0] < own["fr"] < edges[1]
