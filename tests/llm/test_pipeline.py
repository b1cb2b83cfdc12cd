import public_tokenizers

import corpus_pipeline as P
from hushlake.llm import toxicity
from hushlake.llm.packing import encoder
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    """Each stage on what its predecessor kept, against a plain version of its decision."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]

    kept = P.drop_toxic(spark, docs, SF)
    fitted = toxicity.fit(docs, labels)
    rows = docs.orderBy("doc_id").collect()
    scores = toxicity.Scorer(fitted.model).scores([r.text for r in rows])
    want = {r.doc_id for r, s in zip(rows, scores, strict=True) if s < fitted.by_lang.get(r.lang, fitted.threshold)}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == P.COLUMNS
    kept = P.written(kept)

    unique = P.written(P.drop_exact_copies(spark, kept, SF))
    first = {}
    for r in kept.orderBy("doc_id").collect():
        first.setdefault(r.text.encode().lower(), r.doc_id)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(first.values()) and unique.columns == P.COLUMNS

    apart = P.written(P.drop_near_copies(spark, unique, SF))
    classes = brute([(r.doc_id, r.text) for r in unique.collect()])
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, c, _ in classes if i == c) and apart.columns == P.COLUMNS

    mixed = P.written(P.mix(spark, apart, SF))
    taken = {r.doc_id: r.copies for r in P.mix_sources(apart).collect()}
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {k: v for k, v in taken.items() if v} and mixed.columns == P.COLUMNS

    packed = P.pack_sequences(spark, mixed, SF).collect()
    encode = encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in packed) == sum(len(encode(r.text)) // 4 + 1 for r in mixed.collect())
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_run(spark):
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = P.written(stage(spark, docs, SF))
    assert docs.count() == 0


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (1, "", "en", "a", 0), (2, "a b", None, None, 3), (2, "a b", None, None, 3), (3, "w " * 30_000, "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("id", "copies", "n", "tox_score"):
        docs = docs.withColumn(c, docs.doc_id)
    for _, stage in P.STAGES:
        docs = P.written(stage(spark, docs, SF))
    assert docs.count() > 0


def test_null_and_repeated_ids(spark):
    """No row with a text of its own is lost; copies go, but for fully equal rows of one id and near copies without an id."""
    near = [f"word{k}" for k in range(60)]
    rows = [
        (None, "alone and clean", "en", "a", 1), (None, "another one that is alone", "en", "a", 1),
        (7, "said twice by one id", "en", "a", 1), (7, "said twice by one id", "en", "a", 1),
        (8, "SAID twice by one id", "en", "b", 1), (8, "own words of a repeated id", "en", "b", 1), (None, "said TWICE by one id", "en", "b", 1),
        (9, " ".join(near), "en", "a", 1), (None, " ".join([*near, "more"]), "en", "a", 1), (3, " ".join(["less", *near]), "en", "a", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = P.written(P.drop_exact_copies(spark, docs, SF))
    key = lambda r: (r.doc_id or 0, r.text)
    assert sorted(map(key, docs.collect())) == sorted((i or 0, t) for i, t, *_ in [*rows[:4], rows[5], *rows[7:]])
    docs = P.written(P.drop_near_copies(spark, docs, SF))
    assert sorted(map(key, docs.collect())) == sorted((i or 0, t) for i, t, *_ in [*rows[:4], rows[5], *rows[8:]])
    copies = {(r.doc_id, r.source): r.copies for r in P.mix_sources(docs).collect()}
    mixed = P.mix(spark, docs, SF).groupBy("doc_id", "source").count().collect()
    assert {(r.doc_id, r.source) for r in mixed} == {k for k, n in copies.items() if n} and (None, "a") in {(r.doc_id, r.source) for r in mixed}
