import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hushlake.llm.packing import encoder, op6_packing, pack, vector_best_fit
from hushlake.llm.token_count import count_tokens, counter, op4_token_count

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"
_rng = random.Random(5)
TEXTS = [
    "", "a", " ", "\n\n  x", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>z", "aaaa" * 4000, " " * 3000, "don't WE'LL 've 123 ½²Ⅷ", "日本語 😀👩‍👩‍👧 é̈",
    "\x1c\x1d\x85\xa0 z", "İSTANBUL ΣΑΣ ſK ŉ ǅ", "\x00\x01", "the quick brown fox " * 500, "<|startoftext|>hello", "a_b-c=d;e's", "ÀÉÎ õü ßẞ", " 　᠎ x",
] + ["".join(_rng.choice(" \n\tabcdéé'ß😀1½!?<|endoftext|>\x1c\x85SLl") for _ in range(150)) for _ in range(150)]


def test_counts_equal_the_library():
    lib = Tokenizer.from_file(BYTES)
    assert counter(BYTES)(TEXTS) == [len(e.ids) for e in lib.encode_batch(TEXTS, add_special_tokens=False)]


def test_ids_equal_the_library():
    lib, encode = Tokenizer.from_file(WORDS), encoder(WORDS)
    for text in TEXTS:
        assert np.frombuffer(encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text[:40]


def test_count_rows(spark):
    df = spark.createDataFrame([(1, None), (None, "abc é"), (2, ""), (2, ""), (3, "w " * 40_000)], SCHEMA).selectExpr("*", "text AS n_tokens", "text AS n_bytes", "1 AS id")
    rows = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, BYTES).collect()), key=str)
    assert rows == sorted([(1, 0, 0, False), (None, 6, 2, False), (2, 0, 0, False), (2, 0, 0, False), (3, 80_000, 40_001, True)], key=str)
    assert count_tokens(spark.createDataFrame([], SCHEMA), BYTES).collect() == []


def test_count_query(spark, sf_dir):
    lib = Tokenizer.from_file(BYTES)
    docs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in op4_token_count(spark, sf_dir).collect():
        assert r.n_tokens == len(lib.encode(docs[r.doc_id], add_special_tokens=False).ids) and r.over_limit == (r.n_tokens > 512) and r.n_bytes == len(docs[r.doc_id].encode())


def check_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(by)


def test_packing_query(spark, sf_dir):
    encode = encoder(WORDS)
    docs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = op6_packing(spark, sf_dir).collect()
    ids = {k: encode(t) + b"\x01\0\0\0" for k, t in docs.items()}
    want = {(k, n, at // 4, min(len(x) - at, 4 * 4096) // 4, zlib.crc32(x[at : at + 4 * 4096])) for k, x in ids.items() for n, at in enumerate(range(0, len(x), 4 * 4096))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert check_packing(rows, 4096) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "x y"), (2, ""), (3, "word " * 100), (4, "word " * 31)], SCHEMA).selectExpr("*", "1 AS n", "2 AS g", "3 AS piece")
    rows = pack(df, WORDS, size=32).collect()
    check_packing(rows, 32)
    assert sorted(r.length for r in rows) == sorted([1, 1, 3, 1, 32, 32, 32, 5, 32])
    assert pack(spark.createDataFrame([], SCHEMA), WORDS).collect() == []


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_vector_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(1)
    length = rng.integers(1, 500, 3000).astype(float)
    sizes = np.column_stack([length, np.ones(3000), length**2])
    cap = (1000, 7, 400_000.0)
    bins, offsets = vector_best_fit(sizes, cap, rule, (1, 0.5, 0.5))
    for d in range(3):
        assert (np.bincount(bins, sizes[:, d]) <= cap[d]).all()
    for b in range(bins.max() + 1):
        order = np.argsort(offsets[bins == b])
        assert (offsets[bins == b][order] == np.concatenate([[0], np.cumsum(length[bins == b][order])[:-1]])).all()
    lower = max(np.ceil(sizes[:, d].sum() / cap[d]) for d in range(3))
    assert bins.max() + 1 <= 1.15 * lower
    with pytest.raises(ValueError):
        vector_best_fit(np.array([[2000.0, 1, 1]]), cap)


def test_an_item_looks_at_all_bins():
    """The bin of the highest score lies behind more than sixteen tighter ones: of those it is the only one with few documents."""
    tight = [[900.0 - n, 40, 1] for n in range(30)]
    sizes = np.array([*tight, [500.0, 95, 1], [10.0, 1, 1]])
    cap = (1000, 100, 1000)
    bins, _ = vector_best_fit(sizes, cap, "dot", (0.001, 1, 0))
    assert bins[-1] == bins[-2]
