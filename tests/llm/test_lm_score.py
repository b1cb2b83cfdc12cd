import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from hushlake.llm import lm_score as L


def sentences(n, seed):
    rng = random.Random(seed)
    subjects, verbs, objects = (["cat", "dog", "fox"], ["sees", "likes", "hears"], ["fish", "corn", "milk"])
    return [" ".join(f"the {rng.choice(subjects)} {rng.choice(verbs)} a {rng.choice(objects)} ." for _ in range(rng.randrange(3, 12))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def fitted(spark):
    return L.fit(L.tokenised(frame(spark, sentences(6000, 1)).repartition(4)), rounds=4, rate=0.3)


def by_hand(text, scorer, counts):
    """The pseudo-likelihood by a plain loop over tokens, with all probabilities written out."""
    v, net = scorer.vocabulary, scorer.network
    words = np.frombuffer(L.Hasher().numbers(text), "<u4").tolist()
    known = {w: k for k, w in enumerate(v.words.tolist())}

    def seen(n):
        if not 0 <= n < len(words):
            return L.BORDER
        rank = v.rank[known[words[n]]] if words[n] in known else L.SEEN
        return rank if rank < L.SEEN else L.SEEN + words[n] % L.HASHED

    softmax = lambda z: np.exp(z) / np.exp(z).sum()
    total = 0.0
    for n, w in enumerate(words):
        h = net.bias.astype(float)
        for k in (-2, -1, 1, 2):
            h = h + net.embed[seen(n + k) + (L.BORDER + 1) * (k > 0)] / abs(k)
        h = np.append(np.tanh(h), 1)
        leaf = v.leaf[known[w]] if w in known else L.OWN + L.SHARED
        p = softmax(h @ net.upper)[leaf // L.LEAVES] * softmax(h @ net.lower[leaf // L.LEAVES])[leaf % L.LEAVES]
        if w in known:
            same = [x for x in known if v.leaf[known[x]] == leaf]
            p *= counts[w] / sum(counts[x] for x in same)
        else:
            p *= (counts[w] + 1) / (sum(c + 1 for x, c in counts.items() if x not in known) + 1)
        total += np.log(p)
    return len(words), total


def test_network_uses_both_sides(spark):
    scorer = fitted(spark)
    good = sentences(50, 9)
    rng = random.Random(3)
    shuffled = []
    for t in good:
        w = t.split()
        rng.shuffle(w)
        shuffled.append(" ".join(w))
    mean = {r.doc_id: r.lm_mean for r in L.score(L.tokenised(frame(spark, good + shuffled)), scorer).collect()}
    assert np.mean([mean[n] > mean[n + 50] for n in range(50)]) > 0.95
    # as good as knowing each word's slot: a third of a chance for three of six tokens
    assert np.mean([mean[n] for n in range(50)]) > -1.2


def test_query_equals_a_plain_loop(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the query's own steps once more, to have the model that it fits; training is the same for the same rows
    tokens = L.tokenised(docs.select("doc_id", "text"))
    scorer = L.fit(tokens)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    counts = Counter(w for t in rows.values() for w in np.frombuffer(L.Hasher().numbers(t), "<u4").tolist())
    got = {r.doc_id: r for r in L.op9_lm_score(spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    for k in sorted(rows)[:12]:
        n, total = by_hand(rows[k], scorer, counts)
        assert got[k].n_tokens == n and abs(got[k].log_prob - total) < 2e-4 * max(1, n), k
        assert n == 0 or abs(got[k].mean_log_prob - total / n) < 2e-4


def test_words_beyond_the_vocabulary(spark):
    texts = [t + f" rare{n} rare{n % 7}" for n, t in enumerate(sentences(60, 4))] + ["rare3 unseen"]
    tokens = L.tokenised(frame(spark, texts))
    scorer = L.fit(tokens, vocabulary=8)
    assert len(scorer.vocabulary.words) == 8 and scorer.vocabulary.rare_words == scorer.counts.count() - 8
    counts = Counter(w for t in texts for w in np.frombuffer(L.Hasher().numbers(t), "<u4").tolist())
    for r in L.score(tokens, scorer).collect():
        assert abs(r.lm_logprob - by_hand(texts[r.doc_id], scorer, counts)[1]) < 1e-3


def test_counts_cover_the_corpus(spark):
    docs = frame(spark, ["a b a", "b, c", "a", None, ""])
    counts = {r.word: r.n for r in L.count_words(L.tokenised(docs)).collect()}
    number = lambda t: int.from_bytes(L.Hasher()[t], "little")
    assert counts == {number("a"): 3, number("b"): 2, number(","): 1, number("c"): 1}
    assert L.Hasher().numbers("It's  x y!") == b"".join(L.Hasher()[t] for t in ["it", "'", "s", "x", "y", "!"])


def test_vocabulary_shares_sum_to_one():
    counts = np.sort(np.random.default_rng(0).integers(1, 5000, 20_000))[::-1]
    v = L.Vocabulary.from_counts(np.arange(7, 7 + 20_000, dtype=np.uint32), counts, int(counts.sum()) + 9, 20_004)
    sums = np.bincount(v.leaf, np.exp(v.log_share.astype(float)), L.CLASSES * L.LEAVES)
    assert np.allclose(sums[:-1], 1, atol=1e-3) and sums[-1] == 0 and (v.rare_tokens, v.rare_words) == (9, 4)
    assert len(np.unique(v.leaf[v.rank < L.OWN])) == L.OWN


def test_steps_lower_the_loss():
    rng = np.random.default_rng(1)
    around = np.stack([rng.integers(0, 50, 4000) + (L.BORDER + 1) * (k > 1) for k in range(4)]).astype(np.int32)
    leaf = ((around[1] * 7 + around[2] - L.BORDER - 1) % 200).astype(np.int32)
    net = L.Network.new()
    state = [np.zeros_like(a) for a in net.arrays()]
    before = net.log_probability(around, leaf).mean()
    step = 1e-3
    grad = L.Network.new()
    grad.step(around, leaf, 0.0, gs := [np.zeros_like(a) for a in grad.arrays()])
    # the squared gradients that a step notes down equal those of finite differences
    for n, at in ((1, (3,)), (2, (4, 6)), (2, (L.DIMS, 2)), (3, (2, 5, 9)), (0, (around[0, 0], 1)), (0, (around[3, 5], 4))):
        loss = []
        for sign in (1, -1):
            moved = L.Network.new()
            moved.arrays()[n][at] += sign * step
            loss.append(-moved.log_probability(around, leaf).astype(float).mean())
        slope = (loss[0] - loss[1]) / (2 * step)
        assert abs(np.sqrt(gs[n][at]) - abs(slope)) < 2e-4, (n, at)
    for _ in range(60):
        net.step(around, leaf, 0.3, state)
    assert net.log_probability(around, leaf).mean() > before + 1


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, " \n"), (3, "word " * 100_000), (3, "word " * 100_000), (4, "😀")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lm_mean": F.lit(2), "tokens": F.lit(3), "_row": F.lit(4)})
    out = L.lm_score(df)
    assert out.columns == ["doc_id", "_lm_mean", "_tokens", "__row", "lm_tokens", "lm_logprob", "lm_mean"]
    rows = sorted(out.collect(), key=lambda r: (r.lm_tokens, r.doc_id or 0))
    assert [r.lm_tokens for r in rows] == [0, 0, 0, 1, 100_000, 100_000] and rows[-1].lm_logprob == rows[-2].lm_logprob and rows[0].lm_logprob == 0 and rows[0].lm_mean is None
    assert L.lm_score(df.limit(0)).collect() == []
    assert L.lm_score(frame(spark, ["a b c"]).withColumnRenamed("text", "rare"), "rare").first().lm_tokens == 3
