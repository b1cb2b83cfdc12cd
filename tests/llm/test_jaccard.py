import random
from itertools import combinations

import numpy as np

from hushlake.llm import blocks, jaccard
from hushlake.llm.jaccard import jaccard_join, minhash, needed_matches, op3_jaccard_join, shingler

SCHEMA = "doc_id long, text string"


def brute(rows, threshold=0.8, n=5):
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()))
    links, parent = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, low[find(k)], links[k]) for k, (i, _) in enumerate(sets))


def near_copies(seed, base, copies, changes, words=80):
    rng = random.Random(seed)
    text = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for k in range(copies):
        t = list(text)
        for _ in range(rng.randrange(changes + 1)):
            t[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append((base + k, " ".join(t)))
    return out


def got(df, **kw):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(df, **kw).collect())


def test_against_brute_force(spark):
    rows = near_copies(1, 0, 60, 4) + near_copies(2, 100, 30, 2) + near_copies(3, 200, 2, 1) + [(300 + n, f"alone {n} " * 9) for n in range(30)]
    rows += [(400, "A b c"), (401, "a B  c"), (402, "a b"), (403, None), (404, ""), (405, " \n"), (406, "a b c d e"), (406, "a b c d e"), (407, rows[0][1].upper())]
    rows += [(500, "long " * 30_000 + "end"), (501, " ".join(f"v{n}" for n in range(30_000))), (502, " ".join(f"v{n}" for n in range(29_000)))]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "n", "key", "table", "bucket", "copies", "class_id"):
        df = df.withColumn(c, df.text)
    assert got(df) == brute(rows)


def test_buckets_of_many_blocks(spark, monkeypatch):
    rows = near_copies(4, 0, 150, 3)
    monkeypatch.setattr(jaccard, "units", lambda members, weights, weight_limit: blocks.units(members, 16, weights, 500))
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_and_null_ids(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], SCHEMA)) == [(1, 1, 0)]


def test_posterior_bound():
    needed = needed_matches(0.8, 1e-6, 20)
    assert list(needed) == list(range(20, jaccard.HASHES + 1, 20))
    # a pair at the threshold passes each comparison but for the tolerance, a pair at 0.5 does not pass all
    rng = np.random.default_rng(0)
    for similarity, passes in ((0.8, True), (0.5, False)):
        ok = 0
        for _ in range(300):
            hits = np.cumsum(rng.random(jaccard.HASHES) < similarity)
            ok += all(hits[n - 1] >= m for n, m in needed.items())
        assert (ok == 300) is passes


def test_minhash_estimates_similarity():
    cut = shingler(5)
    a, b = (cut(" ".join(f"w{n}" for n in range(lo, lo + 400))) for lo in (0, 40))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash(a) == minhash(b)).mean() - true) < 0.1


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in op3_jaccard_join(spark, sf_dir).collect()) == brute([tuple(r) for r in docs])
