import hashlib
import math

import duckdb
import numpy as np
import pytest

from hushlake.llm.centroids import OP11_SQL, cluster_vectors, components, dots, nearest, norms, op11_centroids, planes

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, rounds=5):
    """By definition, with Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in first[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda v: min((far(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(pick(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *pick(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, m in found if m == n) for n in range(len(centres))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, n, d, inertia[n], sum(inertia.values()), names[n]) for i, d, n in found]


@pytest.mark.parametrize("bits", [1, 2, 9, 27])
def test_planes_give_exact_products(bits):
    rng = np.random.default_rng(bits)
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    a, b = (rng.integers(low, high, (n, 64), endpoint=True) for n in (5, 7))
    a[0], b[0] = low, high
    pa, pb = planes(a, bits), planes(b, bits)
    assert (components(pa) == a).all()
    assert (dots(pa, pb) == a @ b.T).all() and (norms(pa) == (a * a).sum(axis=1)).all()
    number, distance = nearest(pa, pb)
    far = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert (distance == far.min(axis=1)).all() and (number == far.argmin(axis=1)).all()


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(n, (rng.normal(size=64) * 0.2 + n % 5 * 0.3).tolist()) for n in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(plain(rows, 12))
    assert sorted(tuple(r) for r in cluster_vectors(df, k=12).collect()) == want
    assert sorted(tuple(r) for r in cluster_vectors(df.repartition(7), k=12).collect()) == want


def test_odd_rows(spark):
    one = [0.5] * 64
    rows = [
        (1, one), (1, one), (1, [0.25] * 64), (None, [-0.7] * 64), (2, None), (3, []), (4, one[:63]), (5, [*one, 0.5]), (6, [*one[:63], None]), (7, [*one[:63], math.nan]),
        (8, [*one[:63], math.inf]), (9, [-math.inf, *one[:63]]), (10, [1000.0] * 64), (11, [-0.001] * 64), (12, [0.0] * 64),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "v", "planes", "cluster", "n"):
        df = df.withColumn(c, df.vec_id)
    key = lambda r: (r[0] is None, r)
    for k in (2, 40):
        got = [tuple(r) for r in cluster_vectors(df, k=k).collect()]
        assert sorted(got, key=key) == sorted(plain(rows, k), key=key) and len(got) == 7


def test_vectors_too_large_for_longs_are_left_out(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (2, [1e30] + [0.0] * 63), (3, [-1e300] * 64)], SCHEMA)
    assert [r.vec_id for r in cluster_vectors(df).collect()] == [1]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(2, [0.1] * 3)]])
def test_nothing_kept(spark, rows):
    df = cluster_vectors(spark.createDataFrame(rows, SCHEMA))
    assert df.collect() == [] and df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(tuple(r) for r in op11_centroids(spark, sf_dir).collect()) == sorted(con.execute(OP11_SQL).fetchall())
