import math

import numpy as np

from hushlake.llm import blocks, common, near_vectors
from hushlake.llm.common import connected_components
from hushlake.llm.near_vectors import op7_near_vectors, table_sizes
from hushlake.llm.near_vectors import near_vectors as join

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if g else None for (_, v, _), g in zip(rows, ok, strict=True)]
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    low = {}
    for k, (i, *_) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, links[k], low[find(k)], i == low[find(k)]) for k, (i, *_) in enumerate(rows))


def got(df):
    return sorted(tuple(r) for r in join(df).collect())


def rows_of(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for group in range(12):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 30))):
            v = base + rng.standard_normal(16) * rng.uniform(0, 0.35)
            rows.append((len(rows) * 3 + 5, [float(np.float32(x)) for x in v], int(group % 3)))
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(50)] + [(1100, rows[0][1], None), (1101, [2 * x for x in rows[0][1]], 0), (1102, [-x for x in rows[0][1]], 0)]
    rows += [(1200, None, 1), (1201, [], 1), (1202, [0.0] * 16, 1), (1203, [0.0] * 16, 1), (1204, [float("nan")] * 16, 1), (1205, [float("inf")] + [1.0] * 15, 1), (1206, [None] + [1.0] * 15, 1)]
    rows += [(1300, [1.0, 2.0], 1), (1301, [1.0, 2.01], 1), (1302, [1e-30, 2e-30], 1), (1302, [1e-30, 2e-30], 1), (1303, [1e30, 2e30], 1)]
    return rows


def test_against_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "vector", "key", "copies", "table", "bucket"):
        df = df.withColumn(c, df.vec_id)
    assert got(df) == brute(rows)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "units", lambda members: blocks.units(members, block=8))
    rows = rows_of(3)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_nothing_is_broadcast(spark, monkeypatch):
    """Spark takes exploded and compressed tables for small ones; none of those that grow with the rows may reach the driver."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.written(df)

    for module in (near_vectors, blocks):
        monkeypatch.setattr(module, "written", noted)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    kind = type(spark.range(1))
    saved = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or saved(df))
    out = join(spark.createDataFrame(rows_of(), SCHEMA))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and not [p for p in plans if "Broadcast" in p]


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(None, [1.0], 1), (2, [1.0], 1)], SCHEMA)) == [(2, 0, 2, True)]


def test_tables_follow_the_rows():
    assert table_sizes(10**3, 0.93)[1] < table_sizes(10**6, 0.93)[1] <= 62
    tables, bits = table_sizes(10**5, 0.93)
    assert (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** tables <= 1e-6


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r) for r in op7_near_vectors(spark, sf_dir).collect()) == brute(rows)


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 4), (9, 8), (8, 7), (7, 9), (5, 5), (2, 1), (None, 3)] + [(100 + k, 101 + k) for k in range(40)] + [(500, 501 + k) for k in range(60)]
    found = dict(connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    assert found == {**{k: 1 for k in (1, 2, 3, 4)}, **{k: 7 for k in (7, 8, 9)}, **{100 + k: 100 for k in range(41)}, **{500 + k: 500 for k in range(61)}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
