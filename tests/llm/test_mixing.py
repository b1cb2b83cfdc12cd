import duckdb
import pytest

from hushlake.llm.mixing import OP1_SQL, mix_sources, op1_mix_sources, targets

SCHEMA = "doc_id long, text string, source string"


def words(n):
    return " ".join(["w"] * n)


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_fill_up_and_share_what_is_over(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in targets(sizes, (3, 1, 2), 1.5, 2.0).collect()}
    # weights a 3, b 1, c 2, null 3; total 1740: a (20) and null (100) are full, b fills up as well (200), c takes the rest
    assert got == {"a": 20.0, None: 100.0, "b": 200.0, "c": 1420.0}


def test_each_source_comes_near_its_target_and_reruns_agree(spark):
    rows = [(n, words(n % 17 + 1), f"s{n % 3 if n % 2 else 0}") for n in range(3000)]
    first = {r.doc_id: r for r in mix_sources(docs(spark, rows)).collect()}
    again = {r.doc_id: r.taken for r in mix_sources(docs(spark, rows[::-1]).repartition(7)).collect()}
    assert {k: r.taken for k, r in first.items()} == again and len(first) == 3000
    by = {}
    for r in first.values():
        assert 0 <= r.taken <= 2 * r.size and r.taken % r.size == 0
        t = by.setdefault(r.source, [0, r.target])
        t[0] += r.taken
    for taken, target in by.values():
        assert abs(taken - target) <= 9


def test_odds_favour_documents(spark):
    from pyspark.sql import functions as F

    rows = docs(spark, [(n, words(5), "a" if n % 4 else "b") for n in range(4000)]).withColumn("o", F.when(F.col("doc_id") % 2 == 1, 3.0).otherwise(1.0))
    got = mix_sources(rows, weights=(1, 9), share=0.6, odds_col="o").where("source = 'a'").collect()
    heavy = [r.copies for r in got if r.doc_id % 2]
    light = [r.copies for r in got if not r.doc_id % 2]
    assert sum(heavy) / len(heavy) > 1.8 * sum(light) / len(light)


def test_odd_rows(spark):
    rows = [(None, "a b", None), (1, None, "s"), (1, None, "s"), (2, "", "s"), (3, " \t\n", "s"), (4, words(50_000), "s"), (4, words(50_000), "s"), (5, "x", None)]
    df = docs(spark, rows)
    for c in ("size", "rank", "bucket", "u", "target", "border", "copies"):
        df = df.withColumn(c, df.doc_id)
    got = mix_sources(df).collect()
    assert len(got) == 8
    assert sorted(r.size for r in got) == [0, 0, 0, 0, 1, 2, 50_000, 50_000]
    assert all(r.taken == 0 for r in got if r.size == 0)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, None, "b")]])
def test_nothing_to_mix(spark, rows):
    got = mix_sources(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.taken == 0 and r.target == 0 for r in got)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(OP1_SQL).fetchall()
    got = [tuple(r) for r in op1_mix_sources(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def test_plan_is_native(spark, sf_dir):
    plan = op1_mix_sources(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
