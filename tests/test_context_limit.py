import duckdb

from pyspark.sql import functions as F

from hushlake.operators import audit as A
from hushlake.plans import queries as X


def test_limits_as_a_table(spark):
    limits = {"CLI": 200_000, "big": 160_000, "bi": 5, "": 0, "zed": 7}
    clients = ["big-cli", "x", "", None, "BIG one", "Cli", "a cl i", "zed", "abigzed", "big-cli"]
    rows = spark.createDataFrame([(n, c, "old") for n, c in enumerate(clients)], "id int, client string, context_limit string")
    for some in ({}, {k: v for k, v in limits.items() if k}, limits):
        table = spark.createDataFrame([*some.items(), (None, 3), ("x", None)], "key string, tokens long")
        want = {r.id: r[1] for r in rows.select("id", A.context_limit(F.col("client"), some).cast("long")).collect()}
        got = A.with_context_limit(rows, table)
        assert got.columns == rows.columns
        found = {r.id: r.context_limit for r in got.collect()}
        assert len(found) == len(clients) and found == want


def test_keys_of_one_name_in_two_cases(spark):
    rows = spark.createDataFrame([("abc",)], "client string")
    table = spark.createDataFrame([("b", 2), ("B", 1), ("abcd", 9)], "key string, tokens long")
    assert A.with_context_limit(rows, table).first().context_limit == 1
    assert A.with_context_limit(rows.limit(0), table).count() == 0


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("events", "documents", "conversations", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = sorted(map(str, (tuple(r) for r in X.QUERIES["context_use"](spark, folder).collect())))
    want = db.execute(X.SQL["context_use"]).fetchall()
    assert got == sorted(map(str, want)) and got


def test_rows_are_dealt_by_their_number(spark):
    """A small file of many rows, of which each is made into much, is no longer a task for each core alone."""
    from hushlake.plans.queries import spread

    rows = spark.range(1000).repartition(1)
    assert spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(rows, rows, 10).rdd.getNumPartitions() == 100


def test_traits_are_found_once_for_all_their_keys(spark):
    from pyspark.sql import functions as F

    from hushlake.operators.requests import telemetry_summary

    plan = spark.range(1).select(telemetry_summary(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "$.context.traits" in plan and "$.context.traits.email" not in plan
