import duckdb
import pytest

from hushlake.llm.exact_dedup import OP2_SQL, exact_duplicates, op2_exact_dedup

SCHEMA = "doc_id long, text string"


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[(t or "").encode().lower()] if x is not None]
        best = (min(ids) if keep == "smallest" else max(ids)) if ids else None
        out.append((i, best, len(groups[(t or "").encode().lower()]), i == best))
    return sorted(out, key=str)


ROWS = (
    [(n, "the same text") for n in range(900)] + [(1000 + n, f"text {n % 40}") for n in range(400)] + [(2000, None), (2001, ""), (2002, "ABC é"), (2003, "abc é"), (2004, "abc É")]
    + [(None, "abc é"), (None, "only null"), (2002, "ABC é"), (2005, "x" * 300_000), (2006, "X" * 300_000), (2007, "x" * 300_001)]
)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("partitions", [1, 13])
def test_against_brute_force(spark, keep, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(ROWS, SCHEMA).repartition(partitions).withColumnsRenamed({})
        for c in ("sha", "part", "keep", "text_sha256", "id"):
            df = df.withColumn(c, df.text)
        got = exact_duplicates(df, keep=keep).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got], key=str) == brute(ROWS, keep)


def test_empty(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        exact_duplicates(spark.createDataFrame([], SCHEMA), keep="first")


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(tuple(r) for r in op2_exact_dedup(spark, sf_dir).collect()) == sorted(con.execute(OP2_SQL).fetchall())
