from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from hushlake.llm.filter_audit import OP12_SQL, filter_audit, op12_filter_audit, quality_filters, with_potential

SCHEMA = "doc_id long, text string, source string"
LETTERS = "ABCDE"


def fails_of(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    out = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
    return out + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)) + "D" * any(c in "#$%&*|" for c in text)


def plain(rows, labels):
    """Every order applied to every document."""
    labels = {k: (any(q == 1 for i, q, _ in labels if i == k), any(t == 1 for i, _, t in labels if i == k)) for k, _, _ in labels}
    rows = [(i, t or "", s or "") for i, t, s in rows]
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t, _ in rows:
        first[t] = min(first.get(t, order(i)), order(i))
    docs = [(s, fails_of(t) + "E" * (order(i) > first[t]), *(labels.get(i, (False, False)) if i is not None else (False, False))) for i, t, s in rows]
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys(LETTERS, 0)
        found = []
        for p in permutations(LETTERS):
            left = mine
            for step, c in enumerate(p, 1):
                gone = [d for d in left if c in d[1]]
                left = [d for d in left if c not in d[1]]
                shapley[c] += len(gone)
                all_fail = sum(c in d[1] for d in mine)
                found.append((part, "".join(p), step, len(left), len(gone), all_fail - len(gone), sum(d[1] == c for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone), c))
        out += [(*f[:-1], shapley[f[-1]]) for f in found]
    return out


def audited(spark, rows, labels, extra=()):
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in extra:
        docs = docs.withColumn(c, F.col("doc_id"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    found = filter_audit(docs, quality_filters(F.coalesce("text", F.lit(""))), "E", outcomes=marks, lost={"good_lost": "good", "toxic_lost": "toxic"})
    return sorted(tuple(r) for r in found.collect())


LONG = " ".join(f"w{n}" for n in range(80))


def test_equals_every_order_applied(spark):
    rows = [
        (1, "few words", "a"), (2, LONG, "a"), (3, LONG, "a"), (4, LONG, "b"), (5, LONG + " #", "b"), (6, "x " * 60, "a"), (7, "HI " * 60, "b"), (8, "HI " * 60 + "$", "b"),
        (9, None, "a"), (10, "", None), (11, "", ""), (12, "few words", "a"), (13, LONG.upper(), "a"), (2, LONG, "a"), (2, LONG, "a"), (None, LONG, "a"), (None, "alone", "c"), (None, "alone", "c"), (14, "x y", "c"),
    ]
    labels = [(1, 1, 0), (3, 1, 1), (3, 0, 0), (4, None, 1), (5, 1, None), (None, 1, 1), (9, 0, 1), (99, 1, 1), (13, 1, 0)]
    got = audited(spark, rows, labels, ("id", "digest", "part", "mask", "key", "n", "good", "toxic"))
    assert got == sorted(plain(rows, labels))
    assert len(got) == 4 * 600


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(None, "", "s")] * 3])
def test_small_tables(spark, rows):
    assert audited(spark, rows, []) == sorted(plain(rows, []))


def test_potential_shares_what_all_remove(spark):
    games = spark.createDataFrame([([0, 6, 0, 9],), ([0, 4, 4, 4],)], "removed array<long>")  # two filters
    got = [r.shares for r in with_potential(games, "removed", 2, "shares").collect()]
    assert got == [[6 + 9, 0 + 3], [4, 4]]


def test_a_hot_text_comes_from_each_task_once(spark):
    rows = [(n, "same text" if n % 3 == 0 else f"text {n}", f"s{n % 2}") for n in range(3000)]
    got = {r[0]: r for r in audited(spark, rows, []) if r[1] == "EABCD" and r[2] == 1}
    assert got["s0"][4] == 499 and got["s1"][4] == 500


def test_letters_are_checked(spark):
    docs = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError, match="one letter"):
        filter_audit(docs, {"AB": F.lit(True)})


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    assert sorted(tuple(r) for r in op12_filter_audit(spark, sf_dir).collect()) == sorted(con.execute(OP12_SQL).fetchall())
