import importlib
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from hushlake.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_without_the_training_data_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        alone = importlib.reload(entry)
        assert set(alone.queries()) == set(QUERIES) and set(alone.oracle_sql()) == set(SQL)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_nothing_else_imports_the_subpackage():
    top = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(top, "hushlake")):
        if f"{os.sep}llm" not in folder:
            for name in files:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as file:
                        assert "hushlake.llm" not in file.read(), name


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 228 and {r.rule_id: r.docs for r in rows}["credit-card"] == 3


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(row, columns):
    return tuple(None if row[c] is None else str(int(row[c])) if isinstance(row[c], float) and row[c] == int(row[c]) else str(row[c]) for c in columns)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [plain(dict(zip(names, r, strict=True)), columns) for r in found.fetchall()]
    assert sorted((plain(r, columns) for r in df.collect()), key=str) == sorted(want, key=str)
