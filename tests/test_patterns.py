"""Rules in Java's matcher against the same in RE2, by DuckDB, and in a time that follows a text's length."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from hushlake.functions import rules as R
from hushlake.functions.dialect import replacement_to_re2

ROWS = {r[1]: r for r in R.builtin_rows()}
PIECES = {
    "email": ["a", "Z9", ".", "..", "-", "%", "_", "@", "@b.co", ".com", "é", " ", "\n", "x@y.zz", "1@", "+", ".q"],
    "curl-auth-header": ["curl", " ", "\n", "\r\n", "\n\n", "\r", " -H ", "--header=", '"', "'", "Authorization: Basic abcdefgh12==", "X-Api-Key: 12345678", "https://h", "-H", "-", "\t", "x"],
    "curl-auth-user": ["curl", " ", "\n", "\r\n", "\n\n", "\r", " -u ", "--user=", '"', "'", "bob:secret", "bob", ":", "pa ss", "${X}", "\t", "-u", "x"],
}


def texts(rule, n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = rng.choices(PIECES[rule], k=rng.randrange(2, 40))
        if rule != "email" and rng.random() < 0.7:
            parts.insert(0, "curl ")
            parts.insert(rng.randrange(1, len(parts) + 1), rng.choice([' -H "Authorization: Basic abcdefgh12==" ', " --header 'X-Api-Key: 12345678'\n"] if "header" in rule else [" -u bob:secret ", '\n--user "bob:pa ss" ']))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("rule", list(PIECES))
def test_patterns_written_otherwise_find_the_same(spark, rule):
    row = ROWS[rule]
    rows = list(enumerate(texts(rule, 4000, 7)))
    sql = duckdb.connect()
    sql.execute("CREATE TABLE t (id INT, text VARCHAR)")
    sql.executemany("INSERT INTO t VALUES (?, ?)", rows)
    pattern = "'" + row[4].replace("'", "''") + "'"
    to = "'" + replacement_to_re2(row[8]) + "'"
    want = {i: (m, x, r) for i, m, x, r in sql.execute(f"SELECT id, regexp_matches(text, {pattern}), regexp_extract(text, {pattern}), regexp_replace(text, {pattern}, {to}, 'g') FROM t").fetchall()}
    java = F.lit(row[5])
    guard = F.col("text").rlike(R.GUARDS[rule]) if rule in R.GUARDS else F.lit(True)
    df = spark.createDataFrame(rows, "id int, text string")
    got = df.select("id", F.col("text").rlike(row[5]).alias("m"), guard.alias("g"), F.regexp_extract("text", row[5], 0).alias("x"), F.regexp_replace("text", java, F.lit(row[9])).alias("r")).collect()
    assert 200 < sum(m for m, *_ in want.values()) < 3800
    for r in got:
        text = rows[r.id][1]
        assert r.m == want[r.id][0] and (r.g or not r.m), text
        # a lazy pattern may end at another of several flags, where carriage returns stand alone
        if rule != "curl-auth-header" or not re.search(r"\r(?!\n)", text):
            assert (r.x, r.r) == want[r.id][1:], text


def hard_texts(row):
    """Repeats of a rule's own literals with what the parts of its pattern look for."""
    words = [k for k in row[11][:3]] or ["sgp_", "sk"]
    for w in words:
        for more in ("", " ", ".", "\r", "\n", "a\r", '"', "'", "=", ": ", "-", "_", "a.", " = ", "x" * 20, "0" * 16, "é", '="', "://a:", " -H ", "@"):
            yield w + more
            yield w.upper() + more


def test_time_of_each_rule(spark):
    """No rule takes long on 20 KB of repeats that are made to keep it busy."""
    jvm = spark.sparkContext._jvm
    slow = {}
    for row in ROWS.values():
        pattern = jvm.java.util.regex.Pattern.compile(row[5])
        guard = jvm.java.util.regex.Pattern.compile(row[12]) if row[12] else None
        for unit in [*hard_texts(row), "a.", "curl a\r", "a@", " ", "0"]:
            head = row[11][0] + " " if row[11] else ""
            text = head + unit * (20_000 // len(unit))
            began = time.time()
            if guard is None or guard.matcher(text).find():
                pattern.matcher(text).find()
            took = time.time() - began
            if took > 1:
                slow.setdefault(row[1], []).append((round(took, 2), unit))
    assert not slow, slow


def test_white_space_and_tags_in_a_time_that_follows_the_length(spark):
    from hushlake.operators import requests as Q

    n = 200_000
    rows = [(" " * n + "x",), ("x" + " " * n + "x",), ("<" * n,), ("<user_query>" * (n // 10),), ("<a" * n + ">",), ("a<b>" * n,)]
    df = spark.createDataFrame(rows, "t string")
    began = time.time()
    out = df.select(Q.trimmed(F.col("t")).alias("a"), Q.squeezed(F.col("t")).alias("b"), Q.query_tag(F.col("t")).alias("c")).collect()
    assert time.time() - began < 30
    assert out[0].a == "x" and out[1].b == "x x" and out[2].b == "<" * n and out[3].c == "" and out[4].b == "" and len(out[5].b) == 2 * n - 1


def test_squeezed_against_python(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices(["<", ">", "a", " ", "\n", "<>", "<b>", " ", "x<", "\x0b"], k=rng.randrange(30))),) for _ in range(2000)]
    from hushlake.operators import requests as Q

    out = spark.createDataFrame(rows, "t string").select("t", Q.squeezed(F.col("t")).alias("s"), Q.trimmed(F.col("t")).alias("w")).collect()
    for r in out:
        assert r.s == re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", r.t)).strip() and r.w == r.t.strip()


def test_the_tree_of_literals_is_halved_by_classes():
    """Of many first letters few are tried, and the longest word is found as it would be among all."""
    import random
    import re

    from hushlake.operators.detect import longest_word

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdefgh-]^.&[ é") for _ in range(rng.randint(1, 4))) for _ in range(300)})
    pattern = longest_word(words)
    assert max(map(len, re.findall(r"\(\?=\[((?:\\.|[^\]])*)\]", pattern))) > 6 and "|" not in re.sub(r"\(\?=.*", "", pattern.removeprefix("(?:"))
    for _ in range(500):
        text = "".join(rng.choice("abcdefgh-]^.&[ éz") for _ in range(6))
        m = re.match(pattern, text)
        assert (m[0] if m else "") == max((w for w in words if text.startswith(w)), key=len, default="")
