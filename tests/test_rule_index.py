"""Rule tables beyond the constant array, and literals read off patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hushlake.functions import rules as R
from hushlake.functions.literals import LONGEST, required_literals
from hushlake.operators import detect as D
from hushlake.operators.rule_index import indexed_findings, passes, reach
from tests.test_rules import BY_ID, POSITIVE, made_for

ORDER = ["id", "ord"]


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("abc", ["abc"]), ("(?i)Foo(bar|baz)", ["foobar", "foobaz"]), ("a*bcd", ["bcd"]), ("(?:abc)?", []), ("abc|x", []), ("abc|def", ["abc", "def"]),
        (r"\bsk-[a-z]{20}\b", ["sk-"]), ("x[0-9]{3}", []), (r"https?://", ["http://", "https://"]), (r"(?:ab){2,}c", ["abab"]), (r"\Qa.b\E", ["a.b"]),
        (r"\x41BC", ["abc"]), ("[Aa]bc", ["abc"]), ("[^a]bcd", ["bcd"]), ("(?P<n>tok)en", ["token"]), ("(abc", []), ("[", []), ("", []), (r"\pLabc", ["abc"]),
        ("(abc|abcd)e", ["abcde", "abce"]), ("ſabc", ["abc"]), ("q" * 100, ["q" * LONGEST]),
    ],
)
def test_required_literals(pattern, want):
    assert required_literals(pattern) == want


def test_literals_of_the_catalogue_are_held_by_every_match(spark):
    """Strings made for each pattern, and those that are known to match, hold a literal if there is any."""
    rng, found = random.Random(5), 0
    find = spark.sparkContext._jvm.java.util.regex.Pattern
    for row in R.builtin_rows():
        words = required_literals(row[4])
        found += bool(words)
        texts = [POSITIVE[row[1]]] if row[1] in POSITIVE else []
        texts += [made_for(row[4], rng) for _ in range(5)]
        for text in texts:
            match = find.compile(row[5]).matcher(text)
            if words and match.find():
                assert any(w in match.group().translate(str.maketrans(*R.FOLD)).lower() for w in words), (row[1], text)
    by_hand = sum(bool(row[11]) for row in R.builtin_rows())
    assert found >= 0.95 * by_hand


def test_random_patterns():
    rng = random.Random(11)

    def pattern(depth):
        kind = rng.randrange(7 if depth else 3)
        if kind < 3:
            return rng.choice(["a", "b", "cd", "-", "[ab]", "[a-d]", r"\d", ".", "abc", r"\."])
        if kind == 3:
            return f"(?:{pattern(depth - 1)}|{pattern(depth - 1)})"
        if kind == 4:
            return f"(?:{pattern(depth - 1)}){rng.choice(['?', '*', '+', '{2}', '{1,3}', '{0}', '{2,}'])}"
        return pattern(depth - 1) + pattern(depth - 1)

    held = 0
    for _ in range(3000):
        p = pattern(4)
        words = required_literals(p)
        held += bool(words)
        for _ in range(10):
            text = "".join(rng.choice("abcd-.1") for _ in range(14))
            m = re.search(p, text)
            assert not (m and words) or any(w in m[0] for w in words), (p, words, text)
        made = made_for(p, rng)
        m = re.search(p, made)
        assert not (m and words) or any(w in m[0] for w in words), (p, words, made)
    assert held > 500


def rows(df):
    return [tuple(r) for r in df.orderBy(*ORDER).collect()]


def test_index_equals_array_on_the_catalogue(spark):
    """The same matches, whatever the number of passes; null and empty texts, repeated rows and other columns of clashing names do no harm."""
    rng = random.Random(3)
    made = [made_for(row[4], rng) for row in R.builtin_rows()]
    texts = [*POSITIVE.values(), *made, *(" and ".join(made[n : n + 40]) for n in range(0, 240, 40)), "", None, "plain", "x" * 200_000 + POSITIVE["email"]]
    df = spark.createDataFrame([(n, t, "r", 1) for n, t in enumerate([*texts, texts[0]])], "id long, body string, rule string, ord long").drop("ord")
    rules = R.builtin_rules(spark)
    want = rows(D.findings(df, rules, ["id"], "body"))
    assert len(want) > 228
    assert rows(indexed_findings(df, rules, ["id"], "body")) == want
    assert rows(indexed_findings(df, rules, ["id"], "body", most=100, most_bytes=20_000)) == want
    assert rows(indexed_findings(df, rules, ["id"], "body", modes=["track"])) == rows(D.findings(df, rules, ["id"], "body", ["track"]))
    assert rows(indexed_findings(df, rules.limit(0), ["id"], "body")) == [] and rows(indexed_findings(df.limit(0), rules, ["id"], "body")) == []


def test_fifty_thousand_rules(spark):
    """More rules than one array takes: each text gives the rules whose key it holds, among them one without and one with null literals."""
    rows_ = [R.rule_row(n, f"k{n}", f"k{n}", "", rf"\bkey-{n}\b", "low", "track", "", "") for n in range(50_000)]
    rows_ += [R.rule_row(50_000, "digits", "digits", "", r"\d{9}", "low", "track", "", "", []), (*R.rule_row(50_001, "null", "null", "", "zz", "low", "track", "", "")[:11], None, "")]
    rules = spark.createDataFrame(rows_, R.SCHEMA)
    texts = [f"key-{n} Key-7 key-{n}x key-{n + 1}" for n in range(0, 50_000, 2_500)] + ["123456789", "fizz", "key-", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id, r.rule_id) for r in D.findings(df, rules, ["id"]).collect()}
    want = {(i, f"k{m}") for i, n in enumerate(range(0, 50_000, 2_500)) for m in (n, n + 1)} | {(20, "digits"), (21, "null")}
    assert got == want


def test_passes_keep_to_their_limits(spark):
    rules = R.builtin_rules(spark)
    ends = list(passes(rules, 50, 1 << 30))
    assert [e[0] for e in ends] == [0, 50, 100, 150, 200] and ends[-1][1] == 227
    assert len(list(passes(rules, 50, 1))) == 228 and not list(passes(rules.limit(0), 50, 1))


def test_custom_rules_get_literals():
    row = R.rule_row(0, "x", "x", "", r"(?i)corp-[0-9]{8}", "high", "block", "", "")
    assert row[11] == [f"corp-{n}" for n in range(10)] and BY_ID["email"][11] == ["@"]


def test_unknown_validators_are_refused(spark):
    """A rule whose validator does not exist would fire unchecked."""
    rules = spark.createDataFrame([R.rule_row(0, "x", "x", "", r"\d{8}", "high", "block", "", "mod-97")], R.SCHEMA)
    df = spark.createDataFrame([(1, "12345678")], "id long, text string")
    for find in (D.findings, indexed_findings):
        with pytest.raises(ValueError, match="mod-97"):
            find(df, rules, ["id"])


def test_short_rules_run_on_pieces(spark):
    """Rules of short reach give what they give over whole texts: ends of the text, borders of pieces, case, snippets, repeated rows and rules."""
    words = ["^start", "end$", r"(?:^|\s)alpha(?:\s|$)", r"(?i)\bBeta\b", "gamma|delta", "two words", r"x\*y", r"(?:^|\s)x\*y(?:\s|$)", "ΟΔΟΣ", "[ab]cdef", "ſtrong", "zz top", r"🙂smile", "(?s)q.uvw"]
    made = [R.rule_row(n, f"r{n}", f"n{n}", "", p, "low", "track", "", "") for n, p in enumerate([*words, words[2], r"a+bcd", "token=[a-z]{3,}"])]
    made.append(made[3])
    rules = spark.createDataFrame(made, R.SCHEMA)
    held = {r.rule_id: r.n for r in rules.select("rule_id", reach(F.col("pattern_java")).alias("n")).collect()}
    assert all(held[f"r{n}"] for n in range(len(words))) and held["r15"] is None and held["r16"] is None
    rng = random.Random(1)
    hits = ["start", "end", "alpha", "xalpha", "BETA", "betas", "gamma", "two words", "two\nwords", "x*y", "οδος", "ΟΔΟΣ", "ΟΔΟΣΑ", "acdef", "strong", "ſtrong", "zz top", "q\nuvw", "aabcd", "token=abcd", "y" * 90, "  "]
    texts = [*hits, "", None, "startend", "alpha", *(" ".join(rng.choice(hits) for _ in range(rng.choice([3, 30, 120]))) for _ in range(60)), "start" + "-" * 700 + "end", "w" * 300 + " alpha " + "w" * 300, "w" * 200 + "🙂smile"]
    texts += ["z" * n + " alpha Beta " + "v" * 150 for n in range(100, 140)]
    df = spark.createDataFrame([(n // 2, t) for n, t in enumerate([*texts, *texts])], "id long, text string")
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(r) for r in D.findings(df, rules, ["id"]).collect()), key=key)
    assert len(want) > 300 and sorted((tuple(r) for r in indexed_findings(df, rules, ["id"]).collect()), key=key) == want


def word_rules():
    words = ["alpha", "Alpha", "x*y", "a", "🙂smile", "ΟΔΟΣ", "w" * 31, "-", "be.ta", "alphabet"]
    return [R.rule_row(n, f"r{n}", f"n{n}", "", rf"(?:^|\s){re.escape(w)}(?:\s|$)", "low", "track", "", "", [w.lower()]) for n, w in enumerate([*words, words[0]])]


def test_word_rules_equal_the_array(spark):
    """Words at the ends of texts and of pieces, all white space, case, parts of words, repeated words, rows and rules."""
    rules = spark.createDataFrame(word_rules(), R.SCHEMA)
    rng = random.Random(4)
    hits = ["alpha", "Alpha", "ALPHA", "alphas", "xalpha", "x*y", "a", "🙂smile", "ΟΔΟΣ", "οδος", "w" * 31, "w" * 32, "w" * 200, "-", "be.ta", "beta", "alphabet", "alpha\x0balpha", "", "q"]
    texts = [None, "", " ", "alpha", " alpha", "alpha ", "\talpha\n", "alpha\x0b", "\x0balpha", "alpha,alpha alpha", *("z" * n + " alpha " + "v" * 300 + " Alpha" for n in range(90, 170)), *("z " * 60 + "y" * n + " " + "w" * 31 for n in range(12))]
    texts += ["".join(rng.choice(hits) + rng.choice([" ", "  ", "\t", "\n", "\r\n", "\f"]) for _ in range(rng.choice([2, 20, 90]))).replace("🙂smile", "q") for _ in range(80)]
    texts += ["q" * n + " 🙂smile" for n in (0, 1, 126, 127, 128, 129)]
    df = spark.createDataFrame([(n // 2, t) for n, t in enumerate([*texts, *texts[:20]])], "id long, text string")
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(r) for r in D.findings(df, rules, ["id"]).collect()), key=key)
    assert {r[2] for r in want} == {f"r{n}" for n in range(11)} and len(want) > 500
    assert sorted((tuple(r) for r in indexed_findings(df, rules, ["id"]).collect()), key=key) == want


def test_word_rules_move_words_and_no_texts(spark):
    """Pieces moved with each of their words took 22 times the input on disk."""
    df = spark.createDataFrame([(1, "alpha beta")], "id long, text string")
    found = indexed_findings(df, spark.createDataFrame(word_rules(), R.SCHEMA), ["id"]).groupBy("id").agg(F.min("start"))
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"\) (?:BroadcastExchange|Exchange)\nInput \[\d+\]: \[(.*)\]", plan)
    assert any("_word" in c for c in moved) and not [c for c in moved if re.search(r"\b(_piece|_text|text|_cores|snippet)#", c)], moved
