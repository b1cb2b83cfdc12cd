from pyspark.sql import functions as F

from hushlake.functions import rules as R
from hushlake.operators import detect as D
from hushlake.operators.bodies import redact_bodies, text_leaves


def one(df):
    return df.first()


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_snippet_and_start(spark):
    text = "x" * 30 + " 123-45-6789 " + "y" * 30
    m = one(D.findings(frame(spark, text), R.builtin_rules(spark), ["id"]).where("rule_id = 'ssn'"))
    assert m.start == 32 and m.snippet == "…" + "x" * 19 + " 123-45-6789 " + "y" * 19 + "…"
    m = one(D.findings(frame(spark, "123-45-6789"), R.builtin_rules(spark), ["id"]))
    assert m.start == 1 and m.snippet == "123-45-6789"


def test_first_valid_card_counts(spark):
    text = "4111111111111112 then 4111111111111111"
    m = one(D.findings(frame(spark, text), R.builtin_rules(spark), ["id"]))
    assert m.rule_id == "credit-card" and m.start == 23
    out = one(D.redact_text(frame(spark, text), R.builtin_rules(spark), agent_mode=True))
    assert out.redacted == "4111111111111112 then [REDACTED]"


def test_redaction_is_an_ordered_fold(spark):
    rules = spark.createDataFrame([
        R.rule_row(1, "b", "b", "", r"\[REDACTED\]!", "low", "track", "second", "", []), R.rule_row(0, "a", "a", "", "secret", "low", "track", "[REDACTED]", "", ["secret"]),
        R.rule_row(2, "c", "c", "", "never", "low", "redact", "x", "", []),
    ], R.SCHEMA)
    row = one(D.redact_text(frame(spark, "a secret! and secret, never"), rules))
    assert row.redacted == "a second and [REDACTED], x" and [m.rule_id for m in row.redactions] == ["a", "b", "c"]


def test_groups_keep_key_and_quote(spark):
    rules = R.builtin_rules(spark).where("rule_id = 'generic-secret'")
    row = one(D.redact_text(frame(spark, 'set password = "abcdefgh12" now'), rules, agent_mode=True))
    assert row.redacted == 'set password = "[REDACTED]" now'


def test_sonar_secret_is_replaced_whole(spark):
    text = "sonar_token = squ_" + "a" * 40 + " end"
    row = one(D.redact_text(frame(spark, text), R.builtin_rules(spark), agent_mode=True))
    assert "aaaa" not in row.redacted


def test_scan_status_and_modes(spark):
    rows = D.scan_text(frame(spark, "123-45-6789 a@b.example", "a@b.example", "nothing", None, ""), R.builtin_rules(spark)).orderBy("id").collect()
    assert [r.status for r in rows] == ["blocked", "redacted", "clean", "clean", "clean"]
    assert [m.rule_id for m in rows[0].matches] == ["ssn", "email"] and rows[0].redacted == "123-45-6789 [REDACTED]"
    agent = D.scan_text(frame(spark, "123-45-6789"), R.builtin_rules(spark), agent_mode=True).first()
    assert agent.status == "redacted" and agent.redacted == "[REDACTED]"
    severities = D.detect(frame(spark, "123-45-6789 a@b.example", "a@b.example", "x"), R.builtin_rules(spark)).orderBy("id").select(D.max_severity(F.col("matches")).alias("s")).collect()
    assert [r.s for r in severities] == ["high", "low", ""]


def test_long_text_does_not_break_the_matcher(spark):
    words = "lorem key token password secret curl data: kind " * 4000
    assert D.scan_text(frame(spark, words), R.builtin_rules(spark)).first().status == "clean"


def test_bodies(spark):
    body = '{"model": "123-45-6789", "n": 1.50, "messages": [{"role": "user", "content": [{"type": "text", "text": "my 123-45-6789 <b>"}]}], "ok": true, "x": null, "signature": "123-45-6789"}'
    rows = spark.createDataFrame([(0, body), (1, "plain 123-45-6789"), (2, '{"a": "clean"}'), (3, None), (4, '"123-45-6789"')], "id int, body string")
    out = {r.id: r.redacted_body for r in redact_bodies(rows, R.builtin_rules(spark), block=True).collect()}
    assert out[0] == body.replace("my 123-45-6789", "my [REDACTED]")
    assert out[1] == "plain [REDACTED]" and out[2] == '{"a": "clean"}' and out[3] == "" and out[4] == '"[REDACTED]"'
    leaves = text_leaves(rows.where("id = 0"), ["id"]).collect()
    assert [(r.field, r.text) for r in leaves] == [("text", "my 123-45-6789 <b>")]


def test_bodies_keep_what_is_no_text(spark):
    ssn = "123-45-6789"
    bodies = [
        '{"a": 1e400, "b": 1.50, "b": 12345678901234567890.123456789, "text": "%s", "k": "\\ud83d\\ude00"}', '{"text":\t["%s", {"x": "%s", "output": "\\n %s"}, ["%s"]], "n": NaN}',
        '{"content": "\\ud800 %s", "x\\"y": "%s"}', '[{"text" : "a \\"%s\\" \\\\"}, "%s"]', '"%s"', "%s {", '{"prompt": {"deep": "%s", "input": [[["%s"]]]}}',
    ]
    rows = spark.createDataFrame([(n, b.replace("%s", ssn)) for n, b in enumerate(bodies)], "id int, body string")
    out = {r.id: r.redacted_body for r in redact_bodies(rows, R.builtin_rules(spark), block=True).collect()}
    red = "[REDACTED]"
    assert out[0] == bodies[0] % red and out[1] == bodies[1].replace("%s", red)  # NaN is no JSON: the whole body is a text
    assert out[2] == '{"content": "? [REDACTED]", "x\\"y": "123-45-6789"}' and out[3] == '[{"text" : "a \\"[REDACTED]\\" \\\\"}, "123-45-6789"]'
    assert out[4] == f'"{red}"' and out[5] == f"{red} {{" and out[6] == '{"prompt": {"deep": "123-45-6789", "input": [[["[REDACTED]"]]]}}'
    shared = '{"messages": [{"content": "password ="}, {"content": "abcdefgh12"}, {"content": "my %s"}]}' % ssn
    rows = spark.createDataFrame([(0, shared), (1, shared.replace("password", "word")), (2, "x"), (3, None)], "id int, body string")
    out = [r.redacted_body for r in redact_bodies(rows, R.builtin_rules(spark), block=True, sure=True).orderBy("id").collect()]
    assert out == ["", shared.replace("password", "word").replace(ssn, red), "x", ""]


def test_long_bodies_are_read_in_a_time_that_follows_their_length():
    import time

    from hushlake.operators.bodies import text_places

    for body in ('{"text": "' + "a" * 2_000_000 + '"}', "[" * 900 + "]" * 900, '{"a":"' + "\\\\" * 500_000 + '"}', '[' + '"x",' * 300_000 + "1]", "[" * 200_000, '"' * 300_001):
        began = time.process_time()
        text_places(body)
        assert time.process_time() - began < 3
