import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushlake.operators import requests as Q
from hushlake.operators.json_reader import read_json


def parsed(spark, *bodies):
    df = spark.createDataFrame(list(enumerate(b if b is None or isinstance(b, str) else json.dumps(b) for b in bodies)), "id int, body string")
    return [r.request for r in Q.parse_request(df).orderBy("id").collect()]


def test_chat_with_string_and_parts(spark):
    a, b = parsed(
        spark,
        {"model": "m1", "stream": True, "messages": [{"role": "system", "content": "be kind"}, {"role": "user", "content": " hello  <b>there</b> "}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "what is this"}, {"type": "image_url", "image_url": {"url": "x"}}]}]},
    )
    assert (a.model, a.streaming, a.prompts, a.user_query, a.background) == ("m1", True, ["be kind", "hello there"], "hello there", False)
    assert b.prompts == ["what is this"] and b.user_query == "what is this" and b.model == ""


def test_current_turn_and_history(spark):
    (r,) = parsed(spark, {"system": "sys", "messages": [
        {"role": "user", "content": "old question"}, {"role": "assistant", "content": "old answer"}, {"role": "user", "content": "new question"}, {"role": "tool", "content": None}]})
    assert r.prompts == ["sys", "new question"] and r.full_body == ["sys", "old question", "old answer", "new question"] and r.user_query == "new question"
    (r,) = parsed(spark, {"messages": [{"role": "system", "content": "late system"}, {"role": "assistant", "content": "x"}]})
    assert r.prompts == [] and r.full_body == ["late system", "x"]


def test_tool_results_nest(spark):
    inner = [{"type": "text", "text": "deep"}, {"type": "tool_result", "content": [{"type": "text", "text": "deeper"}]}]
    (r,) = parsed(spark, {"system": [{"type": "text", "text": "block system"}], "messages": [{"role": "user", "content": [
        {"type": "tool_result", "content": "plain"}, {"type": "tool_result", "content": inner}, {"type": "tool_use", "input": {"a": "skipped"}}, {"type": "text", "text": "ask"}]}]})
    assert r.prompts == ["block system", "plain", "deep", "deeper", "ask"] and r.user_query == "ask"
    for depth in (1, 2, 7, 300):
        for _ in range(depth):
            inner = [{"type": "text", "text": f" before {depth} "}, {"type": "tool_result", "content": inner}]
        messages = [{"role": "user", "content": "x"}, {"role": "assistant", "content": inner}, {"role": "user", "content": inner}, {"role": "user", "content": "last"}]
        (r,) = parsed(spark, {"system": "s", "messages": messages})
        assert r.prompts[0] == "s" and r.prompts[-1] == "last" and r.prompts[-3:-1] == ["deep", "deeper"] and f"before {depth}" in r.prompts and r.full_body[1] == "x", depth
    (r,) = parsed(spark, {"system": [{"type": "tool_result", "content": [{"type": "tool_result", "content": [{"type": "tool_result", "content": [{"type": "text", "text": 5}, 7, None]}]}]}], "messages": []})
    assert r.prompts == []


def test_tagged_query(spark):
    a, b, c = parsed(
        spark,
        {"messages": [{"role": "user", "content": "<context>c</context><user_query> the question </user_query>"}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "<x>files</x>"}, {"type": "text", "text": "<user_query>in blocks\nof two lines</user_query>"}]}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "<x>one</x>"}, {"type": "text", "text": "two"}]}]},
    )
    assert a.user_query == "the question" and b.user_query == "in blocks\nof two lines" and c.user_query == "one\n\ntwo"


def test_responses_api(spark):
    a, b = parsed(
        spark,
        {"instructions": "do it", "input": "a question"},
        {"instructions": "do it", "input": [
            {"role": "user", "content": [{"type": "input_text", "text": "first"}]}, {"role": "assistant", "content": [{"type": "output_text", "text": "said"}]},
            {"role": "user", "content": [{"type": "input_text", "text": "second"}]}, {"type": "function_call", "name": "f"}, {"type": "function_call_output", "output": " result "}]},
    )
    assert a.prompts == ["do it", "a question"] and a.user_query == "a question"
    assert b.prompts == ["do it", "result"] and b.full_body == ["do it", "first", "second", "result"] and b.user_query == "second"


def test_legacy_session_background_and_bad_bodies(spark):
    rows = parsed(
        spark, {"prompt": "complete me"}, {"metadata": {"user_id": '{"session_id": "s-1", "x": 2}'}, "prompt": "p"}, {"messages": [{"role": "user", "content": " Summarize the following text"}]},
        "not json", None, "", "[1]", {"model": 5, "prompt": "x"}, {"messages": "no list", "prompt": "x"}, {"messages": [{"role": 1}], "prompt": "x"}, {"metadata": {"user_id": "no json"}},
    )
    assert rows[0].prompts == ["complete me"] and rows[0].user_query == "complete me" and rows[1].session_id == "s-1" and rows[2].background
    for r in rows[3:10]:
        assert (r.model, r.prompts, r.full_body, r.user_query, r.background) == ("", [], [], "", False)
    assert rows[10].session_id == ""


SAID = '"messages":[{"role":"user","content":"my number"}]'
ODD = [
    '{"x":1,"x":2,%s}' % SAID, '{"messages":[{"role":"user","content":"old"}],%s}' % SAID, '{"x":%s,%s}' % ("1" * 5000, SAID), '{"x":1.%se5,%s}' % ("1" * 1500, SAID), '{"%s":1,%s}' % ("k" * 60_000, SAID),
    '{"x":%s%s,%s}' % ("[" * 1200, "]" * 1200, SAID), '{"x":%s1%s,%s}' % ('{"a":' * 100_000, "}" * 100_000, SAID), ' \t\n{"x":1,"x":{"y":1,"y":"\\ud800"},%s}' % SAID,
]


def test_bodies_that_variant_refuses(spark):
    deep = '"my number"'
    for _ in range(2000):
        deep = '[{"type":"text","text":5},{"type":"tool_result","content":%s}]' % deep
    rows = parsed(spark, *ODD, '{"messages":[{"role":"user","content":%s}],"x":1,"x":2}' % deep)
    assert [r.prompts for r in rows] == [["my number"]] * len(ODD) + [["5", "my number"]] and not any(r.unread for r in rows)
    assert [r.user_query for r in rows] == ["my number"] * len(ODD) + ["5"]


def test_fields_of_odd_bodies_are_those_of_plain_ones(spark):
    bodies = [
        {"model": "m", "stream": True, "metadata": {"user_id": '{"session_id":"s"}'}, "system": [{"type": "text", "text": "sys"}], "messages": [
            {"role": "user", "content": [{"type": "text", "text": "<user_query>q</user_query>"}, {"type": "image", "source": {"a": [1]}}]}, {"role": "assistant", "content": "a"},
            {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "r"}, {"type": "tool_result", "content": "rr"}]}, {"type": "text", "text": "ask"}, 7, None]}]},
        {"instructions": "do", "input": [{"role": "user", "content": [{"type": "input_text", "text": "first"}]}, {"type": "function_call", "name": "f"}, {"type": "function_call_output", "output": " out "}, "x", {"role": "user", "content": "no parts"}]},
        {"instructions": "do", "input": "asked"}, {"prompt": "legacy"}, {"model": 5, "prompt": "x"}, {"messages": {"role": "user"}}, {"messages": [{"role": 1}]}, {"messages": ["x"], "prompt": "y"}, {"metadata": "m", "prompt": "x"},
        {"stream": 1, "prompt": "x"}, {"metadata": {"user_id": 5}}, {"messages": None, "input": None, "system": None, "prompt": "p"}, {"messages": [{"role": "user", "content": " Summarize the following x"}]}, {},
    ]
    plain = parsed(spark, *bodies)
    odd = parsed(spark, *[json.dumps(b)[:-1] + (", " if b else "") + '"zz": 1, "zz": 2}' for b in bodies])
    assert odd == plain


def test_unread_bodies(spark):
    rows = parsed(spark, "no json", '{"messages": [', "[1]", '"text"', '{"x":1 "x":2}', None, "", "  ", "{}", '{"model": 5}')
    assert [r.unread for r in rows] == [True] * 5 + [False] * 4 + [True]


@settings(deadline=None, max_examples=300)
@given(st.recursive(st.none() | st.booleans() | st.text() | st.integers() | st.floats(allow_nan=False, allow_infinity=False), lambda x: st.lists(x) | st.dictionaries(st.text(), x)))
def test_reader_reads_what_json_reads(value):
    text = json.dumps(value, indent=1)
    assert read_json(text) == json.loads(text, parse_int=lambda _: 0, parse_float=lambda _: 0)


@settings(deadline=None, max_examples=500)
@given(st.lists(st.sampled_from(['"a"', '"b"', ":", ",", "{", "}", "[", "]", "1", "true", "null", " ", "x", '"', "-", "01", "1.", "\\u0041"]), max_size=12).map("".join))
def test_reader_refuses_what_json_refuses(text):
    def read(f):
        try:
            return [f(text)]
        except ValueError:
            return None

    assert read(read_json) == read(lambda t: json.loads(t, parse_int=lambda _: 0, parse_float=lambda _: 0))


def test_clean_texts(spark):
    df = spark.createDataFrame([(["<a>x</a>  y", "x y", "", "<br/>", "z\n\tz", None],)], "t array<string>")
    assert df.select(Q.clean_texts(F.filter("t", lambda x: x.isNotNull())).alias("t")).first().t == ["x y", "z z"]


HOSTS = {
    "api.openai.com": True, "api.openai.com:443": True, "api.anthropic.com": True, "claude.ai": True, "notclaude.ai": True, "x.githubcopilot.com": True, "api.githubcopilot.com:8443": True,
    "copilot-proxy.githubusercontent.com": True, "openai.com": False, "example.com": False, "api.openai.com.evil.test": False, "": False, None: False,
}


def test_hosts(spark):
    df = spark.createDataFrame(list(HOSTS.items()), "host string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", Q.is_target_host(F.col("host"))).collect())


def test_telemetry(spark):
    body = {"writeKey": "k", "batch": [
        {"event": "open", "context": {"traits": {"email": "a@b.example", "ip": ""}}}, {"event": "close", "context": {"traits": {"name": "x", "userId": None}}}, {"event": "open"}, {"type": "page"}]}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, '{"writeKey": "", "batch": [1]}'), (3, '{"writeKey": "k", "batch": []}'), (4, "x"), (5, None)], "id int, body string")
    rows = df.select("id", Q.is_telemetry(F.col("body")).alias("t"), Q.telemetry_summary(F.col("body")).alias("s")).orderBy("id").collect()
    assert [r.t for r in rows] == [True, False, False, False, False] and rows[0].s == "Events: open, close | PII fields: email, name" and rows[3].s == "Events: "


def test_sessions_and_clients(spark):
    rows = [
        ({"Vscode-Sessionid": "v", "User-Agent": "Code/1.2 linux"}, "b"), ({"x-client-session-id": "c", "Copilot-Integration-Id": "cli", "User-Agent": "a"}, ""),
        ({"X-Client-Session-Id": "c", "User-Agent": "agent/2 x"}, ""), ({"User-Agent": "tool/3 y"}, "body"), ({"User-Agent": "tool"}, ""), (None, "body"), ({"User-Agent": " lead"}, "s"),
    ]
    df = spark.createDataFrame([(n, h, s) for n, (h, s) in enumerate(rows)], "id int, headers map<string,string>, s string")
    got = Q.session_and_client(df, session=F.col("s")).orderBy("id").collect()
    assert [(r.session_id, r.client) for r in got] == [("v", "Code/1.2"), ("c", "cli"), ("c", "agent/2"), ("body", "tool/3"), ("", ""), ("body", ""), ("s", " lead")]


def response(spark, body):
    df = spark.createDataFrame([(body,)], "b string")
    u = Q.usage(F.col("b"))
    r = df.select(Q.response_text(F.col("b")).alias("t"), u.input_tokens.alias("i"), u.output_tokens.alias("o")).first()
    return r.t, r.i, r.o


def sse(*events):
    return "\n\n".join(f"data: {json.dumps(e)}" for e in events) + "\n\ndata: [DONE]\n"


def test_plain_responses(spark):
    body = {"content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "ls", "input": {"p": 1}}, {"type": "tool_use", "name": "pwd", "input": None}], "usage": {
        "input_tokens": 3, "cache_read_input_tokens": 4, "cache_creation_input_tokens": 5, "output_tokens": 6}}
    assert response(spark, json.dumps(body)) == ('hi\n[Tool: ls]\n{"p":1}\n\n[Tool: pwd]\n', 12, 6)
    body = {"choices": [{"message": {"content": "yes", "tool_calls": [{"function": {"name": "f", "arguments": "{}"}}]}}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}}
    assert response(spark, json.dumps(body)) == ("yes\n[Tool: f]\n{}\n", 7, 2)
    assert response(spark, None) == ("", 0, 0) and response(spark, "no json\nat all") == ("", 0, 0)


def test_streams(spark):
    delta = lambda n, **d: {"type": "content_block_delta", "index": n, "delta": d}
    text = sse(
        {"type": "message_start", "message": {"usage": {"input_tokens": 10, "cache_read_input_tokens": 5}}}, delta(0, type="text_delta", text="Hello "), delta(0, type="text_delta", text="you"),
        {"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "name": "grep"}}, delta(1, type="input_json_delta", partial_json='{"q":'),
        delta(1, type="input_json_delta", partial_json='"x"}'), {"type": "content_block_stop", "index": 1}, {"type": "content_block_stop", "index": 7},
        delta(2, type="input_json_delta", partial_json="lost"), {"type": "message_delta", "usage": {"output_tokens": 9}},
    )
    assert response(spark, text) == ('Hello you\n[Tool: grep]\n{"q":"x"}\n', 15, 9)
    assert response(spark, sse({"choices": [{"delta": {"content": "a"}}]}, {"choices": [{"delta": {"content": "b", "tool_calls": [{"function": {"arguments": "{1}"}}]}}]})) == ("ab{1}", 0, 0)
    assert response(spark, sse({"type": "response.output_text.delta", "delta": "one "}, {"type": "response.text.delta", "delta": "two"}, {"type": "done", "response": {"usage": {
        "input_tokens": 4, "cache_read_input_tokens": 100, "output_tokens": 3}}})) == ("one two", 4, 3)
