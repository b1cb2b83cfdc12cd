"""Logged LLM requests and responses flattened to text, natively over VARIANT and nested arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.operators.detect import let
from hushlake.operators.json_reader import PII_KEYS, slimmed

#: Tool results nest without limit. Expressions read them to this depth; of bodies with deeper ones another reader flattens them.
DEPTH = 1

# Fixed values.
TARGET_SUFFIXES = [
    "api.openai.com", "api.anthropic.com", "api.githubcopilot.com", "copilot-proxy.githubusercontent.com", ".githubcopilot.com", ".openai.com", ".anthropic.com", "claude.ai",
]
BACKGROUND_STARTS = ["Summarize the following", "Please write a brief title", "Please generate exactly"]


def no_texts() -> Column:
    return F.array().cast("array<string>")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++\z", "")


def squeezed(text: Column) -> Column:
    """Tags and white space become single spaces, and none at the ends. What follows the last > holds no tag."""

    def of(t: Column, tail: Column) -> Column:
        tags = F.regexp_replace(F.left(t, F.length(t) - F.length(tail)), "<[^>]++>", " ")
        return F.trim(F.regexp_replace(F.concat(tags, tail), r"(?U)\s++", " "))

    return let(text, lambda t: let(F.substring_index(t, ">", -1), lambda tail: of(t, tail)))


def clean_texts(texts: Column) -> Column:
    """Squeezed texts without empty ones and repeats; the first of equals stays."""
    return F.array_distinct(F.filter(F.transform(texts, squeezed), lambda t: t != ""))


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _unless_empty(text: Column) -> Column:
    return F.filter(F.array(text), lambda t: t != "")


def _blocks(content: Column) -> Column:
    return F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>"))


def content_texts(content: Column, depth: int = DEPTH) -> Column:
    """Texts of a content field: a string, or blocks, of which text blocks and tool results count."""

    def of_block(b: Column) -> Column:
        out = F.when(_text(b, "$.type") == "text", _unless_empty(trimmed(_text(b, "$.text"))))
        if depth > 0:
            out = out.when(_text(b, "$.type") == "tool_result", content_texts(F.try_variant_get(b, "$.content", "variant"), depth - 1))
        return out.otherwise(no_texts())

    def of(c: Column) -> Column:
        texts = F.when(_kind(c) == "STRING", _unless_empty(trimmed(_text(c, "$"))))
        return texts.when(_kind(c).startswith("ARRAY"), F.flatten(F.transform(_blocks(c), of_block))).otherwise(no_texts())

    return let(content, of)


def nests_deeper(content: Column, depth: int = DEPTH) -> Column:
    """Whether a content field has tool results that lie too deep for content_texts."""
    result = lambda b: _text(b, "$.type") == "tool_result"
    if depth == 0:
        return F.exists(_blocks(content), result)
    return F.exists(_blocks(content), lambda b: result(b) & nests_deeper(F.try_variant_get(b, "$.content", "variant"), depth - 1))


def readable(df: DataFrame, body_col: str = "body", out_col: str = "readable") -> DataFrame:
    """``df`` with ``out_col``: a body that VARIANT and the expressions here can read.

    That is the body itself for nearly all rows. Bodies that VARIANT refuses though they hold an object (double keys, long
    numbers or keys, great depth), and those with tool results deeper than expressions go, are cut down to their used fields by
    ``slimmed`` (one Arrow pass, which gets a null for all others). Null where no reader finds an object.
    """
    rows = df.withColumn("_v", F.try_parse_json(body_col))
    v = F.col("_v")
    field = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    messages = F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.array().cast("array<variant>"))
    deep = nests_deeper(field("system")) | F.exists(messages, lambda m: nests_deeper(F.try_variant_get(m, "$.content", "variant")))
    refused = v.isNull() & F.ltrim(F.col(body_col)).rlike(r"\A\s*\{")
    rows = rows.withColumn("_slim", slimmed(F.when(refused | F.coalesce(deep, F.lit(False)), F.col(body_col))))
    whole = F.when(_kind(v).startswith("OBJECT"), F.col(body_col))
    return rows.withColumn(out_col, F.coalesce("_slim", whole)).drop("_v", "_slim")


def query_tag(text: Column) -> Column:
    """What stands between the first <user_query> and the next </user_query>, trimmed; empty without such a pair."""
    start, end = "<user_query>", "</user_query>"
    inner = lambda rest: F.when(F.contains(rest, F.lit(end)), trimmed(F.substring_index(rest, end, 1))).otherwise("")
    return let(text, lambda t: F.when(F.contains(t, F.lit(start)), let(F.substring(t, F.instr(t, start) + len(start), F.length(t)), inner)).otherwise(""))


def query_of_string(text: Column) -> Column:
    return let(query_tag(text), lambda q: F.when(q != "", q).otherwise(squeezed(text)))


def query_of_content(content: Column) -> Column:
    """The first tagged query of a content field, or else its stripped text blocks, joined by blank lines."""
    texts = F.transform(F.filter(_blocks(content), lambda b: _text(b, "$.type") == "text"), lambda b: _text(b, "$.text"))

    def of(ts: Column) -> Column:
        tagged = F.filter(F.transform(ts, query_tag), lambda t: t != "")
        plain = F.array_join(F.filter(F.transform(ts, squeezed), lambda t: t != ""), "\n\n")
        return F.coalesce(F.get(tagged, F.lit(0)), plain)

    return F.when(_kind(content) == "STRING", query_of_string(_text(content, "$"))).when(_kind(content).startswith("ARRAY"), let(texts, of)).otherwise("")


def _last(items: Column, test) -> Column:
    """Position of the last item that passes, from 0; -1 without one."""
    return F.coalesce(F.array_max(F.transform(items, lambda x, i: F.when(test(x), i))), F.lit(-1))


def _after(items: Column, position: Column) -> Column:
    return F.filter(items, lambda _, i: i > position)


def parse_request(df: DataFrame, body_col: str = "body", readable_col: str | None = None) -> DataFrame:
    """``df`` with request: struct<model, streaming, session_id, prompts, full_body, user_query, background, unread>.

    prompts are the texts of the current turn (after the last assistant message), full_body those of all turns, both
    cleaned. Bodies are read by ``readable``, or come from it in ``readable_col``. A null body, one that is no JSON object, or one with a used
    field of another type gives empty fields; unread says that there was something in it.
    """
    rows = df if readable_col else readable(df, body_col, "_r")
    rows = rows.withColumn("_v", F.try_parse_json(readable_col or "_r"))
    v = F.col("_v")
    field = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    is_type = lambda name, *kinds: _kind(field(name)).isin("VOID", *kinds)
    is_list = _kind(field("messages")).startswith("ARRAY") | (_kind(field("messages")) == "VOID")
    messages = F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.array().cast("array<variant>"))
    right = F.forall(messages, lambda m: _kind(m).startswith("OBJECT") & _kind(F.try_variant_get(m, "$.role", "variant")).isin("VOID", "STRING"))
    meta = _kind(field("metadata"))
    ok = (
        _kind(v).startswith("OBJECT") & is_list & right & is_type("model", "STRING") & is_type("stream", "BOOLEAN") & is_type("instructions", "STRING")
        & is_type("prompt", "STRING") & ((meta == "VOID") | meta.startswith("OBJECT")) & _kind(F.try_variant_get(v, "$.metadata.user_id", "variant")).isin("VOID", "STRING")
    )
    items = F.coalesce(F.try_variant_get(v, "$.input", "array<variant>"), F.array().cast("array<variant>"))
    rows = rows.withColumn("_v", F.when(F.coalesce(ok, F.lit(False)), v)).withColumns({"_m": messages, "_i": items})
    unread = v.isNull() & (F.coalesce(trimmed(F.col(body_col)), F.lit("")) != "")
    m, i = F.col("_m"), F.col("_i")
    role = lambda x: _text(x, "$.role")
    last_message = _last(m, lambda x: role(x) == "assistant")
    last_item = _last(i, lambda x: (role(x) == "assistant") | (_text(x, "$.type") == "function_call"))
    last_answer = _last(i, lambda x: role(x) == "assistant")
    rows = rows.withColumns({"_t": last_message, "_ti": last_item, "_ta": last_answer})

    content = lambda x: F.try_variant_get(x, "$.content", "variant")
    cleaned = lambda texts: F.filter(F.transform(texts, squeezed), lambda t: t != "")
    of_messages = F.transform(m, lambda x: content_texts(content(x)))
    # Each message's texts once: the current turn is a part of all turns.
    rows = rows.withColumns({"_mt": F.transform(of_messages, cleaned), "_st": content_texts(field("system"))})
    mt, system = F.col("_mt"), F.col("_st")
    parts = lambda x: F.filter(
        F.coalesce(F.try_variant_get(x, "$.content", "array<variant>"), F.array().cast("array<variant>")),
        lambda c: _text(c, "$.type").isin("input_text", "text") & (trimmed(_text(c, "$.text")) != ""),
    )
    of_items = lambda xs: F.flatten(F.transform(xs, lambda x: F.when(
        _text(x, "$.type") == "function_call_output", _unless_empty(trimmed(_text(x, "$.output")))
    ).otherwise(F.transform(parts(x), lambda c: trimmed(_text(c, "$.text"))))))
    has_input = _kind(field("input")) != "VOID"
    instructions = F.when(has_input, _unless_empty(_text(v, "$.instructions"))).otherwise(no_texts())
    as_string = _kind(field("input")) == "STRING"
    input_text = F.when(as_string, _unless_empty(_text(v, "$.input"))).otherwise(no_texts())
    legacy = _unless_empty(_text(v, "$.prompt"))
    turn = lambda messages, items: F.array_distinct(F.concat(
        cleaned(system), F.flatten(messages), cleaned(F.concat(instructions, input_text, of_items(items), legacy))))

    mine = F.filter(_after(m, F.col("_t")), lambda x: role(x) == "user")
    asked = F.filter(F.transform(mine, lambda x: query_of_content(content(x))), lambda q: q != "")
    asked_items = F.flatten(F.transform(
        F.filter(_after(i, F.col("_ta")), lambda x: role(x) == "user"), lambda x: F.transform(parts(x), lambda c: query_of_string(_text(c, "$.text")))
    ))
    queries = F.concat(asked, F.transform(input_text, query_of_string), asked_items)
    starts = lambda t: F.exists(F.array(*[F.lit(s) for s in BACKGROUND_STARTS]), lambda s: F.startswith(t, s))
    background = F.exists(mine, lambda x: (_kind(content(x)) == "STRING") & starts(trimmed(_text(x, "$.content"))))
    user_id = F.coalesce(F.try_variant_get(v, "$.metadata.user_id", "string"), F.lit(""))
    request = F.struct(
        _text(v, "$.model").alias("model"), F.coalesce(F.try_variant_get(v, "$.stream", "boolean"), F.lit(False)).alias("streaming"),
        _text(F.try_parse_json(user_id), "$.session_id").alias("session_id"), turn(_after(mt, F.col("_t")), _after(i, F.col("_ti"))).alias("prompts"), turn(mt, i).alias("full_body"),
        F.when(F.size(queries) > 0, F.array_join(queries, "\n\n")).otherwise(_text(v, "$.prompt")).alias("user_query"),
        F.coalesce(background, F.lit(False)).alias("background"), unread.alias("unread"),
    )
    # A struct out of a generator is computed once; out of a projection each of its fields would be, wherever it is used.
    return rows.select("*", F.explode(F.array(request)).alias("request")).drop("_r", "_v", "_m", "_i", "_t", "_ti", "_ta", "_mt", "_st")


def strip_port(host: Column) -> Column:
    return F.regexp_replace(host, r":\d+$", "")


def is_target_host(host: Column) -> Column:
    out = F.lit(False)
    for suffix in TARGET_SUFFIXES:
        out = out | strip_port(host).endswith(suffix)
    return F.coalesce(out, F.lit(False))


def is_telemetry(body: Column) -> Column:
    v = F.try_parse_json(body)
    key, batch = F.try_variant_get(v, "$.writeKey", "variant"), F.try_variant_get(v, "$.batch", "array<variant>")
    return F.coalesce((_kind(key) == "STRING") & (_text(v, "$.writeKey") != "") & (F.size(batch) > 0), F.lit(False))


def telemetry_summary(body: Column) -> Column:
    """``Events: a, b | PII fields: c``: distinct events as first seen, and which PII keys the traits hold, as first seen."""
    batch = F.coalesce(F.try_variant_get(F.try_parse_json(body), "$.batch", "array<variant>"), F.array().cast("array<variant>"))

    def of(items: Column) -> Column:
        events = F.array_distinct(F.filter(F.transform(items, lambda x: _text(x, "$.event")), lambda e: e != ""))
        held = lambda x: let(F.try_variant_get(x, "$.context.traits", "variant"), lambda t: F.filter(
            F.array(*[F.when(_text(t, f"$.{k}") != "", k) for k in PII_KEYS]), lambda k: k.isNotNull()))
        fields = F.array_distinct(F.flatten(F.transform(items, held)))
        # The form of the line.
        text = F.concat(F.lit("Events: "), F.array_join(events, ", "))
        return F.when(F.size(fields) > 0, F.concat(text, F.lit(" | PII fields: "), F.array_join(fields, ", "))).otherwise(text)

    return let(batch, of)


def session_and_client(df: DataFrame, headers_col: str = "headers", session: Column | None = None) -> DataFrame:
    """``df`` with session_id and client from the headers (map<string,string>, any case), or the body's session id."""
    headers = F.transform_keys(F.coalesce(F.col(headers_col), F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    get = lambda k: F.coalesce(F.element_at(F.col("_h"), k), F.lit(""))
    body = F.coalesce(F.col("request.session_id") if session is None else session, F.lit(""))
    vscode, cli, agent = get("vscode-sessionid"), get("x-client-session-id"), get("user-agent")
    named = F.when(get("copilot-integration-id") != "", get("copilot-integration-id")).otherwise(agent)
    client = F.when(vscode != "", agent).when(cli != "", named).when(body != "", agent).otherwise("")
    first = F.when(F.instr("client", " ") > 1, F.substring_index("client", " ", 1)).otherwise(F.col("client"))
    out = df.withColumn("_h", headers).withColumns({"session_id": F.when(vscode != "", vscode).when(cli != "", cli).otherwise(body), "client": client})
    return out.withColumn("client", first).drop("_h")


# Responses

_USAGE = "struct<input_tokens:int,output_tokens:int,cache_read_input_tokens:int,cache_creation_input_tokens:int,prompt_tokens:int,completion_tokens:int>"
_LINE = f"usage {_USAGE}, message struct<usage:{_USAGE}>, response struct<usage:{_USAGE}>"
_CALLS = "array<struct<function:struct<name:string,arguments:string>>>"
_EVENT = (
    "type string, index int, content_block struct<type:string,name:string>, delta string, "
    f"choices array<struct<delta:struct<content:string,tool_calls:{_CALLS}>>>"
)
_PLAIN = f"content array<struct<type:string,text:string,name:string,input:string>>, choices array<struct<message:struct<content:string,tool_calls:{_CALLS}>>>"
_DELTA = "type string, text string, partial_json string"


def sse_lines(body: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.regexp_replace(trimmed(x), "^data: ", ""))
    return F.filter(lines, lambda x: (x != "") & (x != "[DONE]"))


def usage(body: Column) -> Column:
    """struct<input_tokens, output_tokens>: the highest counts over the lines, at any of the three levels."""
    z = lambda c: F.coalesce(c, F.lit(0))
    lines = F.transform(sse_lines(body), lambda x: F.from_json(x, _LINE))
    most = lambda f: z(F.array_max(F.transform(lines, f)))
    total = lambda u: z(u.input_tokens) + z(u.cache_read_input_tokens) + z(u.cache_creation_input_tokens)
    asked = most(lambda x: F.greatest(total(x.usage), z(x.usage.prompt_tokens), total(x.message.usage), z(x.response.usage.input_tokens)))
    given = most(lambda x: F.greatest(z(x.usage.output_tokens), z(x.usage.completion_tokens), z(x.response.usage.output_tokens)))
    return F.struct(F.greatest(asked, F.lit(0)).alias("input_tokens"), F.greatest(given, F.lit(0)).alias("output_tokens"))


def _tool(text: Column, name: Column, body: Column) -> Column:
    """``text`` with a tool call on a line of its own."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(text, F.when(text != "", "\n").otherwise(""), F.lit("[Tool: "), e(name), F.lit("]\n"), F.when(e(body) != "", F.concat(body, F.lit("\n"))).otherwise(""))


def _calls(text: Column, calls: Column) -> Column:
    return F.aggregate(F.coalesce(calls, F.array().cast(_CALLS)), text, lambda t, c: _tool(t, c["function"]["name"], c["function"]["arguments"]))


def response_text(body: Column) -> Column:
    """The text of a response: of plain JSON its text blocks, tool calls and choices, else of SSE events in their order.

    Input of a tool comes in pieces; they are put together when the tool's block stops.
    """
    e = lambda c: F.coalesce(c, F.lit(""))
    parsed = F.from_json(F.coalesce(body, F.lit("")), _PLAIN)

    def of_plain(p: Column) -> Column:
        def block(t: Column, c: Column) -> Column:
            return F.when(c.type == "text", F.concat(t, e(c.text))).when(c.type == "tool_use", _tool(t, c["name"], F.when(c.input != "null", c.input))).otherwise(t)

        blocks = F.aggregate(F.coalesce(p.content, F.array().cast("array<struct<type:string,text:string,name:string,input:string>>")), F.lit(""), block)
        choices = F.coalesce(p.choices, F.array().cast(f"array<struct<message:struct<content:string,tool_calls:{_CALLS}>>>"))
        return F.aggregate(choices, blocks, lambda t, c: _calls(F.concat(t, e(c.message.content)), c.message.tool_calls))

    put = lambda m, k, v: F.map_concat(F.map_filter(m, lambda a, _: a != k), F.create_map(k, v))
    drop = lambda m, k: F.map_filter(m, lambda a, _: a != k)

    def step(s: Column, x: Column) -> Column:
        index, delta = F.coalesce(x["index"], F.lit(0)), F.from_json(x.delta, _DELTA)
        state = lambda text, names, inputs: F.struct(text.alias("text"), names.alias("names"), inputs.alias("inputs"))
        name = F.element_at(s.names, index)
        choices = F.coalesce(x.choices, F.array().cast(f"array<struct<delta:struct<content:string,tool_calls:{_CALLS}>>>"))
        said = F.array_join(F.transform(choices, lambda c: F.concat(e(c.delta.content), F.array_join(
            F.transform(F.coalesce(c.delta.tool_calls, F.array().cast(_CALLS)), lambda k: e(k["function"]["arguments"])), ""))), "")
        return (
            F.when((x.type == "content_block_start") & (x.content_block.type == "tool_use"),
                   state(s.text, put(s.names, index, e(x.content_block["name"])), put(s.inputs, index, F.lit(""))))
            .when((x.type == "content_block_delta") & (delta.type == "text_delta"), state(F.concat(s.text, e(delta.text)), s.names, s.inputs))
            .when((x.type == "content_block_delta") & (delta.type == "input_json_delta") & name.isNotNull(),
                  state(s.text, s.names, put(s.inputs, index, F.concat(F.element_at(s.inputs, index), e(delta.partial_json)))))
            .when((x.type == "content_block_stop") & name.isNotNull(),
                  state(_tool(s.text, name, F.element_at(s.inputs, index)), drop(s.names, index), drop(s.inputs, index)))
            .when(e(x.type).isin("response.output_text.delta", "response.text.delta"), state(F.concat(s.text, e(x.delta)), s.names, s.inputs))
            .otherwise(state(F.concat(s.text, said), s.names, s.inputs))
        )

    none = F.create_map().cast("map<int,string>")
    start = F.struct(F.lit("").alias("text"), none.alias("names"), none.alias("inputs"))
    events = F.transform(sse_lines(body), lambda x: F.from_json(x, _EVENT))
    streamed = F.aggregate(events, start, step, lambda s: s.text)
    plain = let(parsed, of_plain)
    return F.when(F.coalesce(plain, F.lit("")) != "", plain).otherwise(streamed)
