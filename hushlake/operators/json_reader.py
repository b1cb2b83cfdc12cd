"""A reader for request bodies that VARIANT refuses: double keys, numbers and keys of any length, any depth.

Spark's parser reads nearly all bodies. The rest go through one Arrow pass that cuts them down to the fields that requests and
telemetry have; what comes out is plain JSON that VARIANT reads, so that one set of expressions serves both.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column

from hushlake.operators.pieces import piecewise

# Fixed values.
PII_KEYS = ["email", "userId", "user_id", "anonymousId", "ip", "phone", "name"]

_TOKEN = re.compile(
    r'[ \t\n\r]*+(?:("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+)|(true|false|null)|([{}\[\],:]))'
)
_END = re.compile(r"[ \t\n\r]*+\Z")
_WORDS = {"true": True, "false": False, "null": None}


def _tokens(text: str) -> Iterator[tuple[int, str]]:
    """(kind, token): 1 string, 2 number, 3 word, 4 mark."""
    at, match = 0, _TOKEN.match
    while not _END.match(text, at):
        m = match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        yield m.lastindex, m[m.lastindex]
        at = m.end()


class Number(float):
    """A number as it is written: of any length, it counts as 0 and keeps its text."""

    def __new__(cls, token: str) -> Number:
        number = super().__new__(cls, 0)
        number.token = token
        return number


def read_json(text: str) -> object:
    """The value that a JSON text holds, numbers as ``Number``. ValueError if it is no JSON.

    Of an object's equal keys the last counts. Where the fast reader ends for depth, open objects and lists stand on a stack of
    their own, so that depth is bounded by the text alone.
    """
    try:
        return json.loads(text, parse_constant=_no_number, parse_int=Number, parse_float=Number)
    except RecursionError:
        return _read_on_a_stack(text)


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _read_on_a_stack(text: str) -> object:
    root: list = []
    stack: list[list] = [[root, None]]  # open containers, each with the key that its next value has
    wants = "value"  # value, value or ], key, key or }, colon, comma or close, end
    for kind, token in _tokens(text):
        holder = stack[-1]
        if wants == "colon":
            if token != ":" or kind != 4:
                raise ValueError("a colon is missing")
            wants = "value"
        elif wants in ("key", "key or }") and kind == 1:
            holder[1], wants = json.loads(token), "colon"
        elif kind == 4 and token == "," and wants == "comma or close":
            wants = "key" if isinstance(holder[0], dict) else "value"
        elif kind == 4 and token in "]}" and len(stack) > 1 and wants in ("comma or close", "value or ]" if token == "]" else "key or }"):
            if isinstance(holder[0], dict) != (token == "}"):
                raise ValueError("brackets do not match")
            stack.pop()
            wants = "comma or close" if len(stack) > 1 else "end"
        elif wants in ("value", "value or ]") and (kind < 4 or token in "{["):
            value = json.loads(token) if kind == 1 else Number(token) if kind == 2 else _WORDS[token] if kind == 3 else {} if token == "{" else []
            if isinstance(holder[0], dict):
                holder[0][holder[1]] = value
            else:
                holder[0].append(value)
            if kind == 4:
                stack.append([value, None])
                wants = "key or }" if token == "{" else "value or ]"
            else:
                wants = "comma or close" if len(stack) > 1 else "end"
        else:
            raise ValueError(f"{token[:20]} is out of place")
    if wants != "end":
        raise ValueError("the text ends too early")
    return root[0]


def walked_texts(content: object) -> list[str]:
    """The texts of a content field at any depth, untrimmed: of a string, or of blocks, text blocks and tool results."""
    out: list[str] = []
    stack = [content]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            held = [b for b in x if isinstance(b, dict)]
            texts = {"text": "text", "tool_result": "content"}
            known = [b for b in held if isinstance(b.get("type"), str) and b["type"] in texts]
            found = [b.get(texts[b["type"]]) for b in known if b["type"] == "tool_result" or isinstance(b.get("text"), str)]
            stack.extend(reversed(found))
    return out


def _bare(value: object) -> object:
    """A value without what it holds: enough to tell its type."""
    return type(value)() if isinstance(value, (dict, list)) else value


def _picked(value: object, *names: str) -> object:
    return {n: _bare(value[n]) for n in names if n in value} if isinstance(value, dict) else _bare(value)


def _content(value: object) -> object:
    if not isinstance(value, list):
        return _bare(value)
    blocks = []
    for b in value:
        block = _picked(b, "type", "text")
        if isinstance(b, dict) and isinstance(b.get("text"), Number):
            block["text"] = b["text"].token  # VARIANT gives a number as text, too
        if isinstance(b, dict) and b.get("type") == "tool_result" and "content" in b:
            block["content"] = [{"type": "text", "text": t} for t in walked_texts(b["content"])]
        blocks.append(block)
    return blocks


def _strings(value: object) -> str:
    """All strings of a value, keys too, on lines."""
    out: list[str] = []
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, dict):
            stack.extend(s for pair in reversed(x.items()) for s in reversed(pair))
        elif isinstance(x, list):
            stack.extend(reversed(x))
    return "\n".join(out)


def _item(value: object) -> object:
    item = _picked(value, "type", "role", "output")
    if isinstance(value, dict):
        if isinstance(value.get("output"), (dict, list)):
            item["output"] = _strings(value["output"])
        if "content" in value:
            item["content"] = _content(value["content"])
    return item


def _event(value: object) -> object:
    event = _picked(value, "event")
    if isinstance(value, dict):
        context = value.get("context")
        traits = context.get("traits") if isinstance(context, dict) else None
        event["context"] = {"traits": _picked(traits, *PII_KEYS)}
    return event


def slim_body(text: str) -> str | None:
    """A body's used fields as JSON, tool results flattened to one level; null if the text is no JSON object.

    A field of another type than requests have keeps its type, so that the request is judged as the whole body would be.
    """
    try:
        body = read_json(text)
    except ValueError:
        return None
    if not isinstance(body, dict):
        return None
    out: dict[str, object] = _picked(body, "model", "stream", "instructions", "prompt", "writeKey")
    each = {"messages": _item, "input": _item, "batch": _event}
    for name, value in body.items():
        if name == "metadata":
            out[name] = _picked(value, "user_id")
        elif name == "system":
            out[name] = _content(value)
        elif name in each:
            out[name] = [each[name](x) for x in value] if isinstance(value, list) else _bare(value)
    return json.dumps(out, ensure_ascii=False).encode("utf-8", "replace").decode()  # half of a surrogate pair is no character


def slimmed(body: Column) -> Column:
    """``slim_body`` of each body; nulls stay."""
    return piecewise(lambda b: None if b is None else slim_body(b), pa.string(), "string")(body)
