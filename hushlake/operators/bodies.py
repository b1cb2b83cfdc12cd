"""Redaction of whole JSON bodies: texts are found as leaves, redacted natively, and put back in place."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.operators.detect import inspect, once, redact, rule_array
from hushlake.operators.json_reader import read_json
from hushlake.operators.pieces import piecewise
from hushlake.operators.requests import squeezed

# A string is text when the nearest key above it is one of these; array elements have their array's key.
TEXT_FIELDS = ["content", "text", "thinking", "tool_result", "output", "arguments", "system", "instructions", "input", "prompt"]

_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"|[{}\[\],]', re.S)


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _holds_texts(body: str) -> bool:
    """Whether it is JSON of an object or array. Numbers are of any length, and so is depth: where the fast reader ends, the other one goes on."""
    try:
        return isinstance(json.loads(body, parse_constant=_no_number, parse_int=len, parse_float=len), (dict, list))
    except RecursionError:
        pass
    except ValueError:
        return False
    try:
        return isinstance(read_json(body), (dict, list))
    except ValueError:
        return False


def text_places(body: str) -> list[tuple[str, int, int]] | None:
    """(field, start, end) of each text's string literal in order; None where the body is no JSON object or array.

    The literals are found in the body as it is written, so that all around them can stay as it is.
    """
    if not _holds_texts(body):
        return None
    found: list[tuple[str, int, int]] = []
    stack: list[list] = []  # whether it is an object, and the key that its next value has
    names_key = False
    for m in _TOKEN.finditer(body):
        c = body[m.start()]
        if c == '"':
            if names_key:
                stack[-1][1], names_key = json.loads(m[0]), False
            elif stack[-1][1] in TEXT_FIELDS:
                found.append((stack[-1][1], m.start(), m.end()))
        elif c == "{":
            stack.append([True, ""])
            names_key = True
        elif c == "[":
            stack.append([False, stack[-1][1] if stack else ""])
        elif c == ",":
            names_key = stack[-1][0]
        else:
            stack.pop()
            names_key = False
    return found


def _decoded(literal: str) -> str:
    return json.loads(literal).encode("utf-8", "replace").decode()  # half of a surrogate pair is no character


def _leaves(body: str | None) -> list[dict]:
    places = None if body is None else text_places(body)
    if places is None:
        return [] if body is None else [{"field": None, "text": body}]
    return [{"field": k, "text": _decoded(body[a:b])} for k, a, b in places]


def _assembled(body: str | None, texts: list[str] | None) -> str | None:
    """The body with these texts in their places."""
    places = None if body is None else text_places(body)
    if places is None:
        return None if body is None else texts[0]
    parts, at = [], 0
    for (_, a, b), text in zip(places, texts, strict=True):
        if text != _decoded(body[a:b]):
            parts += [body[at:a], json.dumps(text, ensure_ascii=False)]
            at = b
    return "".join([*parts, body[at:]])


def _with_leaves(df: DataFrame, body_col: str) -> DataFrame:
    """Leaves of each body in order; a body that is no object or array is one leaf without a field, a null one has none."""
    kind = pa.list_(pa.struct([("field", pa.string()), ("text", pa.string())]))
    leaves = piecewise(_leaves, kind, "array<struct<field: string, text: string>>")
    return df.withColumn("_leaves", leaves(F.col(body_col)))


def text_leaves(df: DataFrame, id_cols: Sequence[str], body_col: str = "body") -> DataFrame:
    """One row for each text of a body: id_cols, pos, field, text."""
    rows = _with_leaves(df, body_col).select(*id_cols, F.posexplode("_leaves").alias("pos", "leaf"))
    return rows.select(*id_cols, "pos", "leaf.field", "leaf.text")


def redact_bodies(
    df: DataFrame, rules: DataFrame, body_col: str = "body", agent_mode: bool = False, block: bool = False, out_col: str = "redacted_body", sure: bool = False
) -> DataFrame:
    """``df`` with ``out_col``: the body with its texts redacted by the track rules (``block``: the block rules; agent mode: all).

    All else stays byte for byte: keys, numbers, other strings, white space. A body that is no JSON is redacted as a
    text. A valid body that were not valid any more would stay as it is. With ``sure`` a body is given as empty if the rules
    still find something in its texts without tags, joined by blank lines: a value that tags or several texts share out.
    A null body gives an empty one. Only bodies in which something is replaced are put together again.
    """
    modes = None if agent_mode and not block else ["block" if block else "track"]
    array = rule_array(rules, modes)
    rows = _with_leaves(df, body_col)
    both = F.struct(F.transform("_leaves", lambda x: x.text).alias("old"), F.transform("_leaves", lambda x: redact(x.text, array).text).alias("new"))
    rows = rows.select("*", F.explode(F.array(both)).alias("_texts"))  # a generator keeps the native part out of the UDF's arguments
    changed = F.col("_texts.old") != F.col("_texts.new")

    assemble = piecewise(_assembled, pa.string(), "string")
    rows = rows.withColumn("_new", assemble(F.when(changed, F.col(body_col)), F.when(changed, F.col("_texts.new"))))
    body = F.coalesce(F.col(body_col), F.lit(""))
    broken = F.try_parse_json("_new").isNull() & F.try_parse_json(body).isNotNull()
    out = F.when(changed & ~broken, F.col("_new")).otherwise(body)
    if sure:
        whole = F.array_join(F.transform("_texts.new", squeezed), "\n\n")
        out = F.when(F.size(inspect(whole, array)) == 0, out).otherwise("")
    return once(rows, out, out_col).drop("_leaves", "_texts", "_new")
