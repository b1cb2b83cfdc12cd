"""Deep bodies are read by the fast reader, as the other one reads them."""

import time

import pytest

from hushlake.operators.json_reader import _read_on_a_stack, read_json


def deep(n):
    return '{"messages":[{"content":' + '[{"type":"tool_result","content":' * n + '"hi"' + "}]" * n + "}]}"


def test_deep_bodies_are_read_fast():
    began = time.process_time()
    for _ in range(40):
        read_json(deep(2000))
    assert time.process_time() - began < 1.2


def test_both_readers_agree():
    for text in (deep(3), '{"x":1,"x":[2.50,-1e400,null,true],"y":{}}', '"\\ud800\\n"', " [ ] ", "7" * 5000):
        a, b = read_json(text), _read_on_a_stack(text)
        assert a == b and repr(type(a)) == repr(type(b)) and getattr(a, "token", "") == getattr(b, "token", "")
    assert read_json("[" * 300_000 + "]" * 300_000) is not None
    for text in ("[1 2]", '{"a":NaN}', "[01]", '"\x01"', "[1,]", '{"a"}', "", "nul", "[1]x", "\ufeff[]", "[1.]", '"\\x"', "[-Infinity]", "[" * 100_000):
        for read in (read_json, _read_on_a_stack):
            with pytest.raises(ValueError):
                read(text)
