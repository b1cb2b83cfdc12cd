"""RE2 patterns for java.util.regex, so that both find the same matches."""

from __future__ import annotations

import re

_SPACE = r"\t\n\f\r "
_ITEM = re.compile(r"\[\^?\]?|\\.|\(\?P<\w+>|\(\?[a-z-]*[:)]|.", re.S)


def to_java(pattern: str) -> str:
    r"""``pattern`` (RE2) in Java's syntax.

    ``\b`` and ``\B`` see ASCII word characters only, ``$`` is the end of the text, ``\s`` has no vertical tab, ``.`` leaves out
    the line feed alone, case folds beyond ASCII, POSIX classes are Java's, and named groups become plain ones.
    """
    out, at, in_class = ["(?d)"], 0, False
    while at < len(pattern):
        if in_class:
            posix = re.compile(r"\[:(\w+):\]").match(pattern, at)
            if posix:
                out.append(rf"\p{{{posix[1].capitalize()}}}")
                at = posix.end()
                continue
            item = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
            if item == "]":
                in_class = False
            elif item == r"\s":
                item = _SPACE
            elif item == r"\S":
                item = f"[^{_SPACE}]"
            elif item == "[" or (item == "&" and pattern[at + 1 : at + 2] == "&"):
                out.append("\\" + item)
                at += 1
                continue
            out.append(item)
            at += len(pattern[at : at + 2] if pattern[at] == "\\" else pattern[at])
            continue
        item = _ITEM.match(pattern, at)[0]
        at += len(item)
        if item.startswith("["):
            in_class = True
            if item.endswith("]"):
                item = item[:-1] + r"\]"
        elif item == r"\b":
            item = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
        elif item == r"\B":
            item = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
        elif item == r"\s":
            item = f"[{_SPACE}]"
        elif item == r"\S":
            item = f"[^{_SPACE}]"
        elif item == "$":
            item = r"\z"
        elif item.startswith("(?P<"):
            item = "("
        elif item.startswith("(?") and "i" in item.partition("-")[0]:
            item = item.replace("i", "iu", 1)
        out.append(item)
    return "".join(out)


def replacement_to_java(replacement: str) -> str:
    """``${1}`` becomes ``$1``; other dollars and backslashes are literal."""
    parts = re.split(r"\$\{(\d+)\}", replacement)
    return "".join(f"${p}" if n % 2 else p.replace("\\", r"\\").replace("$", r"\$") for n, p in enumerate(parts))


def replacement_to_re2(replacement: str) -> str:
    r"""The same for DuckDB, whose groups are ``\1``."""
    return re.sub(r"\$\{(\d+)\}", r"\\\1", replacement)
