"""What text every match of a pattern holds, so that a rule runs only on texts that hold it."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

#: A set of alternatives larger than this tells too little to be worth looking for.
MOST = 64
#: Of longer literals the beginning is looked for.
LONGEST = 64
#: What a class may stand for and still count as alternatives.
CLASS = 16
_ASCII = frozenset(map(chr, range(128)))
_DIGIT = frozenset("0123456789")
_SPACE = frozenset("\t\n\f\r ")
_WORD = frozenset(c for c in _ASCII if c.isalnum() or c == "_")
_SETS = {"d": _DIGIT, "s": _SPACE, "w": _WORD}
_CONTROL = {"a": "\a", "f": "\f", "t": "\t", "n": "\n", "r": "\r", "v": "\v"}
_REPEAT = re.compile(r"\*|\+|\?|\{(\d+)(,(\d*))?\}")
_GROUP = re.compile(r"\(\?(?:P?<\w+>|([a-zA-Z-]*)([:)]))")


class _Unknown(Exception):
    """Syntax that is not read here: nothing is known of the pattern."""


@dataclass(frozen=True)
class _Part:
    """What a part of a pattern matches: exactly one of ``exact`` (None: not known), and always something that holds one of
    ``needed`` (None: maybe not). All folded to lower case."""

    exact: frozenset[str] | None
    needed: frozenset[str] | None


_NOTHING = _Part(frozenset([""]), None)
_ANYTHING = _Part(None, None)


def _rare(words: frozenset[str] | None) -> bool:
    """Whether each of the words is worth looking for: three characters, or a mark among them."""
    return bool(words) and all(len(w) > 2 or re.search(r"[^A-Za-z0-9\s]", w) for w in words)


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The set whose shortest word is longer; of such the smaller one."""
    known = [x for x in (a, b) if _rare(x)]
    return max(known, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _product(a: frozenset[str], b: frozenset[str]) -> frozenset[str] | None:
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= MOST else None


def _concat(parts: list[_Part]) -> _Part:
    """Neighbours that are known exactly are put together, as long as they stay few; the best such run, or what one part needs, is needed."""
    run, whole, needed = frozenset([""]), True, None
    for p in parts:
        longer = None if p.exact is None else _product(run, p.exact)
        if longer is None:
            needed, whole = _better(_better(needed, run), p.needed), False
            longer = p.exact or frozenset([""])
        run = longer
    return _Part(run if whole else None, _better(needed, run))


def _either(parts: list[_Part]) -> _Part:
    exact = frozenset(itertools.chain(*(p.exact for p in parts))) if all(p.exact is not None for p in parts) else None
    needs = [_better(p.needed, p.exact) for p in parts]
    needed = frozenset(itertools.chain(*needs)) if all(needs) else None
    return _Part(exact if exact and len(exact) <= MOST else None, needed if needed and len(needed) <= MOST else None)


def _times(parts: list[_Part], low: int, high: int | None) -> list[_Part]:
    """The parts of a repeat. Those of a group stand side by side, so that the first may go on what stands before it."""
    if low == 0:
        p = _concat(parts)
        optional = high == 1 and p.exact is not None and len(p.exact) < MOST
        return [_Part(p.exact | {""}, None) if optional else _NOTHING if high == 0 else _ANYTHING]
    return parts * min(low, 8) + ([] if low == high and low <= 8 else [_ANYTHING])


class _Reader:
    """Reads RE2 syntax from left to right."""

    def __init__(self, pattern: str) -> None:
        self.text, self.at = pattern, 0

    def either(self) -> list[_Part]:
        """The parts up to the end or a closing bracket; alternatives are one part."""
        parts: list[list[_Part]] = [[]]
        while self.at < len(self.text) and self.text[self.at] != ")":
            if self.text[self.at] == "|":
                parts.append([])
                self.at += 1
            else:
                parts[-1] += self.repeated()
        return [_either([_concat(p) for p in parts])] if len(parts) > 1 else parts[0]

    def repeated(self) -> list[_Part]:
        parts = self.item()
        while m := _REPEAT.match(self.text, self.at):
            self.at = m.end() + (self.text[m.end() : m.end() + 1] == "?")
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(m[0], (int(m[1] or 0), int(m[3]) if m[3] else None if m[2] else int(m[1] or 0)))
            parts = _times(parts, low, high)
        return parts

    def item(self) -> list[_Part]:
        c = self.text[self.at]
        if c == "(":
            return self.group()
        if c == "[":
            return [self.one_of(self.char_class())]
        if c == "\\":
            return self.escape()
        self.at += 1
        if c == ".":
            return [_ANYTHING]
        return [_NOTHING if c in "^$" else self.one_of(frozenset(c))]

    def group(self) -> list[_Part]:
        m = _GROUP.match(self.text, self.at)
        if m and m[1] is not None:
            on, _, off = m[1].partition("-")
            if set(on + off) - set("imsU"):
                raise _Unknown
        elif not m and self.text.startswith("(?", self.at):
            raise _Unknown
        self.at = m.end() if m else self.at + 1
        if m and m[2] == ")":
            return []  # flags for what follows; case is folded whatever they say
        parts = self.either()
        if self.text[self.at : self.at + 1] != ")":
            raise _Unknown
        self.at += 1
        return parts

    def escape(self) -> list[_Part]:
        if self.text.startswith("\\Q", self.at):
            end = self.text.find("\\E", self.at)
            literal = self.text[self.at + 2 : end if end >= 0 else None]
            self.at = end + 2 if end >= 0 else len(self.text)
            return [self.one_of(frozenset(c)) for c in literal]
        if self.text[self.at + 1 : self.at + 2] in ("b", "B", "A", "z"):
            self.at += 2
            return [_NOTHING]
        return [self.one_of(self.escaped())]

    def escaped(self) -> frozenset[str] | None:
        """The characters of an escape; None where they are many."""
        c = self.text[self.at + 1 : self.at + 2]
        hexadecimal = re.compile(r"\\x(?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2}))").match(self.text, self.at)
        octal = re.compile(r"\\([0-7]{2,3}|0)").match(self.text, self.at)
        if hexadecimal or octal:
            self.at = (hexadecimal or octal).end()
            return frozenset(chr(int(hexadecimal[1] or hexadecimal[2], 16) if hexadecimal else int(octal[1], 8)))
        if c in ("p", "P"):
            m = re.compile(r"\\[pP](?:\{\^?\w+\}|\w)").match(self.text, self.at)
            if not m:
                raise _Unknown
            self.at = m.end()
            return None
        if not c or (c.isalnum() and c not in "dDsSwW" and c not in _CONTROL):
            raise _Unknown
        self.at += 2
        return _SETS.get(c, None if c in "DSW" else frozenset(_CONTROL.get(c, c)))

    def char_class(self) -> frozenset[str] | None:
        self.at += 1
        negated = self.text[self.at : self.at + 1] == "^"
        self.at += negated
        found: set[str] = set()
        many, first = negated, True
        while first or self.text[self.at : self.at + 1] != "]":
            if self.at >= len(self.text):
                raise _Unknown
            first = False
            named = re.compile(r"\[:\^?\w+:\]").match(self.text, self.at)
            if named:
                self.at, many = named.end(), True
                continue
            low = self.class_char()
            if low and len(low) == 1 and self.text[self.at : self.at + 1] == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                high = self.class_char()
                if not high or len(high) != 1:
                    raise _Unknown
                a, b = ord(*low), ord(*high)
                low = frozenset(map(chr, range(a, b + 1))) if b - a < 128 else None
            many |= low is None
            found |= low or set()
        self.at += 1
        return None if many else frozenset(found)

    def class_char(self) -> frozenset[str] | None:
        if self.text[self.at] == "\\":
            return self.escaped()
        self.at += 1
        return frozenset(self.text[self.at - 1])

    def one_of(self, chars: frozenset[str] | None) -> _Part:
        """One of these characters. What folds to or from characters beyond ASCII in other ways than the prefilter's is not told apart."""
        if not chars or not chars <= _ASCII:
            return _ANYTHING
        folded = frozenset(c.lower() for c in chars)
        return _Part(folded, None) if len(folded) <= CLASS else _ANYTHING


def required_literals(pattern: str) -> list[str]:
    """Literals of which every match of the pattern (RE2) holds one, in lower case; none where that is not known.

    The text must be folded before they are looked for (see ``detect.fold``), as all of them are, whether the pattern minds case or
    not. What the pattern's tree needs is found from below: neighbours are put together, alternatives united, repeats
    counted once if they occur at least once; of all sets found on the way the one with the longest shortest word is taken.
    """
    reader = _Reader(pattern)
    try:
        part = _concat(reader.either())
        if reader.at < len(pattern):
            raise _Unknown
    except (_Unknown, IndexError):
        return []
    best = sorted({w[:LONGEST] for w in _better(part.needed, part.exact) or []})
    return [w for w in best if not any(o != w and o in w for o in best)]
