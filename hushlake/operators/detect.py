"""Detection and redaction of sensitive values, as Column expressions over an array of rules.

The rules are small (hundreds) and travel as one constant array in the plan. For each text only those
run whose literals occur in it; a rule without a known literal always runs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions.rules import FOLD, SCHEMA

#: A rule table beyond this is no constant any more: ``findings`` joins it, ``redact`` and verdicts refuse it.
MAX_RULES = 5_000
MATCH = "ord int, rule_id string, rule_name string, severity string, mode string, start int, snippet string"
SNIPPET = 20
#: What a rule's validator may be; a rule with another one would fire unchecked.
VALIDATORS = ("", "luhn")
_EDGE_LEFT, _EDGE_RIGHT = r"(?<!\w)", r"(?!\w)"


@dataclass(frozen=True)
class RuleSet:
    """Rules as a constant array in order, and the distinct literals of all of them."""

    array: Column
    words: tuple[str, ...]


def rule_array(rules: DataFrame, modes: Sequence[str] | None = None) -> RuleSet:
    """The rules of these modes (all without). The mode ``redact`` counts as ``track``."""
    rows = rules.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    check_validators(r.validator for r in rows)
    chosen = [r.asDict() for r in sorted(rows, key=lambda r: r.ord)]
    for r in chosen:
        r["mode"] = "track" if r["mode"] == "redact" else r["mode"]
    chosen = [r for r in chosen if modes is None or r["mode"] in modes]
    words = sorted({k for r in chosen for k in r["keywords"]})
    return RuleSet(F.from_json(F.lit(json.dumps(chosen)), f"array<struct<{SCHEMA}>>"), tuple(words))


def check_validators(names: Iterable[str | None]) -> None:
    unknown = sorted({n for n in names if n and n not in VALIDATORS})
    if unknown:
        raise ValueError(f"unknown validators: {', '.join(unknown)}")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; a lambda's body would compute it again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def longest_word(words: Sequence[str]) -> str:
    """A pattern (Java) for the longest of these words at a place: a tree of their letters, halved by classes, so that few are tried there."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    rest = [(re.escape(c), re.escape(c) + longest_word(tails)) for c, tails in sorted(heads.items()) if c]
    if not rest:
        return ""
    if len(rest) == 1 and "" not in heads:
        return rest[0][1]
    return f"(?:{_halved(rest)})" + ("?" if "" in heads else "")


def _halved(parts: list[tuple[str, str]]) -> str:
    """Alternatives by their first letter; of more than a few, a class tells first in which half to look."""
    if len(parts) <= 3:
        return "|".join(p for _, p in parts)
    half = len(parts) // 2
    first = lambda some: "".join(c for c, _ in some)
    return "|".join(f"(?=[{first(some)}])(?:{_halved(some)})" for some in (parts[:half], parts[half:]))


def _may_match(rules: RuleSet, text: Column) -> Column:
    """The rules of which the text holds a literal, and whose guard it passes.

    One pass finds the longest literal at each place of the folded text; a shorter one held there is its beginning.
    """
    found = lambda folded: F.array_distinct(F.regexp_extract_all(folded, F.lit(f"(?=({longest_word(rules.words)}))"), F.lit(1)))
    held = lambda folded: found(folded) if rules.words else F.array().cast("array<string>")
    has = lambda r, words: (F.size(r.keywords) == 0) | F.exists(r.keywords, lambda k: F.exists(words, lambda w: F.startswith(w, k)))
    guarded = lambda r: (r.guard == "") | F.rlike(text, r.guard)
    return let(let(fold(text), held), lambda words: F.filter(rules.array, lambda r: has(r, words) & guarded(r)))


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), *FOLD)


def _valid_cards(text: Column, pattern: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.luhn_check(m) if hasattr(F, "luhn_check") else F.call_function("luhn_check", m))


def _quoted(match: Column) -> Column:
    return F.concat(F.lit(_EDGE_LEFT), match, F.lit(_EDGE_RIGHT))


def _found(text: Column, rule: Column) -> Column:
    """The first match that passes the rule's validator; null without one."""
    return F.when(rule.validator == "luhn", F.get(_valid_cards(text, rule.pattern_java), F.lit(0))).otherwise(F.regexp_substr(text, rule.pattern_java))


def _start(text: Column, rule: Column, match: Column) -> Column:
    """Where that match starts, from 1. A validated match is a whole run of digits, so it is found again by itself."""
    return F.when(rule.validator == "luhn", F.regexp_instr(text, _quoted(match))).otherwise(F.regexp_instr(text, rule.pattern_java))


def _snippet(text: Column, start: Column, match: Column) -> Column:
    """The match with SNIPPET characters on both sides, and an ellipsis where more was cut."""
    low, high = F.greatest(start - SNIPPET, F.lit(1)), F.least(start + F.length(match) + SNIPPET - 1, F.length(text))
    body = F.substring(text, low, high - low + 1)
    return F.concat(F.when(low > 1, "…").otherwise(""), body, F.when(high < F.length(text), "…").otherwise(""))


def _as_match(text: Column, rule: Column, match: Column) -> Column:
    fields = [rule[c].alias(c) for c in ("ord", "rule_id", "rule_name", "severity", "mode")]
    return let(_start(text, rule, match), lambda start: F.struct(*fields, start.alias("start"), _snippet(text, start, match).alias("snippet")))


def inspect(text: Column, rules: RuleSet) -> Column:
    """One match for each rule that fires, in the rules' order: array<struct<ord, rule_id, rule_name, severity, mode, start, snippet>>."""

    def of(clean: Column) -> Column:
        found = F.transform(_may_match(rules, clean), lambda r: F.struct(r.alias("r"), _found(clean, r).alias("m")))
        return F.transform(F.filter(found, lambda x: x.m.isNotNull()), lambda x: _as_match(clean, x.r, x.m))

    return let(F.coalesce(text, F.lit("")), of)


def redact(text: Column, rules: RuleSet) -> Column:
    """struct<text, matches>: each rule in order sees what earlier rules left and replaces all its matches."""

    def replaced(now: Column, r: Column) -> Column:
        cards = F.array_distinct(_valid_cards(now, r.pattern_java))
        by_card = F.aggregate(cards, now, lambda t, m: F.regexp_replace(t, _quoted(m), r.replacement_java))
        return F.when(r.validator == "luhn", by_card).otherwise(F.regexp_replace(now, r.pattern_java, r.replacement_java))

    def step(acc: Column, r: Column) -> Column:
        def after(found: Column) -> Column:
            new = F.struct(replaced(acc.text, r).alias("text"), F.concat(acc.matches, F.array(_as_match(acc.text, r, found))).alias("matches"))
            return F.when(found.isNotNull(), new).otherwise(acc)

        return let(_found(acc.text, r), after)

    def of(clean: Column) -> Column:
        start = F.struct(clean.alias("text"), F.from_json(F.lit("[]"), f"array<struct<{MATCH}>>").alias("matches"))
        return F.aggregate(_may_match(rules, clean), start, step)

    return let(F.coalesce(text, F.lit("")), of)


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a column out of a generator: filters on it are not moved in front of it, where it would be computed again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def detect(df: DataFrame, rules: DataFrame, text_col: str = "text", modes: Sequence[str] | None = None) -> DataFrame:
    """``df`` with matches (see inspect). Narrow: no shuffle."""
    return once(df, inspect(F.col(text_col), rule_array(rules, modes)), "matches")


def findings(df: DataFrame, rules: DataFrame, id_cols: Sequence[str], text_col: str = "text", modes: Sequence[str] | None = None) -> DataFrame:
    """One row for each row of ``df`` and rule that fires: id_cols and the fields of the match.

    A rule table beyond MAX_RULES is joined by the literals found in the texts (see rule_index); what is found is the same.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        from hushlake.operators.rule_index import indexed_findings

        return indexed_findings(df, rules, id_cols, text_col, modes)
    found = df.select(*id_cols, F.explode(inspect(F.col(text_col), rule_array(rules, modes))).alias("m"))
    return found.select(*id_cols, "m.*")


def redact_text(df: DataFrame, rules: DataFrame, text_col: str = "text", agent_mode: bool = False) -> DataFrame:
    """``df`` with redacted (by the track rules, or all in agent mode) and redactions (their matches)."""
    out = redact(F.col(text_col), rule_array(rules, None if agent_mode else ["track"]))
    return once(df, out, "_r").withColumns({"redacted": F.col("_r.text"), "redactions": F.col("_r.matches")}).drop("_r")


def scan_text(df: DataFrame, rules: DataFrame, text_col: str = "text", agent_mode: bool = False) -> DataFrame:
    """Dry run: matches (block rules, none in agent mode, then redactions), status and redacted."""
    none = F.from_json(F.lit("[]"), f"array<struct<{MATCH}>>")
    block = none if agent_mode else inspect(F.col(text_col), rule_array(rules, ["block"]))
    rows = once(redact_text(df, rules, text_col, agent_mode), block, "_b")
    status = F.when(F.size("_b") > 0, "blocked").when(F.size("redactions") > 0, "redacted").otherwise("clean")
    return rows.withColumns({"matches": F.concat("_b", "redactions"), "status": status}).drop("_b", "redactions")


def max_severity(matches: Column) -> Column:
    has = lambda level: F.exists(matches, lambda m: m.severity == level)
    return F.when(has("high"), "high").when(has("medium"), "medium").when(has("low"), "low").otherwise("")
