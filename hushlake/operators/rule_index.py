"""Rule tables of any size: texts meet the rules whose literals they hold in a join, and only those run."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions.literals import LONGEST
from hushlake.operators.detect import MAX_RULES, SNIPPET, VALIDATORS, _as_match, _found, check_validators, findings, fold, longest_word, once

#: Rules of one pass over the texts, and bytes of them (each once for each of its literals): they are broadcast.
PASS, PASS_BYTES = 50_000, 32 << 20
#: What a rule matches and looks at may be so long for it to run on pieces of a text, and the characters of which each piece has the matches that start there.
REACH, CORE = 64, 128


def passes(rules: DataFrame, most: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """First and last ``ord`` of neighbouring rules, so many that neither limit is passed; a rule beyond the limit is alone.

    A number or two of each rule come to the driver. Rules of one ``ord`` stay together.
    """
    strings = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in rules.dtypes if kind == "string"]
    size = (reduce(lambda a, b: a + b, strings) + 100) * F.greatest(F.size("keywords"), F.lit(1))
    first = last = None
    count = held = 0
    for r in rules.groupBy("ord").agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("bytes")).orderBy("ord").collect():
        if first is not None and (count + r.n > most or held + r.bytes > most_bytes):
            yield first, last
            first, count, held = None, 0, 0
        first, last, count, held = r.ord if first is None else first, r.ord, count + r.n, held + r.bytes
    if first is not None:
        yield first, last


def indexed_findings(
    df: DataFrame, rules: DataFrame, id_cols: Sequence[str], text_col: str = "text", modes: Sequence[str] | None = None, most: int = PASS, most_bytes: int = PASS_BYTES
) -> DataFrame:
    """What ``findings`` gives, for rule tables of any number of rules.

    One pattern in the form of a tree of letters finds the longest literal at each place of a text; its beginnings are held as well.
    All these are exploded and meet the rules' literals in a hash join, in which what is no literal falls out. A rule of which a text holds
    several literals is met by the first of them only. Each pair runs the rule's own pattern. The number of pairs follows what the texts hold,
    not the number of rules. Rules go in passes by ``ord`` (see passes), whose tables are broadcast; each pass reads the texts again, and all of it
    is narrow. Rules without a literal run on every text, in passes of the constant array. Rules whose matches are known to be short take
    another way, of which the work is in proportion to the texts and to the rules (see short_findings), and those that ask for a whole
    word a shorter one (see word_findings).
    """
    mode = F.when(F.col("mode") == "redact", "track").otherwise(F.col("mode"))
    shortened = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.left(fold(k), F.lit(LONGEST)))
    rules = rules.withColumns({"mode": mode, "keywords": F.array_distinct(shortened)})
    names = rules.columns
    plain = (F.coalesce("validator", F.lit("")) == "") & (F.coalesce("guard", F.lit("")) == "")
    # Out of generators: else the filters by kind would move in front of what has made the rules distinct.
    known = once(rules, F.when(plain, asked_word(F.col("pattern_java"))), "_word")
    known = once(known, F.when((F.col("keywords") == F.array(fold(F.col("_word")))) & (F.length("_word") <= REACH), F.col("_word")), "_asked")
    some = plain & (F.size("keywords") > 0) & F.forall("keywords", lambda k: anchor(k) != "")
    known = once(known, F.when(F.isnull("_asked") & some, reach(F.col("pattern_java"))), "_reach")
    kind = F.when(F.isnotnull("_asked"), "whole").when(F.col("_reach") <= REACH, "short").when(F.size("keywords") == 0, "bare").otherwise("literal")
    known = known.withColumn("_kind", kind)
    chosen = F.lit(True) if modes is None else F.coalesce(F.col("mode").isin(*modes), F.lit(False))
    odd, size = F.when(~F.col("validator").isin(*VALIDATORS), F.col("validator")), F.length("_asked")
    spans = known.groupBy("_kind", chosen.alias("chosen")).agg(F.min(odd).alias("odd"), F.max(odd).alias("odder"), F.min(size).alias("low"), F.max(size).alias("high"), F.max("_reach").alias("reach")).collect()
    check_validators(v for r in spans for v in (r.odd, r.odder))
    spans = {r["_kind"]: r for r in spans if r.chosen}
    of = lambda name: known.where(chosen & (F.col("_kind") == name))
    rows = df.select(*id_cols, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    parts = []
    if "whole" in spans:
        parts.append(word_findings(rows, of("whole"), id_cols, spans["whole"].low, spans["whole"].high))
    if "short" in spans:
        parts.append(short_findings(rows, of("short").select(*names, "_reach"), id_cols, spans["short"].reach))
    bare, literal = of("bare").select(*names), of("literal").select(*names)
    parts += [findings(rows, bare.where(F.col("ord").between(*ends)), id_cols, "_text") for ends in (passes(bare, MAX_RULES, most_bytes) if "bare" in spans else ())]
    for ends in passes(literal, most, most_bytes) if "literal" in spans else ():
        some = literal.where(F.col("ord").between(*ends))
        words = sorted(r.word for r in some.select(F.explode("keywords").alias("word")).distinct().collect())
        longest = F.regexp_extract_all(fold(F.col("_text")), F.lit(f"(?=({longest_word(words)}))"), F.lit(1))
        beginnings = F.transform(F.array_distinct(longest), lambda w: F.transform(F.sequence(F.lit(0), F.length(w)), lambda n: F.left(w, n)))
        # Out of a generator the literals are found once; the join and what follows only read them.
        texts = rows.select("*", F.explode(F.array(F.array_distinct(F.flatten(beginnings)))).alias("_held")).select("*", F.explode("_held").alias("_word"))
        index = some.select(F.struct(*names).alias("_rule"), F.explode("keywords").alias("_word"))
        met = texts.join(F.broadcast(index), "_word").where(F.col("_word") == F.array_min(F.array_intersect("_held", "_rule.keywords")))
        guarded = met.where((F.col("_rule.guard") == "") | F.rlike("_text", F.col("_rule.guard")))
        found = guarded.select("*", F.explode(F.array(_found(F.col("_text"), F.col("_rule")))).alias("_m")).where("_m IS NOT NULL")
        parts.append(found.select(*id_cols, _as_match(F.col("_text"), F.col("_rule"), F.col("_m")).alias("_as")).select(*id_cols, "_as.*"))
    return reduce(DataFrame.unionByName, parts) if parts else findings(rows, bare, id_cols, "_text")


def reach(pattern: Column) -> Column:
    """At most so many characters are matched by a pattern (Java), and looked at behind a match, of those before it one at most; null where that is not known.

    Without a repeat each character that it matches or looks at has one of its own in the pattern.
    """
    plain = F.regexp_replace(F.regexp_replace(pattern, r"(?s)\\.", "x"), r"\[\^?\]?[^\]]*\]", "x")
    behind = F.regexp_replace(pattern, r"\(\?<[=!]\\w\)", "")
    known = ~F.rlike(plain, F.lit(r"[*+{]")) & ~F.contains(behind, F.lit("(?<")) & ~F.rlike(F.replace(pattern, F.lit("\\\\")), F.lit(r"\\[1-9kGQRX]"))
    return F.when(known, F.length(F.regexp_replace(plain, r"\(\?[a-z-]*:|[()|^$]", "")) + 1)


def anchor(literal: Column) -> Column:
    """The longest run of a literal without white space: wherever the literal is, it lies in one word."""
    runs = F.regexp_extract_all(_one_sigma(literal), F.lit(r"\S+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run")))).run, F.lit(""))


#: White space of a pattern (Java) that was RE2's.
_SPACE = r"\[\\t\\n\\f\\r \]"


def asked_word(pattern: Column, space: str = _SPACE) -> Column:
    """The word for which a pattern (Java) asks between such white space or the ends of the text; null for other patterns."""
    inner = F.regexp_extract(pattern, rf"(?s)\A(?:\(\?d\))?\(\?:(?:\^|\\A)\|{space}\)(.+)\(\?:{space}\|\\z\)\z", 1)
    literal = (inner != "") & ~F.rlike(F.regexp_replace(inner, r"\\[^A-Za-z0-9]", ""), F.lit(r"[.^$|()\[\]?*+{}\\]"))
    word = F.regexp_replace(inner, r"\\([^A-Za-z0-9])", "$1")
    return F.when(literal & ~F.rlike(word, F.lit(r"\s")), word)


def whole_word(pattern: Column) -> Column:
    """The folded word for which a pattern (Java) asks between white space or the ends of the text; null for other patterns."""
    return _one_sigma(fold(asked_word(pattern, rf"(?:\\s|{_SPACE})")))


def _one_sigma(folded: Column) -> Column:
    """Folding tells the last sigma of a word; where a text is cut, that may be another one."""
    return F.translate(folded, "ς", "σ")


def _pieces(rows: DataFrame, id_cols: Sequence[str], side: int, beyond: int) -> DataFrame:
    """Pieces of the texts: _row and _size of the text, _at characters before the piece's own CORE, _piece with ``side`` more in front and ``beyond`` behind."""
    cores = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{CORE}}}"), F.lit(0))
    texts = rows.select(*id_cols, F.monotonically_increasing_id().alias("_row"), F.length("_text").alias("_size"), F.explode(F.array(cores)).alias("_cores"))
    at = lambda n: F.coalesce(F.get("_cores", n), F.lit(""))
    cut = lambda c, n: F.struct((n * CORE).alias("_at"), F.concat(F.right(at(n - 1), F.lit(side)), c, F.left(at(n + 1), F.lit(beyond))).alias("_piece"))
    return texts.select(*id_cols, "_row", "_size", F.inline(F.transform("_cores", cut)))


def word_findings(rows: DataFrame, rules: DataFrame, id_cols: Sequence[str], shortest: int, longest: int) -> DataFrame:
    """``findings`` of rules that ask for a whole word ``_asked`` (see asked_word) of so many characters, over rows with ``_text``.

    Such a rule fires where a word of the text equals its own, so no pattern runs, and no text is moved: pieces are cut into words with their places in front
    of the only shuffle, by word, after which each word of a text is kept once and meets the rules in a sort-merge join. A snippet is moved only where the caller uses it.
    """
    side = SNIPPET + 1
    pieces = _pieces(rows, id_cols, side, longest + SNIPPET)
    spaced = F.translate("_piece", "\t\n\f\r", "    ")
    # One character in front, a space at the text's start; a word that goes on behind what is seen is longer than any that a rule asks for.
    seen = F.when(F.col("_at") > 0, F.substring(spaced, side, 1 + CORE + longest)).otherwise(F.concat(F.lit(" "), F.substring(spaced, 1, CORE + longest)))
    words = F.filter(F.array_distinct(F.split("_seen", " ")), lambda w: F.length(w).between(shortest, longest))
    met = once(pieces, F.concat(seen, F.lit(" ")), "_seen").withColumn("_word", F.explode(words))
    met = once(met, F.position(F.concat(F.lit(" "), "_word", F.lit(" ")), F.col("_seen")), "_in").where(F.col("_in").between(1, CORE))

    place, before = F.col("_at") + F.col("_in"), F.when(F.col("_at") > 0, side).otherwise(0)
    start = F.greatest(place - 1, F.lit(1))
    low, high = F.greatest(start - SNIPPET, F.lit(1)), F.least(place + F.length("_word"), F.col("_size")) + SNIPPET
    body = F.substring("_piece", low - F.col("_at") + before, F.least(high, F.col("_size")) - low + 1)
    snippet = F.concat(F.when(low > 1, "…").otherwise(""), body, F.when(high < F.col("_size"), "…").otherwise(""))
    words = met.select(*id_cols, "_row", "_word", start.alias("start"), snippet.alias("snippet")).repartition("_word")
    first = words.groupBy("_word", "_row", *id_cols).agg(F.min("start").alias("start"), F.min_by("snippet", "start").alias("snippet"))
    fields = ["ord", "rule_id", "rule_name", "severity", "mode"]
    return first.join(rules.select(F.col("_asked").alias("_word"), *fields).hint("merge"), "_word").select(*id_cols, *fields, "start", "snippet")


def short_findings(rows: DataFrame, rules: DataFrame, id_cols: Sequence[str], longest: int) -> DataFrame:
    """``findings`` of rules with literals that reach over ``longest`` characters at most (see reach), over rows with ``_text``.

    Texts are cut into pieces. The distinct words of all pieces (with the text's cut ends) meet the literals by all their substrings of
    a literal's length; pieces then meet the rules of their words. Both are joins by equality, none of them by a broadcast of all rules. A rule
    runs on a piece that overlaps the next ones, for matches that do not start behind the piece's own part; of a row's pieces the first counts.
    """
    side = max(longest, SNIPPET + 1)
    pieces = _pieces(rows, id_cols, side, longest + side)
    before = F.when(F.col("_at") > 0, side).otherwise(0)
    seen = _one_sigma(fold(F.substring("_piece", before + 1, F.lit(CORE + longest))))
    index = rules.withColumn("_k", F.monotonically_increasing_id()).select("_k", "ord", "rule_id", "rule_name", "severity", "mode", "pattern_java", F.explode(F.transform("keywords", anchor)).alias("_anchor"), "keywords")
    # A literal that must be a whole word has a space behind it: no word and no part of one is like that.
    index = index.withColumn("_whole", F.coalesce(whole_word(F.col("pattern_java")) == F.col("_anchor"), F.lit(False)) & (F.size("keywords") == 1)).drop("keywords")
    known = sorted((r.n, r._whole) for r in index.select(F.length("_anchor").alias("n"), "_whole").distinct().collect())
    lengths = [n for n, alone in known if not alone]
    index = index.withColumn("_anchor", F.when(F.col("_whole"), F.concat("_anchor", F.lit(" "))).otherwise(F.col("_anchor"))).drop("_whole")
    words = F.array_distinct(F.filter(F.regexp_extract_all(seen, F.lit(r"\S+"), F.lit(0)), lambda w: F.length(w) >= known[0][0]))
    met = pieces.withColumn("_word", F.explode(words))

    fitting = lambda w: F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(w))
    substrings = F.flatten(F.transform(fitting(F.col("_word")), lambda n: F.transform(F.sequence(F.lit(1), F.length("_word") - n + 1), lambda i: F.substring(F.col("_word"), i, n))))
    held = met.select("_word").distinct().withColumn("_anchor", F.explode(F.concat(F.array_distinct(substrings), F.array(F.concat("_word", F.lit(" "))))))
    pairs = met.join(held.join(index, "_anchor").drop("_anchor"), "_word")

    # The piece's start is not the text's; a match in front of its own part is a true one, which the piece before has.
    pattern = F.when(F.col("_at") > 0, F.concat(F.lit(r"(?!\A)(?:"), "pattern_java", F.lit(")"))).otherwise(F.col("pattern_java"))
    pairs = pairs.withColumn("_pattern", pattern)
    beyond = F.length(F.call_function("regexp_extract", F.col("_piece"), F.concat(F.lit(r"\A((?s:.*?))(?:"), "_pattern", F.lit(")")), F.lit(1))) + 1
    met = once(pairs, F.regexp_instr("_piece", F.col("_pattern")), "_place").where("_place > 0")  # counts characters beyond 16 bits twice
    place = F.when(F.rlike("_piece", F.lit(r"[\x{10000}-\x{10FFFF}]")), beyond).otherwise(F.col("_place"))
    found = once(met, place, "_in").where((F.col("_in") > before) & (F.col("_in") <= before + CORE))
    found = found.withColumns({"start": F.col("_in") + F.col("_at") - before, "_match": F.regexp_substr("_piece", F.col("_pattern"))})
    low, high = F.greatest(F.col("start") - SNIPPET, F.lit(1)), F.col("start") + F.length("_match") + SNIPPET - 1
    body = F.substring("_piece", F.col("_in") - (F.col("start") - low), F.least(high, F.col("_size")) - low + 1)
    snippet = F.concat(F.when(low > 1, "…").otherwise(""), body, F.when(high < F.col("_size"), "…").otherwise(""))
    fields = ["ord", "rule_id", "rule_name", "severity", "mode"]
    first = found.withColumn("snippet", snippet).groupBy("_row", "_k", *id_cols, *fields).agg(F.min("start").alias("start"), F.min_by("snippet", "start").alias("snippet"))
    return first.select(*id_cols, *fields, "start", "snippet")
