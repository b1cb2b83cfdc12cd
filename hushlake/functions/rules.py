"""The rule catalogue as a DataFrame, with custom rules and overrides."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.functions import rule_data
from hushlake.functions.dialect import replacement_to_java, to_java
from hushlake.functions.literals import required_literals

REDACTED = "[REDACTED]"
SCHEMA = (
    "ord int, rule_id string, rule_name string, description string, pattern_re2 string, pattern_java string, severity string, mode string, "
    "replacement string, replacement_java string, validator string, keywords array<string>, guard string"
)
RANK = {"high": 3, "medium": 2, "low": 1}

#: Case folding of the prefilter: long s and the Kelvin sign fold to s and k, as (?i) does.
FOLD = ("ſK", "sk")


#: Patterns whose matches Java would look for in a time that grows with the square of a text, or faster, and the same
#: for Java. An address does not start behind a word, with dots (or % + -) between or not, but at the end of the match before:
#: it would have started at the word, and the search at every dot would go on to the same @. Between curl and its flag a carriage return is an ordinary
#: character, as it is for the dot, so that there is one way to cut a text into lines.
JAVA = dict(rule_data.FOR_JAVA)


def rule_row(ord_: int, rule_id: str, name: str, description: str, pattern: str, severity: str, mode: str, replacement: str, validator: str, keywords: list[str] | None = None, guard: str = "") -> tuple:
    """A rule's row. Without ``keywords`` the literals that its matches must hold are read off the pattern."""
    keywords = required_literals(pattern) if keywords is None else keywords
    return (ord_, rule_id, name, description, pattern, to_java(JAVA.get(pattern, pattern)), severity, mode, replacement, replacement_to_java(replacement), validator, keywords, guard)


#: Literals of the vendor rules whose words are patterns themselves.
_SPECIAL = {
    "etsy-access-token": ["etsy"], "linkedin-client-id": ["linked"], "linkedin-client-secret": ["linked"], "messagebird-api-token": ["message"],
    "messagebird-client-id": ["message"], "snyk-api-token": ["snyk"], "sonar-api-token": ["sonar"], "sumologic-access-token": ["sumo"],
    "cisco-meraki-api-key": ["meraki"], "okta-access-token": ["okta"], "privateai-api-token": ["private"], "sumologic-access-id": ["sumo"],
    "mailchimp-api-key": ["mailchimp"],
}
#: Literals of the general rules.
_GENERAL = {
    "http-basic-auth": ["authorization"], "http-bearer-token": ["bearer"],
    "generic-secret": ["key", "token", "bearer", "password", "passwd", "secret"], "db-connection-string": ["://", "jdbc:oracle:"], "email": ["@"],
    "internal-ip": ["10.", "172.", "192.168."],
}


#: Cheap patterns (Java) that match wherever the rule does, for rules whose literals are common or none.
GUARDS = {
    "ssn": r"\d-\d\d-\d", "credit-card": r"\d{13}", "sourcegraph-access-token": r"[a-fA-F0-9]{40}", "vault-service-token": r"hvs\.|s\.[a-zA-Z0-9\u017F\u212A]{24}",
    "db-connection-string": r"(?s)\A(?=[^/]*+/).*?[^@\s]{3}@[^\s'\"`]",
    "curl-auth-header": to_java(rule_data.CURL_HEADER), "curl-auth-user": to_java(rule_data.CURL_USER),
    "atlassian-api-token": to_java(rule_data.vendor_core(*rule_data.ATLASSIAN) + "|" + rule_data.token(rule_data.ATLASSIAN_TOKEN)),
    "airtable-personnal-access-token": r"pat[a-zA-Z0-9]{14}\.", "facebook-access-token": r"\d{15}[|%]",
}


@lru_cache(maxsize=1)
def builtin_rows() -> list[tuple]:
    """All rules in evaluation order: the general ones, then the others by id."""
    rows = [rule_row(0, i, n, f"{n} in a text", p, s, m, r, v, _GENERAL.get(i, []), GUARDS.get(i, "")) for i, n, s, m, r, v, p in rule_data.GENERAL]
    others = []
    for scoped, table in ((False, rule_data.VENDOR), (True, rule_data.SCOPED_VENDOR)):
        for rule_id, words, value in table:
            keywords = _SPECIAL.get(rule_id) or [w.lower() for w in words.split("|")]
            others.append((rule_id, rule_data.vendor(words, value, scoped), keywords, to_java(rule_data.vendor_core(words, value, scoped))))
    others += [(rule_id, pattern, keywords, GUARDS.get(rule_id, "")) for rule_id, keywords, pattern in rule_data.TOKEN]
    for rule_id, pattern, keywords, guard in sorted(others):
        severity = "medium" if rule_id in rule_data.MEDIUM else "high"
        rows.append(rule_row(0, rule_id, rule_id, f"A value of the form of a {rule_id.replace('-', ' ')}", pattern, severity, "block", REDACTED, "", keywords, guard))
    return [(n, *row[1:]) for n, row in enumerate(rows)]


def builtin_rules(spark: SparkSession) -> DataFrame:
    """One row for each built-in rule; ``ord`` is the order of evaluation."""
    return spark.createDataFrame(builtin_rows(), SCHEMA)


def load_rule_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Custom rules, overrides and context limits of a JSON config; a missing file is an empty config.

    Bad JSON, or a pattern that Java cannot compile, raises ValueError; the latter names the rule.
    """
    schema = (
        "overrides array<struct<id string, mode string, severity string>>, rules array<struct<id string, name string, description string, pattern string, "
        "severity string, mode string>>, context_limits map<string, int>"
    )
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
        config = None
    else:
        try:
            config = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).first()
        except Exception as e:
            raise ValueError(f"{path} is no rule config: {e}") from e
    rules = [] if config is None or config.rules is None else config.rules
    rows = []
    for n, r in enumerate(rules):
        java = to_java(r.pattern or "")
        try:
            jvm.java.util.regex.Pattern.compile(java)
        except Exception as e:
            raise ValueError(f"rule {r.id}: the pattern does not compile: {e}") from e
        rows.append(rule_row(n, r.id, r.name or r.id, r.description or "", r.pattern or "", r.severity or "high", r.mode or "block", REDACTED, ""))
    overrides = [] if config is None or config.overrides is None else [(n, o.id, o.mode, o.severity) for n, o in enumerate(config.overrides)]
    limits = {} if config is None or config.context_limits is None else dict(config.context_limits)
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(overrides, "n int, rule_id string, mode string, severity string"), limits


def add_rules(rules: DataFrame, custom: DataFrame) -> DataFrame:
    """Custom rules after all others, in their own order."""
    last = rules.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    moved = custom.crossJoin(F.broadcast(last)).withColumn("ord", F.col("ord") + F.col("last") + 1).drop("last")
    return rules.unionByName(moved)


def apply_overrides(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Mode and severity by rule id where overrides give them; of an id's several the last one (highest n) that gives the
    field counts, and unknown ids do nothing. Overrides are summed up by id first, so a rule stays one row."""
    given = lambda c: F.max_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("n")))
    o = overrides.groupBy("rule_id").agg(given("mode").alias("_mode"), given("severity").alias("_severity"))
    o = o.select("rule_id", F.expr("nullif(_mode, '')").alias("_mode"), F.expr("nullif(_severity, '')").alias("_severity"))
    joined = rules.join(o, "rule_id", "left")
    return joined.withColumns({"mode": F.coalesce("_mode", "mode"), "severity": F.coalesce("_severity", "severity")}).select(*rules.columns)


def set_mode(overrides: DataFrame, rule_id: str, mode: str) -> DataFrame:
    """The overrides with this rule's mode set; its severity, and other rules', stay."""
    old = overrides.where(F.col("rule_id") == rule_id)
    kept = overrides.where(~F.col("rule_id").eqNullSafe(F.lit(rule_id)))
    new = old.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max_by("severity", "n").alias("severity"))
    return kept.unionByName(new.select("n", F.lit(rule_id).alias("rule_id"), F.lit(mode).alias("mode"), "severity"))


def list_rules(rules: DataFrame, search: str = "") -> DataFrame:
    """Rules by severity, then name; ``search`` is looked for in name, id and description without regard to case."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("severity"))
    if search:
        word = search.lower()
        rules = rules.where(F.lower("rule_name").contains(word) | F.lower("rule_id").contains(word) | F.lower("description").contains(word))
    return rules.orderBy(F.coalesce(rank, F.lit(0)).desc(), F.lower("rule_name"), "ord")


def rule_label() -> Column:
    """The name, or the id in title case where they are equal."""
    return F.when(F.col("rule_name") == F.col("rule_id"), F.initcap(F.translate("rule_id", "-", " "))).otherwise(F.col("rule_name"))
