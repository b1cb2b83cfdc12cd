"""Operator 13: credentials in texts, told apart from copied examples by how many owners hold the same value."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm.common import written

#: Kinds in the order that settles equal starts. The first three are found by their form alone, the last by its owners.
KINDS = ["assign", "access", "hex", "owned"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What a value looks like that somebody made up, or that names a thing.
_MADE_UP = re.compile(r"example|sample|dummy|changeme|placeholder|your|test|fake|xxxx|0000|1234|abcd", re.ASCII | re.IGNORECASE)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_TURN = re.compile(r"[A-Za-z][0-9]")
LONGEST = 200
#: Values that more owners hold are copies of an example. Two, not one, as sites mirror each other.
OWNERS = 2

Found = tuple[int, int, int, str]


def looks_live(value: str) -> bool:
    """Whether a value could be drawn at random: letters often turn into digits, many characters, no word of an example."""
    return len(value) <= LONGEST and len(_TURN.findall(value)) >= 3 and len(set(value)) >= 8 and not _MADE_UP.search(value) and not _UUID.fullmatch(value)


def candidates(text: str) -> list[Found]:
    """(kind, start, end, value) by start and kind: the spans of the first three kinds, and runs of 20 or more characters that
    look live and touch none of them.

    Keys and hexadecimal runs are parts of such runs, so that two passes over the text find all.
    """
    found = [(0, *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    runs = list(_RUN.finditer(text))
    for run in runs:
        for kind, pattern in ((1, _ACCESS), (2, _HEX)):
            found += [(kind, *m.span(), m[0]) for m in pattern.finditer(text, *run.span())]
    taken = sorted((a, b) for _, a, b, _ in found)
    at = 0
    for run in runs:
        start, end = run.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if not any(a < end and b > start for a, b in taken[at : at + 1]) and looks_live(run[0]):
            found.append((3, start, end, run[0]))
    return sorted(found)


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, max_owners: int = OWNERS
) -> DataFrame:
    """One row per document: id_col and spans, an array of struct<kind, start, end, owners, repos, live, copied> by start and kind.

    Spans of the kinds assign, access and hex always stay. Values are hashed, and the owners and repositories that hold a
    hash are counted over all documents (a repository is one of its owner; without ``repo_col`` each document is one). A value of more than ``max_owners`` owners
    is a copied example (``copied``); one of fewer that looks drawn at random is ``live``. Runs that are no base span are added as
    kind owned where they are live: a credential of one owner that no pattern of a vendor describes.

    Texts are scanned in narrow tasks; only spans and 16-byte hashes are shuffled. Owners are counted in steps of (hash,
    owner, repository), (hash, owner) and hash, each combined before its shuffle; a value that a third of all documents hold makes one skewed key in
    the join with these counts, which adaptive execution splits. Null texts are empty. Null owners count together as one owner, and null
    repositories as one of each owner. Rows that repeat an id, or have none, come back once each. Ties in start are settled by kind. An empty table
    gives no rows; further columns are ignored.
    """
    repo = F.col(repo_col).cast("string") if repo_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), repo.alias("repo"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    span = "struct<kind:int,start:int,end:int,key:binary,live:boolean>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("key", pa.binary()), ("live", pa.bool_())])
        for batch in batches:
            found = []
            for text in batch.column("text"):
                spans = candidates(text.as_py() or "")
                found.append([{"kind": k, "start": a, "end": b, "key": blake2b(v.encode(), digest_size=16).digest(), "live": looks_live(v)} for k, a, b, v in spans])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "owner", "repo")), pa.array(found, pa.list_(fields))], ["id", "owner", "repo", "found"])

    table = rows.mapInArrow(scan, f"id {kind}, owner string, repo string, found array<{span}>")
    # Numbered as it is written: what is read again has the numbers of the tasks that were committed.
    table = written(table.withColumn("row", F.monotonically_increasing_id()))
    held = table.select("row", "id", "owner", F.coalesce("repo", F.lit("") if repo_col else F.col("row").cast("string")).alias("repo"), F.explode("found").alias("f"))
    held = held.select("row", "id", "owner", "repo", "f.*")
    counts = held.groupBy("key", "owner", "repo").count().groupBy("key", "owner").agg(F.count("*").alias("repos"))
    counts = counts.groupBy("key").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    judged = held.select("row", "id", "key", "kind", "start", "end", "live").join(counts, "key")
    copied = F.col("owners") > max_owners
    judged = judged.withColumns({"live": F.col("live") & ~copied, "copied": copied})
    whole = F.struct("start", "kind", "end", "owners", "repos", "live", "copied")
    spans = judged.groupBy("row", "id").agg(F.array_sort(F.collect_list(F.when((F.col("kind") < 3) | F.col("live"), whole))).alias("spans"))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform("spans", lambda s: F.struct(F.get(names, s.kind).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.owners.alias("owners"), s.repos.alias("repos"), s.live.alias("live"), s.copied.alias("copied")))
    out = spans.select(F.col("id").alias(id_col), named.alias("spans"))
    empty = F.array().cast(out.schema["spans"].dataType)
    return out.unionByName(table.where(F.size("found") == 0).select(F.col("id").alias(id_col), empty.alias("spans")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    with_flag = lambda flag: F.size(F.filter("spans", lambda s: s[flag])).cast("long").alias(f"n_{flag}")
    base = F.filter("spans", lambda s: s.kind != "owned")
    return found.select(
        "doc_id", *[of(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), with_flag("live"), with_flag("copied")
    )


#: Matches lie between the pieces that their pattern leaves of a text, which gives their places.
OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), patterns AS (
  SELECT * FROM (VALUES
    (0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    (1, '(AKIA[A-Z0-9]{16,})'), (2, '([0-9a-f]{24,})'), (3, '([A-Za-z0-9+/_-]{20,})')) AS p(kind, pattern)
), lists AS (
  SELECT r, source, kind, regexp_extract_all(t, pattern) AS m, regexp_extract_all(t, pattern, 1) AS v, regexp_split_to_array(t, pattern) AS pieces
  FROM docs, patterns WHERE regexp_matches(t, pattern)
), each AS (
  SELECT r, source, kind, v[i] AS value, len(m[i]) AS n,
         CAST(list_sum(list_transform(pieces[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: len(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM lists)
), looked AS (
  SELECT r, source, kind, value, start, start + n AS stop,
         len(value) <= 200 AND len(regexp_extract_all(value, '[A-Za-z][0-9]')) >= 3 AND len(list_distinct(string_split(value, ''))) >= 8
         AND NOT regexp_matches(lower(value), 'example|sample|dummy|changeme|placeholder|your|test|fake|xxxx|0000|1234|abcd')
         AND NOT regexp_full_match(value, '[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}') AS looks
  FROM each WHERE kind > 0 OR len(value) >= 6
), found AS (
  SELECT * FROM looked WHERE kind < 3
  UNION ALL
  SELECT * FROM looked a WHERE kind = 3 AND looks AND NOT EXISTS (SELECT 1 FROM looked b WHERE b.kind < 3 AND b.r = a.r AND b.start < a.stop AND b.stop > a.start)
), owned AS (
  SELECT value, count(DISTINCT source) + CAST(bool_or(source IS NULL) AS BIGINT) AS owners FROM found GROUP BY value
), judged AS (
  SELECT r, kind, start, looks AND owners <= 2 AS live, owners > 2 AS copied, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS span
  FROM found JOIN owned USING (value)
), spans AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_owned,
         string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied
  FROM judged WHERE kind < 3 OR live GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_owned, 0) AS n_owned,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs LEFT JOIN spans USING (r)
"""
