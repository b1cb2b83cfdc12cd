"""Operator 12: what filters remove in every order and on average, from the Hart-Mas-Colell potential of the removal game."""

from __future__ import annotations

import math
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm.common import written

SPACE = r"[\x20\x09-\x0D]+"
#: All coalitions of the filters stand in one row, and all orders come out of it.
MOST_FILTERS = 6


def quality_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D: few words, repeated words, many capitals, marks of code or markup."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": capitals * 100 > F.length(text) * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failing_counts(docs: DataFrame, fails: dict[str, Column], id_col: str, text: Column, part: Column, outcomes: DataFrame | None, names: list[str]) -> DataFrame:
    """(part, mask, the outcomes ``names``, n, late): documents by the filters they fail (bits of ``mask``, in the order of
    ``fails``), and how many of them have a text that a row of a smaller id has too.

    Texts are equal when their SHA-256 are; no text is shuffled, only its digest. Copies are counted inside the tasks before
    the shuffle on the digest, so that a text that fills a third of the table comes there as some rows from each task.
    """
    mask = reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(False)), 1 << k).otherwise(0) for k, c in enumerate(fails.values())], F.lit(0))
    digest, no_id = F.unhex(F.sha2(text.cast("binary"), 256)), F.col(id_col).isNull()
    rows = docs.select(F.col(id_col).alias("id"), digest.alias("digest"), part.alias("part"), mask.alias("mask"))
    # Rows without an id have no outcome; their own keys spread them over the tasks of the join.
    rows = rows.withColumn("key", F.coalesce(F.col("id").cast("long"), F.xxhash64("digest", "part")))
    if outcomes is not None:
        held = outcomes.groupBy(F.col(id_col).cast("long").alias("_id")).agg(*[F.max(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in names])
        rows = rows.join(held, (F.col("key") == F.col("_id")) & F.col("id").isNotNull(), "left")
    rows = rows.select("key", F.struct(F.col("id").isNull().alias("no_id"), "id").alias("id"), "digest", "part", "mask", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in names])
    alike = ["digest", "part", "mask", *names]
    rows = rows.groupBy("key", "id", *alike).agg(F.count("*").alias("n"))  # the join's partitioning serves: no shuffle
    groups = written(rows.groupBy(*alike).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first")))
    least = groups.groupBy("digest").agg(F.min("first.id").alias("least"))
    early = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    return groups.join(least, "digest").groupBy("part", "mask", *names).agg(F.sum("n").alias("n"), F.sum(F.col("n") - early).alias("late"))


def with_potential(games: DataFrame, removed: str, n: int, out: str) -> DataFrame:
    """``games`` with ``out``: for each of n filters the sum over all n! orders of what it removes.

    ``removed`` is an array of what each coalition (a bit set of filters) removes. A coalition's potential is what it removes
    and the potentials of the coalitions without one of its filters, divided by its size; a filter's Shapley value is the
    potential of all filters less that of all others. Potentials times n! are whole numbers, so all of it is exact.
    """
    whole, last = math.factorial(n), (1 << n) - 1
    rows = games.withColumn("_p0", F.lit(0).cast("long"))
    for size in range(1, n + 1):
        level = [s for s in range(1, last + 1) if s.bit_count() == size]
        smaller = {s: " + ".join(f"_p{s & ~(1 << f)}" for f in range(n) if s >> f & 1) for s in level}
        rows = rows.withColumns({f"_p{s}": F.expr(f"({removed}[{s}] * {whole}L + {smaller[s]}) div {size}L") for s in level})
    shares = F.array(*[F.col(f"_p{last}") - F.col(f"_p{last & ~(1 << f)}") for f in range(n)])
    return rows.withColumn(out, shares).drop(*[f"_p{s}" for s in range(last + 1)])


def filter_audit(
    docs: DataFrame, fails: dict[str, Column], repeat: str | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
    outcomes: DataFrame | None = None, lost: dict[str, str] | None = None,
) -> DataFrame:
    """One row per part, filter order and step: what each filter removes there, and what it removes anyhow.

    ``fails`` has a failure condition for each filter's letter; ``repeat`` is the letter of one more, which a text fails
    that a row of a smaller id has too, anywhere in the table. Columns: part, filter_order, step, kept, removed, redundant
    (fails this filter, but an earlier one removed it), unique_fails (fails no other one), for each ``lost`` name the rows
    removed here for which that boolean column of ``outcomes`` (id_col and these columns) is true, and shapley (removed by the filter, summed over all orders).

    The table is read once and counted by part and set of failed filters; what each of the 2^n coalitions removes are sums
    of these counts, and all else comes from them: steps are differences of coalitions, shapley is a difference of potentials.

    Null parts and empty ones are one part, "". Null texts are empty; null conditions are no failures. Null ids are larger than all
    others and have no outcome; rows that share an id are no smaller than each other, so that rows repeated as a whole do not fail ``repeat``
    for each other. Several outcomes of an id count as true if one is. An empty table gives no rows. Further columns are ignored.
    """
    letters, names = [*fails, *([repeat] if repeat else [])], list(lost or {})
    n = len(letters)
    if not 0 < n <= MOST_FILTERS or any(len(x) != 1 for x in letters):
        raise ValueError(f"filters have one letter each and number from 1 to {MOST_FILTERS}")
    flags = outcomes.select(id_col, *[F.col(c).alias(name) for name, c in lost.items()]) if outcomes is not None and lost else None
    text, part = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(part_col), F.lit(""))
    counts = failing_counts(docs, fails, id_col, text, part, flags, names)

    late_bit = 1 << len(fails) if repeat else 0
    by_coalition = lambda rows, s: F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, rows[0]).otherwise(rows[1] if s & late_bit else 0))
    sums = lambda rows: F.array(*[by_coalition(rows, s) for s in range(1 << n)])
    always, never = (F.col("n"), F.col("late")), F.lit(0)
    alone = [F.sum(F.when(F.col("mask") == 1 << k, F.col("n") - F.col("late") if repeat else F.col("n")).otherwise(0)) for k in range(len(fails))]
    if repeat:
        alone.append(F.sum(F.when(F.col("mask") == 0, F.col("late")).otherwise(0)))
    games = counts.groupBy("part").agg(
        F.sum("n").alias("rows"), sums(always).alias("removed"), F.array(*alone).alias("alone"),
        *[sums(tuple(F.when(F.col(c), x).otherwise(never) for x in always)).alias(c) for c in names],
    )
    games = with_potential(games, "removed", n, "shares")

    orders = ",".join("".join(p) for p in permutations(letters))
    rows = games.select("*", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    place = lambda k: F.expr(f"instr('{''.join(letters)}', substring(filter_order, {k}, 1)) - 1")
    earlier = F.expr(f"aggregate(sequence(0, step - 1), 0, (s, k) -> if(k = 0, s, s + shiftleft(1, instr('{''.join(letters)}', substring(filter_order, k, 1)) - 1)))")
    rows = rows.withColumns({"f": place("step"), "before": earlier})
    rows = rows.withColumn("after", F.col("before") + F.expr("shiftleft(1, f)"))
    here = lambda c: F.expr(f"`{c}`[after] - `{c}`[before]")
    return rows.select(
        "part", "filter_order", "step", F.expr("rows - removed[after]").alias("kept"), here("removed").alias("removed"),
        F.expr("removed[shiftleft(1, f)] - (removed[after] - removed[before])").alias("redundant"), F.expr("alone[f]").alias("unique_fails"),
        *[here(c).alias(c) for c in names], F.expr("shares[f]").alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return filter_audit(docs, quality_filters(text), "E", outcomes=labels, lost={"good_lost": "good", "toxic_lost": "toxic"})


#: By its definition: each order and step over the sets of failed filters, and sums over all orders.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * len(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, d.doc_id IS NULL AND min(d.doc_id) OVER (PARTITION BY t) IS NOT NULL) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY part, fails
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS c, '[' || substr(filter_order, 1, step) || ']' AS upto, '[' || substr(filter_order, 1, step - 1) || '-]' AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, c,
         CAST(sum(CASE WHEN NOT regexp_matches(fails, upto) THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN contains(fails, c) AND NOT regexp_matches(fails, before) THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN contains(fails, c) AND regexp_matches(fails, before) THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN fails = c THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN contains(fails, c) AND NOT regexp_matches(fails, before) THEN n_good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN contains(fails, c) AND NOT regexp_matches(fails, before) THEN n_toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, c
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
FROM r
"""
