"""Filter interaction audit (11): forward-backward path counting over the lattice of filter subsets.

A filter of the pipeline is a failure condition.  Every document is reduced to the bit set of the filters
that it fails, and documents are counted by (part, bit set): all that any order of the filters does to the
corpus follows from these counts.  The states of the lattice are the subsets of filters already applied; an
edge applies one more filter and removes the documents that fail it and none of the state's.  ``lattice``
counts the orders that reach a state and those that leave it; an edge lies on forward * backward orders, so
the Shapley sums weigh each edge's removals by that product, and the steps of every order read the
counts of the same edges.

Only the bit sets (32 for five filters) by part stand behind the report, so its cost is one scan, the joins of
the labels and of repeated texts, and a table whose size depends on the filters and parts alone.  The orders are
all permutations: meant for up to six filters, which the docstring of ``audit`` repeats.

Defined results: a null text counts as empty; a null part is the part of the empty string; a null id has no
labels, no smaller id and is nobody's smaller id; rows that repeat an id are counted each, and equal texts of
one id don't repeat one another; an id that has several label rows is good or toxic if one of them says so; no
documents give no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.llm.tables import cut, load

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
STEP = "filter_order string, step int, state int, bit int"


def text_failures() -> dict[str, Column]:
    """The text filters of the contract by letter: short, repetitive, shouting, symbols; over a column ``text`` without nulls and ``words``, its words."""
    return {
        "A": F.size("words") < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > 3 * F.length("text"),
        "D": F.col("text").rlike(SYMBOLS),
    }


def lattice(filters: int) -> tuple[dict[int, int], dict[int, int]]:
    """How many orders reach each subset of filters from the empty one, and how many lead from it to the full one."""
    full = 2**filters - 1
    reach, leave = dict.fromkeys(range(full + 1), 0) | {0: 1}, dict.fromkeys(range(full + 1), 0) | {full: 1}
    for state in range(full):  # a subset is a smaller number than any set that holds it
        for bit in range(filters):
            if not state >> bit & 1:
                reach[state | 1 << bit] += reach[state]
    for state in range(full - 1, -1, -1):
        leave[state] = sum(leave[state | 1 << bit] for bit in range(filters) if not state >> bit & 1)
    return reach, leave


def repeats(rows: DataFrame) -> DataFrame:
    """rows(doc_id, digest, ...) with ``repeated``: a smaller id has the same digest.

    The smallest id comes from min(), combined before the shuffle; the digests that stand more than once are written, a row each,
    so that the join has exchanges of its own and a digest of a third of all rows is a skewed side that AQE splits.
    """
    first = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1").select(F.col("digest").alias("_digest"), "_first"))
    both = rows.join(first, F.col("digest") == F.col("_digest"), "left")
    return both.withColumn("repeated", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))).drop("_digest", "_first")


def failed_sets(docs: DataFrame, failures: dict[str, Column], repeat: str | None, part: str) -> DataFrame:
    """(doc_id, part, mask) of every row: bit i of mask says that the i-th filter fails; ``repeat`` names the filter of repeated texts, the last one."""
    texts = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    mask = sum((F.when(failed, 2**bit).otherwise(0) for bit, failed in enumerate(failures.values())), F.lit(0))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)) if repeat else F.lit(None).cast("binary")
    rows = cut(texts.select("doc_id", "part", mask.cast("int").alias("mask"), digest.alias("digest")))
    if repeat:
        rows = repeats(rows).withColumn("mask", F.col("mask") + F.when(F.col("repeated"), 2 ** len(failures)).otherwise(0))
    return rows.select("doc_id", "part", "mask")


def audit(docs: DataFrame, labels: DataFrame, failures: dict[str, Column], repeat: str | None = "E", part: str = "lang") -> DataFrame:
    """One row per (part, filter_order, step): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    failures: filters by name (one letter each) over columns ``text`` and ``words``; repeat: a last filter that fails rows whose exact text
    a smaller id has.  All orders are listed, so at most six filters.
    """
    names = [*failures, *([repeat] if repeat else [])]
    if len(names) > 6:
        raise ValueError("all orders of the filters are listed; six filters are the most")
    spark = docs.sparkSession
    told = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = failed_sets(docs, failures, repeat, part).join(told, F.col("doc_id") == F.col("_id"), "left")
    seen = rows.groupBy("part", "mask").agg(F.count("*").alias("rows"), *(F.count(F.when(F.col(c), 1)).alias(c) for c in ("good", "toxic")))
    seen = cut(seen)

    reach, leave = lattice(len(names))
    edges = [(state, bit, reach[state] * leave[state | 1 << bit]) for state in reach for bit in range(len(names)) if not state >> bit & 1]
    at = seen.withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit(len(reach) * len(names) - 1))))
    at = at.withColumn("state", (F.col("edge") / len(names)).cast("int")).withColumn("bit", F.col("edge") % len(names)).where("state & shiftleft(1, bit) = 0")
    fails, gone = F.expr("mask & shiftleft(1, bit)") != 0, F.expr("mask & state") != 0
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).alias
    counted = at.groupBy("part", "state", "bit").agg(
        total("rows", ~gone & ~fails)("kept"),
        total("rows", ~gone & fails)("removed"),
        total("rows", gone & fails)("redundant"),
        total("rows", F.col("mask") == F.expr("shiftleft(1, bit)"))("unique_fails"),
        total("good", ~gone & fails)("good_lost"),
        total("toxic", ~gone & fails)("toxic_lost"),
    )
    counted = cut(counted)
    on_orders = F.broadcast(spark.createDataFrame(edges, "state int, bit int, orders long"))  # at most 6 * 2**5 rows
    shapley = counted.join(on_orders, ["state", "bit"]).groupBy("part", "bit").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))

    steps = []
    for order in permutations(range(len(names))):
        state = 0
        for step, bit in enumerate(order, 1):
            steps.append(("".join(names[b] for b in order), step, state, bit))
            state |= 1 << bit
    paths = spark.createDataFrame(steps, STEP)
    report = counted.join(shapley, ["part", "bit"]).join(F.broadcast(paths), ["state", "bit"])  # at most 6! * 6 rows
    return report.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), text_failures())


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT d.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
m AS (SELECT part, unnest(['A', 'B', 'C', 'D', 'E']) AS filter, unnest([a, b, c, d, e]) AS fails,
             concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed,
             good, toxic FROM f),
g AS (SELECT part, filter, failed, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
  WHERE p.x <> q.x AND p.x <> r.x AND p.x <> s.x AND p.x <> t.x AND q.x <> r.x AND q.x <> s.x AND q.x <> t.x AND r.x <> s.x AND r.x <> t.x AND s.x <> t.x),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i:i] AS filter, filter_order[1:i - 1] AS before FROM o, range(1, 6) AS r(i)),
z AS (
  SELECT part, filter_order, step, s.filter, n, good, toxic, fails, failed, regexp_matches(failed, '[_' || before || ']') AS gone
  FROM s JOIN g ON g.filter = s.filter),
k AS (
  SELECT part, filter_order, step, filter,
         CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (gone AND fails), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (failed = filter), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS BIGINT) AS toxic_lost
  FROM z GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM k
"""
