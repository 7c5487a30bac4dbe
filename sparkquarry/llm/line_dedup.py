"""Line dedup (5): three-line windows that occurred before are removed, wherever they repeat.

Every run of three consecutive lines of a text is hashed (MD5, 128 bits); of equal windows the first by
(doc_id, line) stays and each later one marks its three lines; overlapping marks merge into covered
positions, and the covered lines are removed.  Only window hashes travel.  The first occurrence comes
from min(), which is combined before the shuffle, and the join back meets one row a hash, so a window
in a third of all texts is a skewed side that AQE splits; nothing gathers a window's occurrences.

Defined results: null texts count as empty; a text has one line more than it has newlines; texts of
fewer than three lines have no window and stay whole; a window that repeats inside its own text is
removed there too; null ids come first in the order; rows that repeat an id are compared as one text
of several rows, so the same window at the same line of each stays in all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.llm.tables import cut, load

WINDOW = 3


def windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, line, hash) of each run of width lines; line counts from 0."""
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines")).where(F.size("lines") >= width)
    joined = F.transform(F.sequence(F.lit(1), F.size("lines") - (width - 1)), lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i, width), "\n").cast("binary"))))
    return lines.select("doc_id", F.posexplode(joined).alias("line", "hash"))


def covered_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, covered): the sorted positions of lines under a window that occurred before; only texts that have some."""
    found = cut(windows(docs, width))
    first = found.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line")).alias("first")).where("n > 1")
    later = found.join(first, "hash").where(~F.struct("doc_id", "line").eqNullSafe(F.col("first")))
    covered = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.col("line") + i)))))
    return later.groupBy("doc_id").agg(covered.alias("covered"))


def line_dedup(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, text without covered lines, n_lines, covered."""
    marks = covered_lines(docs, width).select(F.col("doc_id").alias("_id"), F.col("covered").alias("_covered"))
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    both = lines.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    covered = F.coalesce("_covered", F.array().cast("array<int>"))
    # array_except hashes, so a text whose lines are all covered costs its own length
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "_covered")
    kept = F.when(F.col("_covered").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.col("lines")[i]))
    return both.select("doc_id", F.array_join(kept, "\n").alias("text"), F.size("lines").alias("n_lines"), covered.alias("covered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.size("covered").cast("long").alias("n_removed"), F.md5(F.col("text").cast("binary")).alias("clean_md5"))


ORACLE = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM s),
w AS (
  SELECT doc_id, i, line, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, i) AS nth FROM w WHERE c IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM r CROSS JOIN (VALUES (0), (1), (2)) AS o(k) WHERE nth > 1)
SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
       md5(coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '')) AS clean_md5
FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
"""
