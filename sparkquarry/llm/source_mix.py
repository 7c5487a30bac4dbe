"""Mixing sources to target weights (10): weighted fair queueing over shuffled documents.

Targets: sources in code-point order, null last, weigh 3, 1, 2, repeating, and share 150 % of all
words; a target stops at twice its source's size and the excess is shared again by weight.
Each source may be played twice.  A play of a document has a virtual finish time: the words its source
has queued up to it, divided by the source's target (its fair rate).  All plays are ordered by that time
and the order is cut where the total budget is spent, so every source ends within a document of its
target; a play is in if more than half of it fits, in its source's queue and in the whole.

Queues are cut into slices of about SLICE documents by the leading bits of the shuffle key, so the running
sums of a source that owns a third of the corpus are many small windows plus one window over slice totals;
the global order likewise by ranges of finish time.  Nothing is collected.

Defined results: null or wordless texts have size 0 and are taken with 0 words; a null source is a source
of its own, weighed last; a null id is shuffled as an empty id; rows that repeat an id are separate
documents, and rows alike in id, source and size are numbered, which gives each its own place in the
shuffle (they are alike in the result, so it doesn't matter which has which number); no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquarry.llm.tables import cut, load

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SLICE, PART = 50_000, 100_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from sizes(source, size).

    The fixed point of capping and sharing again is target = min(most * source_size, level * weight):
    with sources in order of cap / weight, those below the level are capped.  The windows run over one
    row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights)) + 1).cast("double")
    whole = Window.partitionBy()
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    per = per.withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    # the level if just the sources before this one are capped; the first source that stays under its cap sets it
    per = per.withColumn("try", (F.col("budget") - capped) / left)
    free = F.col("try") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "try"))).over(whole)["try"]
    return per.withColumn("level", level).select(
        "source", "source_size", "weight", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))).alias("target")
    )


def numbered(rows: DataFrame, same: list[str]) -> DataFrame:
    """rows with ``nth``: 0, 1, ... among rows that are alike in ``same``; rows(part, ...) says which written part a row lies in.

    Only rows with a like are numbered: inside their part, after the counts of the parts before, so rows
    alike by the million are many small windows.
    """
    per = rows.groupBy(*same, "part").agg(F.count("*").alias("_rows"))
    ahead = F.sum("_rows").over(Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("_rows").over(Window.partitionBy(*same))
    per = per.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).withColumn("_all", whole).where("_all > 1")
    per = per.select(*[F.col(c).alias(f"_{c}") for c in (*same, "part")], "_ahead")
    met = [rows[c].eqNullSafe(per[f"_{c}"]) for c in same] + [rows["part"] == per["_part"]]
    both = rows.join(per, met, "left").drop(*[f"_{c}" for c in (*same, "part")])
    alike, alone = both.where("_ahead IS NOT NULL"), both.where("_ahead IS NULL").withColumn("nth", F.lit(0).cast("long"))
    inside = F.row_number().over(Window.partitionBy(*same, "part").orderBy(F.lit(0))) - 1
    return alike.withColumn("nth", F.col("_ahead") + inside).unionByName(alone).drop("_ahead", "part")


def mix(docs: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, plays (how often the mix takes it)."""
    sized = cut(docs.select("doc_id", "source", n_words().alias("size"), F.floor(F.monotonically_increasing_id() / PART).alias("part")))
    sized = cut(numbered(sized, ["doc_id", "source", "size"]))
    aims = cut(targets(sized, **shares))
    plays = sized.where("size > 0").withColumn("play", F.explode(F.array(F.lit(0), F.lit(1))))
    name = F.concat_ws(":", F.lit(seed), "play", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("nth") > 0, F.col("nth").cast("string")))
    slices = max(16, sized.count() // SLICE)
    plays = plays.withColumn("key", F.md5(name.cast("binary")))
    leading = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    plays = plays.withColumn("slice", F.col("play") * slices + F.shiftright(leading * slices, 28))
    totals = plays.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    queue = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("before", F.coalesce(F.sum("words").over(queue), F.lit(0))).drop("words")
    before = before.join(aims.select("source", "target"), before["source"].eqNullSafe(aims["source"])).select(before["source"].alias("of"), F.col("slice").alias("at"), "before", "target")
    inside = Window.partitionBy("source", "slice").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = plays.withColumn("run", F.sum("size").over(inside))
    queued = queued.join(before, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at")))
    queued = queued.select("doc_id", "source", "size", "nth", "play", "key", (F.col("before") + F.col("run")).alias("queued"), "target")
    queued = queued.where(F.col("queued") - F.col("size") / 2 <= F.col("target")).withColumn("finish", F.col("queued") / F.col("target"))
    timed = cut(queued.withColumn("range", F.floor(F.least("finish", F.lit(4.0)) * 65536)))
    budget = aims.agg(F.sum("target").alias("budget"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = timed.groupBy("range").agg(F.sum("size").alias("words")).withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
    order = Window.partitionBy("range").orderBy("finish", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    served = timed.withColumn("run", F.sum("size").over(order)).join(ranges, "range").crossJoin(F.broadcast(budget))  # one row
    taken = served.where(F.col("ahead") + F.col("run") - F.col("size") / 2 <= F.col("budget"))
    counts = taken.groupBy("doc_id", "source", "size", "nth").agg(F.count("*").alias("n"))
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size", "nth")], "n")
    out = sized.join(counts, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("doc_id", "source", "size", "nth")], "left")
    aims = aims.withColumnRenamed("source", "_of")
    out = out.join(F.broadcast(aims) if aims.count() <= 100_000 else aims, F.col("source").eqNullSafe(F.col("_of")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("n", F.lit(0)).cast("long").alias("plays"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("plays")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS nth
  FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents)),
per AS (
  SELECT source, source_size, CAST(2 * source_size AS DOUBLE) AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
tries AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
chosen AS (SELECT level FROM tries WHERE level * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1),
aims AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM chosen) * weight), cap) AS target FROM per),
plays AS (
  SELECT doc_id, source, size, nth, play, md5('mix:' || play || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || CASE WHEN nth > 0 THEN ':' || nth ELSE '' END) AS key
  FROM d CROSS JOIN (VALUES (0), (1)) AS p(play) WHERE size > 0),
queued AS (
  SELECT p.*, a.target, CAST(sum(size) OVER (PARTITION BY p.source ORDER BY play, key, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS queued
  FROM plays p JOIN aims a ON a.source IS NOT DISTINCT FROM p.source),
timed AS (SELECT *, CAST(queued AS DOUBLE) / target AS finish FROM queued WHERE queued - CAST(size AS DOUBLE) / 2 <= target),
served AS (SELECT *, CAST(sum(size) OVER (ORDER BY finish, key, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM timed),
taken AS (
  SELECT doc_id, source, size, nth, count(*) AS n FROM served WHERE run - CAST(size AS DOUBLE) / 2 <= (SELECT sum(target) FROM aims) GROUP BY ALL)
SELECT d.doc_id, d.size, a.source_size, a.target, CAST(d.size * coalesce(t.n, 0) AS BIGINT) AS taken
FROM d JOIN aims a ON a.source IS NOT DISTINCT FROM d.source LEFT JOIN taken t ON t.doc_id IS NOT DISTINCT FROM d.doc_id AND t.source IS NOT DISTINCT FROM d.source AND t.size = d.size AND t.nth = d.nth
"""
