"""Choosing the floors of confident routing: the exact optimum over every breakpoint of score and margin.

A case is confident if its score and margin reach the floors.  Wanted is the pair of floors with no wrong confident case, the
most correct ones, then the least fanout, then the highest floors.  For one score floor the margin floor is settled: it must lie above
W, the largest margin of a wrong case that reaches the score floor.  So a correct case of score s and margin g counts
for the score floors up to s and above S, the highest score of a wrong case whose margin is g or more: an
interval.  The best floor is where most intervals overlap: two running sums over the sorted scores, no pair of floors is ever
built.  Values are summed first and sorted in ranges of about ``RANGE_ROWS``, each a window of its own, with one window over the range totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.operators.evaluation import RANGE_ROWS, next_above

MAX_FANOUT = 3  # fixed value


def running(rows: DataFrame, order: str, totals: dict[str, str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows, one a value of ``order``, with each column of totals ("sum" or "max") taken over all rows from the highest value down to this one."""
    ranges = min(4096, rows.count() // range_rows + 1)
    cuts = sorted(set(rows.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []  # at most 4096 numbers
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x > F.col(order))) if cuts else F.lit(0)
    ranged = rows.withColumn("_range", above)
    how = {"sum": F.sum, "max": F.max}
    down = Window.partitionBy("_range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy("_range").agg(*(how[kind](c).alias(f"_{c}") for c, kind in totals.items()))
    whole = whole.select("_range", *(how[kind](f"_{c}").over(before).alias(f"_{c}") for c, kind in totals.items()))
    inside = ranged.select("_range", *(how[kind](c).over(down).alias(c) if (kind := totals.get(c)) else F.col(c) for c in rows.columns))
    both = inside.join(F.broadcast(whole), "_range")  # a row a range
    both_of = {"sum": lambda c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)), "max": lambda c: F.greatest(c, f"_{c}")}
    return both.select(*(both_of[totals[c]](c).alias(c) if c in totals else F.col(c) for c in rows.columns))


def calibration_cases(cases: DataFrame) -> DataFrame:
    """The cases that floors are chosen on: those of the calibration split, without the ones that name their own corpus."""
    return cases.where("split = 'calibration' AND role <> 'named_self'")


def case_violations(cases: DataFrame) -> DataFrame:
    """(query_id, reason) of calibration cases(query_id, role, expected, fallback, subject) that no floors can be chosen on.

    expected and fallback are arrays of namespaces: a case expects exactly one, and a contrast case finds it in its fallback, which doesn't begin with its subject.
    """
    contrast = F.col("role") == "contrast_other"
    inside = F.size(F.array_except("expected", F.coalesce("fallback", F.array().cast("array<string>")))) == 0
    first = F.try_element_at("fallback", F.lit(1))
    reasons = {
        "expects several namespaces or none": F.coalesce(F.size("expected"), F.lit(0)) != 1,
        "contrast case outside its fallback": contrast & ~F.coalesce(inside, F.lit(False)),
        "contrast case without a subject": contrast & F.col("subject").isNull(),
        "contrast case routed to its subject": contrast & F.coalesce(first == F.col("subject"), F.lit(False)),
    }
    return cases.select("query_id", F.explode(F.array_compact(F.array(*(F.when(x, F.lit(name)) for name, x in reasons.items())))).alias("reason"))


def _finite(x: str) -> Column:
    value = F.col(x).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def choose_floors(cases: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row for cases(score, margin, correct, ranked): score_floor, margin_floor, cases, correct, wrong, average_fanout.

    Floors are values of the cases or the next double above one.  A confident case has fanout 1, another min(ranked, MAX_FANOUT).
    A case without score or margin (null or not finite) is never confident.  No cases, no row.
    """
    fan = F.least(F.coalesce("ranked", F.lit(0)), F.lit(MAX_FANOUT)).cast("long")
    own = cases.select(_finite("score").alias("score"), _finite("margin").alias("margin"), F.coalesce("correct", F.lit(False)).alias("correct"), fan.alias("fan"))
    whole = own.agg(F.count("*").alias("cases"), F.sum("fan").alias("fan"), F.max("score").alias("top_score"), F.max("margin").alias("top_margin")).where("cases > 0")
    per = own.where("score IS NOT NULL").groupBy("score", "margin", "correct").agg(F.count("*").alias("n"), F.sum(F.col("fan") - 1).alias("saved"))

    wrong = per.where("margin IS NOT NULL").groupBy("margin").agg(F.max(F.when(~F.col("correct"), F.col("score"))).alias("barred"))
    barred = running(wrong, "margin", {"barred": "max"}, range_rows)
    spans = per.where("correct AND margin IS NOT NULL").join(barred, "margin").where("barred IS NULL OR barred < score")
    begin = spans.select("score", "n", "saved")
    end = spans.where("barred IS NOT NULL").select(F.col("barred").alias("score"), (-F.col("n")).alias("n"), (-F.col("saved")).alias("saved"))
    none = F.lit(0).cast("long")
    events = begin.unionByName(end).unionByName(per.select("score", none.alias("n"), none.alias("saved"))).groupBy("score").agg(F.sum("n").alias("n"), F.sum("saved").alias("saved"))
    runs = running(events.select("score", "n", "saved", F.col("n").alias("at_n"), F.col("saved").alias("at_saved")), "score", {"n": "sum", "saved": "sum"}, range_rows)
    # a floor at the score counts what begins or ends there, one just above doesn't
    floors = F.array(F.struct(F.col("n").alias("correct"), F.col("saved").alias("saved"), F.col("score").alias("floor")), F.struct((F.col("n") - F.col("at_n")).alias("correct"), (F.col("saved") - F.col("at_saved")).alias("saved"), next_above("score").alias("floor")))
    best = runs.select(F.explode(floors).alias("f")).agg(F.max("f").alias("f")).select("f.*")

    chosen = whole.crossJoin(F.broadcast(best))  # one row each
    in_reach = spans.crossJoin(F.broadcast(best.select("floor"))).where("score >= floor AND (barred IS NULL OR barred < floor)").agg(F.min("margin").alias("least"))
    out = chosen.crossJoin(F.broadcast(in_reach))
    return out.where("floor IS NOT NULL").select(
        F.col("floor").alias("score_floor"), F.coalesce("least", next_above(F.coalesce("top_margin", F.lit(0.0)))).alias("margin_floor"),
        "cases", "correct", F.lit(0).cast("long").alias("wrong"), ((F.col("fan") - F.col("saved")) / F.col("cases")).alias("average_fanout"),
    )
