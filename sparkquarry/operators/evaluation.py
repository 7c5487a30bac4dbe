"""Graded retrieval metrics, routing metrics, evidence curves and threshold selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cut-offs, weights and gates of the metrics.
NDCG_K, PRECISION_K = 10, 5
WEIGHTS = {"ndcg": 0.55, "recall": 0.20, "mrr": 0.15, "precision": 0.10}
MAX_RISK_PERCENT = 5
EVIDENCE_GATES = {"risk": ("<=", 0.05), "recall": (">=", 0.95), "abstention": (">=", 0.90)}
RERANK_K, RERANK_IMPROVEMENT = 5, 0.03
RANGE_ROWS = 50_000


def graded_metrics(hits: DataFrame, judgments: DataFrame, key: str = "doc_id", k: int = NDCG_K) -> DataFrame:
    """One row a query of judgments(query_id, key, grade): ndcg, recall, mrr at k, precision at 5 and a composite of 0 to 100.

    A hit matches the judgment of its key; every judgment is credited once, at its best rank; a repeated
    judgment counts with its highest grade, and grades of 0 are no judgments.
    """
    wanted = judgments.where("grade > 0").groupBy("query_id", key).agg(F.max("grade").alias("grade"))
    best = hits.groupBy("query_id", key).agg(F.min("rank").alias("rank"))
    met = wanted.join(best, ["query_id", key], "left")
    gain = lambda grade, at: (F.pow(F.lit(2.0), grade) - 1) / F.log2(at + 1)
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), key))
    met = met.withColumn("ideal_rank", ideal)
    sums = met.groupBy("query_id").agg(
        F.count("*").alias("judged"),
        F.coalesce(F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank")))), F.lit(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal_rank") <= k, gain(F.col("grade"), F.col("ideal_rank")))).alias("ideal"),
        F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("found"),
        F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias("first_rank"),
        F.sum(F.when(F.col("rank") <= PRECISION_K, 1).otherwise(0)).alias("near"),
    )
    shown = hits.where(F.col("rank") <= PRECISION_K).groupBy("query_id").agg(F.count("*").alias("shown"))
    sums = sums.join(shown, "query_id", "left")
    out = sums.select(
        "query_id", "judged", "first_rank",
        (F.col("dcg") / F.col("ideal")).alias("ndcg"), (F.col("found") / F.col("judged")).alias("recall"),
        F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("near") / F.col("shown"), F.lit(0.0)).alias("precision"),
    )
    composite = sum((F.col(name) * weight for name, weight in WEIGHTS.items()), F.lit(0.0)) * 100
    return out.withColumn("composite", F.greatest(F.lit(0.0), F.least(F.lit(100.0), composite)))


def macro_average(metrics: DataFrame) -> DataFrame:
    names = ["ndcg", "recall", "mrr", "precision", "composite"]
    return metrics.agg(F.count("*").alias("cases"), *[F.avg(n).alias(n) for n in names])


def first_match(hits: DataFrame, expected: DataFrame, text: str) -> DataFrame:
    """(query_id, passed, rank): the first hit whose text holds an expected phrase, for pass or fail."""
    met = hits.join(expected, "query_id").where(F.contains(F.lower(text), F.lower("phrase")))
    first = met.groupBy("query_id").agg(F.min("rank").alias("rank"))
    return expected.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.col("rank").isNotNull().alias("passed"), "rank")


def routing_metrics(routes: DataFrame, expected: DataFrame) -> DataFrame:
    """One row for routes(query_id, namespace, rank, fanout, confident) against expected(query_id, namespace)."""
    hit = expected.join(routes.where("rank <= 3").select("query_id", "namespace", "rank"), ["query_id", "namespace"], "left")
    per = hit.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("rank").alias("found"), F.max(F.when(F.col("rank") == 1, 1).otherwise(0)).alias("first"))
    heads = routes.where("rank = 1").select("query_id", "fanout", "confident")
    both = per.join(heads, "query_id", "left")
    single = F.col("confident") & (F.col("fanout") == 1)
    return both.agg(
        F.count("*").alias("cases"),
        (F.sum("found") / F.sum("wanted")).alias("route_recall_at_3"),
        F.sum(F.when(F.col("found") == F.col("wanted"), 1).otherwise(0)).alias("complete_cases"),
        F.sum(F.when(single & (F.col("first") == 0), 1).otherwise(0)).alias("wrong_confident_singles"),
        F.avg("fanout").alias("average_fanout"),
        F.max("fanout").alias("max_fanout"),
    )


def threshold_grid(cases: DataFrame, scores: DataFrame, margins: DataFrame) -> DataFrame:
    """(score_floor, margin_floor, correct, wrong, fanout) for each pair of floors over cases(score, margin, correct).

    A case is confident if score and margin reach the floors; it then has fanout 1, else 3.  The floors are a
    stated small grid; cases are summed per grid cell before any shuffle.
    """
    grid = scores.select(F.col("value").alias("score_floor")).crossJoin(margins.select(F.col("value").alias("margin_floor")))
    met = cases.join(F.broadcast(grid), F.lit(True))
    sure = (F.col("score") >= F.col("score_floor")) & (F.col("margin") >= F.col("margin_floor"))
    return met.groupBy("score_floor", "margin_floor").agg(
        F.sum(F.when(sure & F.col("correct"), 1).otherwise(0)).alias("correct"),
        F.sum(F.when(sure & ~F.col("correct"), 1).otherwise(0)).alias("wrong"),
        F.sum(F.when(sure, 1).otherwise(3)).alias("fanout"),
    )


def confusion(observations: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """tp, fp, tn, fn of observations(useful, score) at a threshold, by keys; a null score is rejected."""
    accepted = F.coalesce(F.col("score") >= threshold, F.lit(False))
    count = lambda x: F.sum(F.when(x, 1).otherwise(0))
    return observations.groupBy(*keys).agg(
        count(accepted & F.col("useful")).alias("tp"), count(accepted & ~F.col("useful")).alias("fp"), count(~accepted & ~F.col("useful")).alias("tn"), count(~accepted & F.col("useful")).alias("fn")
    )


def risk_curve(observations: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(threshold, tp, fp, accepted, risk, recall) at every distinct score.

    Scores are summed first.  The running sums go over ranges of about ``range_rows`` distinct scores, each a
    window of its own, plus one window over the totals of the ranges.
    """
    per = observations.where("score IS NOT NULL").groupBy(F.col("score").alias("threshold")).agg(
        F.sum(F.when(F.col("useful"), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("useful"), 0).otherwise(1)).alias("n")
    )
    ranges = min(4096, per.count() // range_rows + 1)
    bounds = sorted(set(per.approxQuantile("threshold", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []  # at most 4096 numbers
    above = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x > F.col("threshold"))) if bounds else F.lit(0)
    per = per.withColumn("range", above)
    down = Window.partitionBy("range").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = per.groupBy("range").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    totals = totals.select("range", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    whole = observations.agg(F.sum(F.when(F.col("useful"), 1).otherwise(0)).alias("positives"))
    run = per.select("range", "threshold", F.sum("p").over(down).alias("p"), F.sum("n").over(down).alias("n")).join(F.broadcast(totals), "range")  # a row a range
    curve = run.select("threshold", (F.col("p") + F.col("_p")).alias("tp"), (F.col("n") + F.col("_n")).alias("fp")).crossJoin(F.broadcast(whole))  # one row
    accepted = F.col("tp") + F.col("fp")
    return curve.select("threshold", "tp", "fp", accepted.alias("accepted"), (F.col("fp") / accepted).alias("risk"), (F.col("tp") / F.col("positives")).alias("recall"))


@F.pandas_udf(T.DoubleType())
def next_above(values: pd.Series) -> pd.Series:
    """The next larger double."""
    return pd.Series(np.nextafter(values.to_numpy(dtype=np.float64), np.inf))


def breakpoints(scores: DataFrame, column: str) -> DataFrame:
    """(threshold): every distinct finite value and the next double above it, between which a decision can change."""
    values = scores.select(F.col(column).cast("double").alias("threshold")).where(F.col("threshold").isNotNull() & ~F.isnan("threshold") & (F.abs("threshold") < float("inf"))).distinct()
    return values.unionByName(values.select(next_above("threshold").alias("threshold"))).distinct()


def certify(observations: DataFrame, max_risk_percent: int = MAX_RISK_PERCENT) -> DataFrame:
    """One row: the threshold chosen on observations(split = 'calibration', useful, score) and its figures on split 'gate'.

    threshold, tp, fp, tn, fn, risk, recall, abstention and passed: risk, recall and abstention reach EVIDENCE_GATES.
    Without a threshold of bounded risk there is no row.
    """
    chosen = select_threshold(observations.where("split = 'calibration'").select("useful", "score"), max_risk_percent).select("threshold")
    accepted = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    count = lambda x: F.sum(F.when(x, 1).otherwise(0))
    gate = observations.where("split = 'gate'").crossJoin(F.broadcast(chosen))  # one row
    sums = gate.groupBy("threshold").agg(
        count(accepted & F.col("useful")).alias("tp"), count(accepted & ~F.col("useful")).alias("fp"), count(~accepted & ~F.col("useful")).alias("tn"), count(~accepted & F.col("useful")).alias("fn")
    )
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    out = sums.withColumn("risk", rate("fp", "tp")).withColumn("recall", rate("tp", "fn")).withColumn("abstention", rate("tn", "fp"))
    ok = [F.coalesce(F.col(c) >= limit if relation == ">=" else F.col(c) <= limit, F.lit(False)) for c, (relation, limit) in EVIDENCE_GATES.items()]
    return out.withColumn("passed", ok[0] & ok[1] & ok[2])


def grouped_ndcg(hits: DataFrame, groups: DataFrame, k: int = RERANK_K) -> DataFrame:
    """(query_id, ndcg) of hits(query_id, key, rank) against groups(query_id, key, group, grade): a group of keys is one judgment, credited at its best rank."""
    wanted = groups.where("grade > 0").groupBy("query_id", "group").agg(F.max("grade").alias("grade"))
    best = hits.join(groups.select("query_id", "key", "group").distinct(), ["query_id", "key"]).groupBy("query_id", "group").agg(F.min("rank").alias("rank"))
    met = wanted.join(best, ["query_id", "group"], "left")
    met = met.withColumn("ideal", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "group")))
    gain = lambda at: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(at + 1)
    sums = met.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("rank") <= k, gain(F.col("rank")))), F.lit(0.0)).alias("dcg"), F.sum(F.when(F.col("ideal") <= k, gain(F.col("ideal")))).alias("best"))
    return sums.select("query_id", (F.col("dcg") / F.col("best")).alias("ndcg"))


def rerank_gain(before: DataFrame, after: DataFrame, groups: DataFrame, k: int = RERANK_K) -> DataFrame:
    """One row: cases, ndcg_before, ndcg_after and improvement (gate: RERANK_IMPROVEMENT)."""
    both = grouped_ndcg(before, groups, k).withColumnRenamed("ndcg", "before").join(grouped_ndcg(after, groups, k).withColumnRenamed("ndcg", "after"), "query_id")
    out = both.agg(F.count("*").alias("cases"), F.avg("before").alias("ndcg_before"), F.avg("after").alias("ndcg_after"))
    return out.withColumn("improvement", F.col("ndcg_after") - F.col("ndcg_before"))


def recall_by_namespace(routes: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(namespace, cases, found, recall): in how many cases that expect a namespace it is among the first k routes."""
    hit = expected.join(routes.where(F.col("rank") <= k).select("query_id", "namespace", F.lit(1).alias("_hit")).distinct(), ["query_id", "namespace"], "left")
    per = hit.groupBy("namespace").agg(F.count("*").alias("cases"), F.count("_hit").alias("found"))
    return per.withColumn("recall", F.col("found") / F.col("cases"))


def regressions(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after) of what got worse or is gone."""
    both = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "left")
    return both.where(F.col("before").isNotNull() & (F.col("after").isNull() | (F.col("after") < F.col("before"))))


def select_threshold(observations: DataFrame, max_risk_percent: int = MAX_RISK_PERCENT) -> DataFrame:
    """The one row of the curve with the most true positives among those of bounded risk (exact, in integers); then least risk, then highest threshold."""
    curve = risk_curve(observations)
    return curve.where(F.col("fp") * 100 <= F.col("accepted") * max_risk_percent).orderBy(F.desc("tp"), "risk", F.desc("threshold")).limit(1)


def metrics_by_kind(observations: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Confusion, risk and recall by kind and overall (kind null), with each kind's excess over the overall figures."""
    per = confusion(observations, threshold, kind)
    whole = confusion(observations, threshold).withColumn(kind, F.lit(None).cast("string")).select(per.columns)
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    rows = per.unionByName(whole).withColumn("risk", rate("fp", "tp")).withColumn("recall", rate("tp", "fn"))
    overall = rows.where(F.col(kind).isNull()).select(F.col("risk").alias("_risk"), F.col("recall").alias("_recall")).limit(1)
    out = rows.crossJoin(F.broadcast(overall))  # one row
    return out.select(kind, "tp", "fp", "tn", "fn", "risk", "recall", (F.col("risk") - F.col("_risk")).alias("excess_risk"), (F.col("_recall") - F.col("recall")).alias("recall_shortfall"))


def gates(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(gate, value, threshold, passed) for each limit of a one-row metrics table: (">=" or "<=", threshold); a null value fails."""
    rows = []
    for name, (relation, threshold) in limits.items():
        value = F.col(name).cast("double")
        ok = value >= threshold if relation == ">=" else value <= threshold
        rows.append(F.struct(F.lit(name).alias("gate"), value.alias("value"), F.lit(float(threshold)).alias("threshold"), F.coalesce(ok, F.lit(False)).alias("passed")))
    return metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


# What a release must reach.
ROUTING_GATES = {"route_recall_at_3": (">=", 0.95), "average_fanout": ("<=", 2.0), "max_fanout": ("<=", 3), "wrong_confident_singles": ("<=", 0)}
