"""Judgments credited to hits: every hit takes the best judgment that it matches and no better hit has taken.

Hits: (query_id, rank, url, path, repo_path, section_path).  Judgments: (query_id, url, repo_path, section_path, grade); any of the texts may be
null.  A judgment is named by its path, else its URL, else its section; of those with one name the highest grade counts, the first
of them by the other texts.  Matches by path are an equi-join with the path suffixes of a hit's URL; matches by URL are looked for
among the few judgments of a query.  The assignment is one ordered fold over a query's matches, at most its hits times its judgments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions import urls
from sparkquarry.operators.evaluation import NDCG_K, PRECISION_K, WEIGHTS
from sparkquarry.operators.index import normal_section


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def judgment_key(path: Column, url: Column, section: Column) -> Column:
    """The name of a judgment: kind and normal form of the first of path, URL and section that it has."""
    return F.when(path != "", F.concat(F.lit("repo_path:"), urls.plain_path(path))).when(url != "", F.concat(F.lit("url:"), urls.eval_url(url))).otherwise(F.concat(F.lit("section_path:"), normal_section(section)))


def distinct_judgments(judgments: DataFrame) -> DataFrame:
    """(query_id, key, grade, url, repo_path, section_path) of the judgments with a grade above 0, one a key."""
    named = judgments.where("grade > 0").select("query_id", judgment_key(_text("repo_path"), _text("url"), _text("section_path")).alias("key"), "grade", *(_text(c).alias(c) for c in ("url", "repo_path", "section_path")))
    best = F.min(F.struct((-F.col("grade")).alias("_order"), "url", "repo_path", "section_path", "grade"))
    return named.groupBy("query_id", "key").agg(best.alias("b")).select("query_id", "key", "b.grade", "b.url", "b.repo_path", "b.section_path")


def _after(parts: Column, marker: str) -> Column:
    """What follows the ref behind the first ``marker`` segment, where there is something."""
    at = F.array_position(parts, marker)
    return F.when((at > 0) & (F.size(parts) > at + 1), F.array_join(F.slice(parts, (at + 2).cast("int"), F.size(parts)), "/")).otherwise("")


def path_candidates(url: Column, *paths: Column) -> Column:
    """The paths that a hit can be judged by: its own ones, every suffix of its URL's path, and what follows blob/<ref> or tree/<ref>."""
    whole = urls.plain_path(F.when(F.contains(url, F.lit("://")), urls.path(url)).otherwise(url))
    parts = F.filter(F.split(whole, "/"), lambda s: s != "")
    own = F.array(*(urls.plain_path(p) for p in paths), _after(parts, "blob"), _after(parts, "tree"))
    return F.array_distinct(F.filter(F.concat(own, F.transform(urls.suffixes(whole), urls.plain_path)), lambda p: p != ""))


def matches(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """(query_id, rank, key, grade) of every hit and judgment of distinct_judgments that match: by URL (one holds the other) or by path, and by section if the judgment names one."""
    shown = hits.select("query_id", "rank", *(_text(c).alias(f"_{c}") for c in ("url", "path", "repo_path", "section_path")))
    by_path = shown.withColumn("_p", F.explode(path_candidates(F.col("_url"), F.col("_repo_path"), F.col("_path"))))
    wanted = judgments.where("repo_path <> ''").withColumn("_p", urls.plain_path(F.col("repo_path")))
    met = by_path.join(wanted, ["query_id", "_p"]).select("query_id", "rank", "key", "grade", "section_path", "_section_path")

    mine, theirs = urls.eval_url(F.col("_url")), urls.eval_url(F.col("url"))
    near = shown.where("_url <> ''").join(judgments.where("url <> ''"), "query_id")
    near = near.withColumn("_a", mine).withColumn("_b", theirs).where((F.col("_a") != "") & (F.col("_b") != "") & (F.contains("_a", "_b") | F.contains("_b", "_a")))
    both = met.unionByName(near.select(met.columns))
    have, want = normal_section(F.col("_section_path")), normal_section(F.col("section_path"))
    fits = (F.col("section_path") == "") | ((have != "") & (F.contains(have, want) | F.contains(want, have)))
    return both.where(fits).select("query_id", "rank", "key", "grade").distinct()


def assigned(met: DataFrame) -> DataFrame:
    """(query_id, rank, key, grade): hits in order of rank take the unused judgment of the highest grade, then the smallest key."""
    listed = met.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", (-F.col("grade")).alias("order"), "key", "grade"))).alias("all"))
    kind = dict(met.dtypes)
    start = F.array().cast(f"array<struct<rank:{kind['rank']},key:{kind['key']},grade:{kind['grade']}>>")

    def take(done: Column, one: Column) -> Column:
        free = ~F.exists(done, lambda d: (d["rank"] == one["rank"]) | (d["key"] == one["key"]))
        return F.when(free, F.concat(done, F.array(F.struct(one["rank"].alias("rank"), one["key"].alias("key"), one["grade"].alias("grade"))))).otherwise(done)

    return listed.select("query_id", F.explode(F.aggregate("all", start, take)).alias("t")).select("query_id", "t.*")


def judged_metrics(hits: DataFrame, judgments: DataFrame, k: int = NDCG_K) -> DataFrame:
    """One row a judged query: judged, first_rank, ndcg, recall and mrr at k, precision at 5, and a composite of 0 to 100.

    The gain of a hit is that of the judgment it takes; first_rank is that of the first hit with any match.
    """
    wanted = distinct_judgments(judgments)
    met = matches(hits.where(F.col("rank") <= max(k, PRECISION_K)), wanted)
    gain = lambda grade, at: (F.pow(F.lit(2.0), grade) - 1) / F.log2(at + 1)
    ideal = wanted.groupBy("query_id").agg(F.count("*").alias("judged"), F.slice(F.sort_array(F.collect_list("grade"), asc=False), 1, k).alias("grades"))
    ideal = ideal.withColumn("ideal", F.aggregate(F.transform("grades", lambda g, i: gain(g, i + 1)), F.lit(0.0), lambda a, b: a + b))
    inside = lambda n, x: F.sum(F.when(F.col("rank") <= n, x))
    won = assigned(met).groupBy("query_id").agg(inside(k, gain(F.col("grade"), F.col("rank"))).alias("dcg"), inside(k, F.lit(1)).alias("found"), inside(PRECISION_K, F.lit(1)).alias("near"))
    first = met.where(F.col("rank") <= k).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    shown = hits.where(F.col("rank") <= PRECISION_K).groupBy("query_id").agg(F.count("*").alias("shown"))
    both = ideal.join(won, "query_id", "left").join(first, "query_id", "left").join(shown, "query_id", "left")
    none = lambda x: F.coalesce(x, F.lit(0.0))
    out = both.select(
        "query_id", "judged", "first_rank", none(F.col("dcg") / F.col("ideal")).alias("ndcg"), none(F.col("found") / F.col("judged")).alias("recall"),
        none(F.lit(1.0) / F.col("first_rank")).alias("mrr"), none(F.col("near") / F.col("shown")).alias("precision"),
    )
    composite = sum((F.col(name) * weight for name, weight in WEIGHTS.items()), F.lit(0.0)) * 100
    return out.withColumn("composite", F.greatest(F.lit(0.0), F.least(F.lit(100.0), composite)))


def first_hint(hits: DataFrame, hints: DataFrame) -> DataFrame:
    """(query_id, passed, rank, kind, hint): the first of hits(query_id, rank, url, text) that holds one of hints(query_id, kind, ordinal, hint), kind "url" or "topic".

    A URL hint must lie in the hit's URL, a topic anywhere in its text or URL, without regard to case; within a hit URLs come before topics, then
    the ordinal decides.  Blank hints are none; a query of hints alone, or without hits, isn't passed.
    """
    asked = hints.where(_text("hint") != "").select("query_id", "kind", "ordinal", F.lower("hint").alias("hint"))
    url, rest = F.lower(_text("url")), F.lower(F.concat_ws(" ", _text("text"), _text("url")))
    met = hits.join(asked, "query_id").where(F.when(F.col("kind") == "url", F.contains(url, F.col("hint"))).otherwise(F.contains(rest, F.col("hint"))))
    best = met.groupBy("query_id").agg(F.min(F.struct("rank", (F.col("kind") != "url").alias("_later"), "ordinal", "kind", "hint")).alias("b"))
    return hints.select("query_id").distinct().join(best, "query_id", "left").select("query_id", F.col("b").isNotNull().alias("passed"), "b.rank", "b.kind", "b.hint")
