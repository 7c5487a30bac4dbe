"""Routing of queries to namespaces: by descriptor phrases, by vectors, or both; and the catalog of namespaces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions.text import comparable, sha256
from sparkquarry.sources import scratch

# What a confident semantic route needs, and its fan-outs.
SCORE_FLOOR, MARGIN_FLOOR, SURE_FANOUT, WIDE_FANOUT = 0.65, 0.05, 1, 3
SHORTLIST, MOST_NAMED = 12, 3
BANK_BLOCK, QUERY_BLOCK, SCORED = 8192, 1024, 4096


def lexical_route(queries: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(query_id, namespace, matches, words, rank): whole-word descriptor phrases in the normalised query.

    Queries are cut into runs of words up to the longest descriptor and joined by equality, so no pair of
    query and descriptor is ever tried.
    """
    named = descriptors.select("namespace", comparable(F.col("descriptor")).alias("phrase")).where("phrase <> ''").distinct()
    named = named.withColumn("n", F.size(F.split("phrase", " ")))
    longest = named.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    words = queries.select("query_id", F.split(comparable(F.col("query")), " ").alias("w"))
    if not longest:
        return words.select("query_id", F.lit("").alias("namespace"), F.lit(0).alias("matches"), F.lit(0).alias("words"), F.lit(0).alias("rank")).limit(0)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i + 1)), lambda n: F.array_join(F.slice(F.col("w"), i, n), " "))))
    met = words.select("query_id", F.explode(F.array_distinct(runs)).alias("phrase")).join(named, "phrase")
    per = met.groupBy("query_id", "namespace").agg(F.count("*").alias("matches"), F.sum("n").alias("words"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("matches"), F.desc("words"), "namespace")))


def title_descriptors(title: Column) -> Column:
    """The title, and the first label of a title that is a bare domain of two labels (www. aside)."""
    stem = F.regexp_extract(F.trim(title), r"^(?i:www\.)?([A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)\.[A-Za-z]{2,63}$", 1)
    return F.filter(F.array(F.trim(title), stem), lambda x: x != "")


def named_route(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """lexical_route by the titles and aliases alone of cards(namespace, title, aliases): the corpora that a query names."""
    descriptors = F.concat(title_descriptors(F.col("title")), F.coalesce("aliases", F.array().cast("array<string>")))
    return lexical_route(queries, cards.select("namespace", F.explode(descriptors).alias("descriptor")))


def nearest_namespaces(queries: DataFrame, bank: DataFrame, keep: int, digits: int = 6) -> DataFrame:
    """(query_id, namespace, score, rank): the ``keep`` namespaces whose best vector in bank(namespace, vector) has the largest dot product with queries(query_id, vector).

    Of the two sides the one of fewer blocks goes out, block by block (BANK_BLOCK vectors or QUERY_BLOCK queries), to where
    the other is read, so queries are never joined with the catalog.  A task hands on, for each query, the best ``keep`` of
    what it multiplies at once: a namespace among the best of all is among them wherever its best vector lies, so its vectors
    needn't lie together.  Vectors of another length than the query's don't count; ties go to the smaller namespace.
    """
    bank = bank.select("namespace", F.col("vector").cast("array<double>").alias("vector"))
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    others = max(1, -(-bank.count() // BANK_BLOCK)) if blocks > 1 else 1
    schema, out = "query_id long, namespace string, score double", None
    for block in range(min(blocks, others)):
        if others < blocks:
            own = bank.where(F.pmod(F.xxhash64("namespace", "vector"), F.lit(others)) == block)
            part = queries.mapInArrow(_against_bank(own, keep, digits), schema)
        else:
            own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
            part = bank.mapInArrow(_against_queries(own, keep, digits), schema)
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("query_id", "namespace").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "namespace")))
    return ranked.where(F.col("rank") <= keep)


def _best(ids: pa.Array, names: np.ndarray, scores: np.ndarray, keep: int) -> pa.RecordBatch:
    """The ``keep`` largest of each row of scores(ids, names in order)."""
    order = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
    rows = ids.take(pa.array(np.repeat(np.arange(len(ids)), order.shape[1])))
    return pa.record_batch([rows, pa.array(names[order.ravel()], pa.string()), pa.array(np.take_along_axis(scores, order, axis=1).ravel())], names=["query_id", "namespace", "score"])


def _of_size(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows whose vectors have that size, SCORED at once."""
    some = batch.filter(pc.equal(pc.list_value_length(batch.column("vector")), size))
    for first in range(0, some.num_rows, SCORED):
        part = some.slice(first, SCORED)
        yield part, part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size)


def _against_bank(bank: DataFrame, keep: int, digits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    own, banks = bank.where(F.size("vector") > 0).distinct().toPandas(), []  # one block
    for size, part in own.groupby(own["vector"].map(len)):
        part = part.sort_values("namespace", kind="stable")
        names, first = np.unique(part["namespace"].to_numpy(dtype=str), return_index=True)
        banks.append((int(size), names, first, np.stack(part["vector"].to_numpy()).astype(np.float64)))
    shared = bank.sparkSession.sparkContext.broadcast(banks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, names, first, matrix in shared.value:
                for some, x in _of_size(batch, size):
                    scores = np.round(np.maximum.reduceat(x @ matrix.T, first, axis=1), digits)
                    yield _best(some.column("query_id"), names, scores, keep)

    return run


def _against_queries(queries: DataFrame, keep: int, digits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    own = queries.where(F.size("vector") > 0).toPandas()  # one block
    asked = [(int(size), part["query_id"].to_numpy(), np.stack(part["vector"].to_numpy()).astype(np.float64)) for size, part in own.groupby(own["vector"].map(len))]
    shared = queries.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, ids, matrix in shared.value:
                for some, x in _of_size(batch, size):
                    names, of = np.unique(some.column("namespace").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
                    order = np.argsort(of, kind="stable")
                    first = np.searchsorted(of[order], np.arange(len(names)))
                    scores = np.round(np.maximum.reduceat(matrix @ x[order].T, first, axis=1), digits)
                    yield _best(pa.array(ids, pa.int64()), names, scores, keep)

    return run


def _with_margin(ranked: DataFrame, score: str, digits: int = 6) -> DataFrame:
    """ranked with the first rank's lead over the second on every row (null where there is no second)."""
    heads = ranked.where("rank <= 2").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col(score))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col(score))).alias("second"))
    return ranked.join(heads.select("query_id", "top", F.round(F.col("top") - F.col("second"), digits).alias("margin")), "query_id")


def semantic_route(queries: DataFrame, cards: DataFrame, digits: int = 6) -> DataFrame:
    """(query_id, namespace, score, rank, margin, confident, fanout): the first WIDE_FANOUT of queries(query_id, vector) against a catalog cards(namespace, vector).

    Confident: the best score reaches SCORE_FLOOR and leads the second by MARGIN_FLOOR, or is the only one.
    """
    ranked = _with_margin(nearest_namespaces(queries, cards, WIDE_FANOUT, digits), "score", digits)
    sure = (F.col("top") >= SCORE_FLOOR) & (F.col("margin").isNull() | (F.col("margin") >= MARGIN_FLOOR))
    return ranked.select("query_id", "namespace", "score", "rank", "margin", sure.alias("confident"), F.when(sure, SURE_FANOUT).otherwise(WIDE_FANOUT).alias("fanout"))


def rerank_shortlist(queries: DataFrame, shortlist: DataFrame, passages: DataFrame, score: Callable[[Column, Column], Column], digits: int = 6) -> DataFrame:
    """shortlist(query_id, namespace, rank) by the best of passages(namespace, ordinal, passage) for queries(query_id, query):

    (query_id, namespace, score, prototype, shortlist_rank, rank); ties keep the first passage, then the shortlist's order.
    """
    met = shortlist.select("query_id", "namespace", F.col("rank").alias("shortlist_rank")).join(passages, "namespace").join(queries.select("query_id", "query"), "query_id")
    met = met.withColumn("_score", F.round(score(F.col("query"), F.col("passage")), digits))
    best = met.groupBy("query_id", "namespace", "shortlist_rank").agg(F.max(F.struct("_score", (-F.col("ordinal")).alias("place"))).alias("best"))
    best = best.select("query_id", "namespace", F.col("best._score").alias("score"), (-F.col("best.place")).alias("prototype"), "shortlist_rank")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "shortlist_rank", "namespace")))


def select_route(named: DataFrame, semantic: DataFrame, ranked: DataFrame, score_floor: float, margin_floor: float, margin_required: bool = True, certified: bool = True) -> DataFrame:
    """(query_id, namespace, route_rank, score, reason, confident, fanout): the corpora that each query is sent to.

    named(query_id, namespace, rank), semantic and ranked(query_id, namespace, score, rank).  One named corpus
    leads, the nearest others follow, and only it is asked first; several named ones are the route; more
    than MOST_NAMED are refused (a row without namespace).  Otherwise the first WIDE_FANOUT of ``ranked``,
    asked one by one only if certified and the best reaches both floors; without a second there is no
    margin, which passes unless it is required.
    """
    count = named.groupBy("query_id").agg(F.count("*").alias("named"))
    first = named.where(F.col("rank") <= MOST_NAMED).select("query_id", "namespace", F.col("rank").alias("place"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("by_name"))
    others = semantic.join(named.select("query_id", "namespace"), ["query_id", "namespace"], "left_anti").select("query_id", "namespace", (F.col("rank") + MOST_NAMED).alias("place"), "score", F.lit(False).alias("by_name"))
    own = first.unionByName(others).join(count, "query_id").where("named = 1 OR by_name")
    own = own.withColumn("route_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "namespace"))).where(F.col("route_rank") <= WIDE_FANOUT)
    refused = F.col("named") > MOST_NAMED
    own = own.where(~refused | (F.col("route_rank") == 1)).select(
        "query_id", F.when(~refused, F.col("namespace")).alias("namespace"), "route_rank", F.when(~refused, F.col("score")).alias("score"),
        F.when(refused, "too_many_named").when(F.col("named") == 1, "unique_title_or_alias").otherwise("multiple_named_corpora").alias("reason"),
        (~refused).alias("confident"), F.when(refused, 0).otherwise(F.col("named")).cast("int").alias("fanout"),
    )
    rest = _with_margin(ranked.join(count, "query_id", "left_anti"), "score").where(F.col("rank") <= WIDE_FANOUT)
    led = (F.col("margin") >= margin_floor) if margin_required else (F.col("margin").isNull() | (F.col("margin") >= margin_floor))
    sure = F.lit(certified) & F.coalesce((F.col("top") >= score_floor) & led, F.lit(False))
    size = F.count("*").over(Window.partitionBy("query_id"))
    rest = rest.select("query_id", "namespace", F.col("rank").alias("route_rank"), "score", F.when(sure, "high_confidence").otherwise("ambiguous").alias("reason"), sure.alias("confident"), F.when(sure, 1).otherwise(size).cast("int").alias("fanout"))
    return own.unionByName(rest)


def prototype_route(queries: DataFrame, cards: DataFrame, bank: DataFrame, passages: DataFrame, score: Callable[[Column, Column], Column], score_floor: float, margin_floor: float, certified: bool = True) -> DataFrame:
    """select_route of queries(query_id, query, vector): names, else the best passage of each of the SHORTLIST nearest namespaces."""
    near = scratch.written(nearest_namespaces(queries, bank, SHORTLIST))  # three uses read it
    ranked = rerank_shortlist(queries, near, passages, score)
    return select_route(named_route(queries, cards), near, ranked, score_floor, margin_floor, True, certified)


def hybrid_route(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """select_route of queries(query_id, query, vector) by names, else by cards(namespace, title, aliases, vector) alone."""
    near = nearest_namespaces(queries, cards.select("namespace", "vector"), SHORTLIST)
    return select_route(named_route(queries, cards), near, near, SCORE_FLOOR, MARGIN_FLOOR, False)


def hybrid_score(lexical: DataFrame, semantic: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, namespace, hybrid_score): reciprocal rank fusion of both routes."""
    both = lexical.select("query_id", "namespace", F.col("rank").alias("l")).join(semantic.select("query_id", "namespace", F.col("rank").alias("s")), ["query_id", "namespace"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    return both.select("query_id", "namespace", F.round(part("l") + part("s"), 12).alias("hybrid_score"))


def card_passage(title: Column, summary: Column, aliases: Column, tags: Column) -> Column:
    """Four lines: title, summary, sorted aliases and tags joined by '; ' or none."""
    joined = lambda x: F.coalesce(F.nullif(F.array_join(F.array_sort(x), "; "), F.lit("")), F.lit("none"))
    return F.concat_ws("\n", F.concat(F.lit("Title: "), title), F.concat(F.lit("Summary: "), summary), F.concat(F.lit("Aliases: "), joined(aliases)), F.concat(F.lit("Tags: "), joined(tags)))


def classify_catalog(live: DataFrame, cards: DataFrame, model: str, precision: str, dims: int) -> DataFrame:
    """(namespace, status) of every live namespace or card: missing, stale, disabled, incompatible or eligible."""
    both = live.select("namespace", F.lit(True).alias("_live")).distinct().join(cards.select("namespace", "enabled", "model", "precision", "dims", F.lit(True).alias("_card")), "namespace", "full_outer")
    fits = (F.col("model") == model) & (F.col("precision") == precision) & (F.col("dims") == dims)
    status = F.when(F.col("_card").isNull(), "missing").when(F.col("_live").isNull(), "stale").when(~F.col("enabled"), "disabled").when(~fits, "incompatible").otherwise("eligible")
    return both.select("namespace", status.alias("status"))


def card_revision(cards: DataFrame, volatile: list[str]) -> DataFrame:
    """cards with card_revision: a hash of every column but the volatile ones, names sorted."""
    return cards.withColumn("card_revision", sha256(F.to_json(F.struct(*sorted(c for c in cards.columns if c not in volatile)), {"ignoreNullFields": "false"})))


def compare_and_set(stored: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """stored(namespace, card_revision, columns) after changes(namespace, expected_revision, columns): (stored row, outcome).

    outcome: kept, created (no expected revision, none stored), updated (the revision is the expected one) or conflict.
    """
    new = changes.select("namespace", F.col("expected_revision").alias("_expected"), F.lit(True).alias("_asked"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = stored.withColumn("_stored", F.lit(True)).join(new, "namespace", "full_outer")
    outcome = (
        F.when(F.col("_asked").isNull(), "kept")
        .when(F.col("_stored").isNull(), F.when(F.col("_expected").isNull(), "created").otherwise("conflict"))
        .when(F.col("_expected") == F.col("card_revision"), "updated")
        .otherwise("conflict")
    )
    takes = outcome.isin("created", "updated")
    return both.select("namespace", *[F.when(takes, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns], outcome.alias("outcome"))


def consistent(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, value, consistent): the one nonblank value of a column in each group; null where there are several."""
    value = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    per = df.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    same = F.coalesce(F.col("low") == F.col("high"), F.lit(True))
    return per.select(group, F.when(same, F.col("low")).alias("value"), same.alias("consistent"))
