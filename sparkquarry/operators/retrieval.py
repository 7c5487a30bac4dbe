"""Ranked retrieval: BM25, exact vector search, fusion, grouping, reranking and deduplication.

Queries are a stated set that is small beside the corpus; every operator scores it against all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions.text import lexical_tokens

K1, B, RRF_K = 1.2, 0.75, 60
QUERY_BLOCK, SCORED = 1024, 256
FIELD_WEIGHTS = {"title": 2.0, "section_path": 1.5, "content": 1.0}  # fixed values


_term = re.compile("[a-z0-9]+")


class _Terms:
    """The wanted terms of a batch: for each field the row, term number and count of each hit, and the length of each row."""

    def __init__(self, batch: pa.RecordBatch, columns: list[str], wanted: dict[str, int]) -> None:
        self.hits, self.lengths = [], []
        for column in columns:
            rows, terms, counts, lengths = [], [], [], []
            for row, text in enumerate(batch.column(column).to_pylist()):
                words = _term.findall((text or "").lower())
                lengths.append(len(words))
                met = Counter(w for w in words if w in wanted)
                rows += [row] * len(met)
                terms += [wanted[w] for w in met]
                counts += met.values()
            self.hits.append(tuple(np.array(x, dtype=np.int64) for x in (rows, terms, counts)))
            self.lengths.append(np.array(lengths, dtype=np.int64))


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", fields: dict[str, float] | None = None, k1: float = K1, b: float = B, digits: int = 6) -> DataFrame:
    """(query_id, key, score, rank): the k documents of highest field-weighted BM25 for each of queries(query_id, query).

    fields: text columns and their weights (FIELD_WEIGHTS for title, section_path, content); each has its own
    document frequencies and mean length.  Queries go out in blocks of QUERY_BLOCK.  One scan sums the
    frequencies of the block's terms, one scores where it reads and hands on its best k a query: no posting
    is shuffled, a word in every document costs no more than another, and a filter on docs reaches the scan.
    Ties go to the smaller key; a document without any of the terms isn't ranked.
    """
    fields = fields or {"text": 1.0}
    names, weights = list(fields), list(fields.values())
    spark, out = docs.sparkSession, None
    asked = queries.select("query_id", F.explode(lexical_tokens(F.coalesce("query", F.lit("")))).alias("term"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    texts = docs.select(F.col(key).cast("long").alias(key), *names)
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()  # a block's words
        wanted = {t: i for i, t in enumerate(sorted(set(own["term"])))}
        ids = np.unique(own["query_id"].to_numpy())
        asks = np.zeros((len(wanted), len(ids)), dtype=np.float64)
        asks[own["term"].map(wanted).to_numpy(dtype=np.int64), np.searchsorted(ids, own["query_id"].to_numpy())] = 1.0
        shared = spark.sparkContext.broadcast((wanted, ids, asks))

        def frequencies(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wanted = shared.value[0]
            total = np.zeros((len(names), len(wanted) + 2), dtype=np.int64)
            for batch in batches:
                made = _Terms(batch, names, wanted)
                for field, ((_, terms, _), lengths) in enumerate(zip(made.hits, made.lengths, strict=True)):
                    total[field, : len(wanted)] += np.bincount(terms, minlength=len(wanted))
                    total[field, len(wanted) :] += lengths.sum(), len(lengths)
            field, term = np.nonzero(total)
            yield pa.record_batch([pa.array(field), pa.array(term), pa.array(total[field, term])], names=["field", "term", "n"])

        summed = texts.select(*names).mapInArrow(frequencies, "field long, term long, n long").groupBy("field", "term").agg(F.sum("n").alias("n")).toPandas()
        seen = np.zeros((len(names), len(wanted) + 2))
        seen[summed["field"].to_numpy(dtype=np.int64), summed["term"].to_numpy(dtype=np.int64)] = summed["n"].to_numpy()
        df, words, n = seen[:, : len(wanted)], seen[:, -2], seen[:, -1]
        idf = np.log(1 + (n[:, None] - df + 0.5) / (df + 0.5))
        stats = spark.sparkContext.broadcast((idf, words / np.maximum(n, 1)))

        def best(batches: Iterator[pa.RecordBatch], shared=shared, stats=stats) -> Iterator[pa.RecordBatch]:
            (wanted, ids, asks), (idf, mean) = shared.value, stats.value
            keys, scores = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for batch in batches:
                made = _Terms(batch, names, wanted)
                for first in range(0, batch.num_rows, SCORED):
                    count = min(SCORED, batch.num_rows - first)
                    weight = np.zeros((count, len(wanted)))
                    for field, ((rows, terms, tf), lengths) in enumerate(zip(made.hits, made.lengths, strict=True)):
                        some = (rows >= first) & (rows < first + count)
                        row, term, f = rows[some], terms[some], tf[some]
                        weight[row - first, term] += weights[field] * idf[field, term] * f * (k1 + 1) / (f + k1 * (1 - b + b * lengths[row] / max(mean[field], 1e-300)))
                    scores = np.concatenate((scores, np.round(asks.T @ weight.T, digits)), axis=1)
                    own = batch.column(0).slice(first, count).to_numpy()
                    keys = np.concatenate((keys, np.broadcast_to(own, (len(ids), count))), axis=1)
                    order = np.lexsort((keys, -scores), axis=1)[:, :k]
                    scores, keys = np.take_along_axis(scores, order, axis=1), np.take_along_axis(keys, order, axis=1)
            hit = scores > 0
            yield pa.record_batch([pa.array(np.broadcast_to(ids[:, None], keys.shape)[hit]), pa.array(keys[hit]), pa.array(scores[hit])], names=["query_id", key, "score"])

        part = texts.where(F.col(key).isNotNull()).mapInArrow(best, f"query_id long, {key} long, score double")
        out = part if out is None else out.unionByName(part)
    return rank(out, key, k, digits)


def rank(scored: DataFrame, key: str, top: int | None = None, digits: int = 6) -> DataFrame:
    """scored(query_id, key, score) with rank from 1 by (-score rounded, key)."""
    scored = scored.withColumn("score", F.round("score", digits))
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return out if top is None else out.where(F.col("rank") <= top)


def vector_top_k(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, key, score, rank): the k rows of highest cosine for each of queries(query_id, vector).

    Queries go out in blocks of QUERY_BLOCK; a task multiplies its batches with the block and hands on
    its best k a query, so at most tasks * k rows a query are ranked.  Ties go to the smaller key.
    """
    spark, out = rows.sparkSession, None
    numbered = queries.select("query_id", vector).where(F.size(vector) > 0)
    blocks = max(1, -(-numbered.count() // QUERY_BLOCK))
    for block in range(blocks):
        own = numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()
        if own.empty:
            continue
        matrix = np.stack(own[vector].to_numpy()).astype(np.float64)
        shared = spark.sparkContext.broadcast((own["query_id"].to_numpy(), matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            keys, scores = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for batch in batches:
                batch = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column(1)), matrix.shape[1]))
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                scores = np.concatenate((scores, np.round(matrix @ x.T, digits)), axis=1)
                keys = np.concatenate((keys, np.broadcast_to(batch.column(0).to_numpy(), (len(ids), batch.num_rows))), axis=1)
                order = np.lexsort((keys, -scores), axis=1)[:, :k]
                scores, keys = np.take_along_axis(scores, order, axis=1), np.take_along_axis(keys, order, axis=1)
            yield pa.record_batch([pa.array(np.repeat(ids, keys.shape[1])), pa.array(keys.ravel()), pa.array(scores.ravel())], names=["query_id", key, "score"])

        part = rows.select(F.col(key).cast("long"), vector).mapInArrow(best, f"query_id long, {key} long, score double")
        out = part if out is None else out.unionByName(part)
    return rank(out, key, k, digits)


def hybrid_top_k(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int, key: str = "doc_id", candidates: int = 200) -> DataFrame:
    """Vector and field-weighted BM25 lists of up to ``candidates`` hits a query, fused by reciprocal rank.

    docs(key, title, section_path, content), vectors(key, embedding), queries(query_id, query), query_vectors(query_id, embedding).
    """
    near = vector_top_k(vectors, query_vectors, candidates, key)
    words = bm25_top_k(docs, queries, candidates, key, FIELD_WEIGHTS)
    fused = rrf(near, words, key, k)
    return fused.select("query_id", key, F.col("left_rank").alias("vector_rank"), F.col("right_rank").alias("bm25_rank"), "score", "rank")


def rrf(left: DataFrame, right: DataFrame, key: str, top: int | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two (query_id, key, rank) lists: score, the two ranks, and rank by (-score, best rank, key)."""
    both = left.select("query_id", key, F.col("rank").alias("left_rank")).join(right.select("query_id", key, F.col("rank").alias("right_rank")), ["query_id", key], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", F.round(part("left_rank") + part("right_rank"), 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.least("left_rank", "right_rank"), key)
    out = both.withColumn("rank", F.row_number().over(order))
    return out if top is None else out.where(F.col("rank") <= top)


def group_score(ranks: Column, aggregation: str, k: int = RRF_K) -> Column:
    """max, capped_sum_3 (best three) or adaptive_sum_3 (best, 5 % more for each of the next two that reaches 80 % of it) of 1 / (k + rank)."""
    best = F.transform(F.slice(F.array_sort(ranks), 1, 3), lambda r: F.lit(1.0) / (k + r))
    first = F.element_at(best, 1)
    if aggregation == "max":
        return first
    if aggregation == "capped_sum_3":
        return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
    close = F.size(F.filter(F.slice(best, 2, 2), lambda x: x >= 0.8 * first))
    return first * (1 + 0.05 * close)


def group_hits(hits: DataFrame, key: str, group: str, aggregation: str = "adaptive_sum_3", factor: str | None = None) -> DataFrame:
    """One row a query and group of hits(query_id, key, group, rank): the best hit represents it; rank by (-score, best rank, group).

    factor: a column of the hits whose largest value in a group multiplies the group's score.
    """
    most = F.max(factor) if factor else F.lit(1.0)
    grouped = hits.groupBy("query_id", group).agg(F.min_by(key, "rank").alias(key), F.min("rank").alias("best_rank"), F.count("*").alias("hits"), F.collect_list("rank").alias("ranks"), most.alias("factor"))
    scored = grouped.withColumn("score", F.round(group_score(F.col("ranks"), aggregation) * F.col("factor"), 12)).drop("ranks", "factor")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", group)))


def dedupe_hits(hits: DataFrame, same: list[str], order: list[str], collect: str) -> DataFrame:
    """Of hits equal in ``same`` the first by ``order`` stays, with the sorted distinct values of ``collect`` in ``{collect}s``."""
    best = hits.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy(*order))).where("_n = 1").drop("_n")
    groups = hits.groupBy(*same).agg(F.array_sort(F.collect_set(collect)).alias(f"{collect}s"))
    joined = [best[c].eqNullSafe(groups[c]) for c in same]
    return best.join(groups, joined).select(*[best[c] for c in best.columns], groups[f"{collect}s"])


def namespace_fusion(candidates: DataFrame, per_namespace: int = 8, top: int = 5, k: int = RRF_K) -> DataFrame:
    """Fuse candidates(query_id, namespace, key, local_score, cross_score) of several namespaces.

    Each namespace sends its best per_namespace by local score; all are ranked together by cross score, and
    the two ranks are fused with equal weights; ties: cross rank, local rank, namespace, key.
    """
    local = Window.partitionBy("query_id", "namespace").orderBy(F.desc("local_score"), "key")
    kept = candidates.withColumn("local_rank", F.row_number().over(local)).where(F.col("local_rank") <= per_namespace)
    cross = Window.partitionBy("query_id").orderBy(F.desc("cross_score"), "local_rank", "namespace", "key")
    kept = kept.withColumn("cross_rank", F.row_number().over(cross))
    kept = kept.withColumn("score", F.round(F.lit(1.0) / (k + F.col("local_rank")) + F.lit(1.0) / (k + F.col("cross_rank")), 12))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "cross_rank", "local_rank", "namespace", "key")
    return kept.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top)


def place_companion(hits: DataFrame, slot: int = 5, reach: int = 20) -> DataFrame:
    """hits(query_id, key, role, strength, rank) with a docs or tests companion in the first ``slot`` ranks.

    Where the first hit is source and ranks 1 to slot have no docs or tests, the strongest companion (ties: the
    earliest) of the ranks up to ``reach`` moves to ``slot`` and the hits between move down by one.
    """
    companion = F.col("role").isin("docs", "tests")
    near = F.col("rank") <= slot
    per = hits.groupBy("query_id").agg(
        F.max(F.when((F.col("rank") == 1) & (F.col("role") == "source"), 1)).alias("source"),
        F.max(F.when(near & companion, 1)).alias("has"),
        F.max(F.when(~near & (F.col("rank") <= reach) & companion & (F.col("strength") > 0), F.struct("strength", (-F.col("rank")).alias("place")))).alias("best"),
    )
    moved = per.where("source = 1 AND has IS NULL AND best IS NOT NULL").select("query_id", (-F.col("best.place")).alias("_from"))
    both = hits.join(moved, "query_id", "left")
    rank_now = F.when(F.col("rank") == F.col("_from"), slot).when((F.col("rank") >= slot) & (F.col("rank") < F.col("_from")), F.col("rank") + 1).otherwise(F.col("rank"))
    return both.withColumn("rank", rank_now).drop("_from")
