"""A stored vector index that stays exact: cells of near vectors with a radius each, and cells that can't hold a hit are not read.

Centroids are fitted (spherical k-means) on a bounded sample; every vector is then stored, as a unit vector, in the cell of its nearest centroid, a
part of a ``sources.store``.  A cell keeps the least cosine of its vectors with the centroid, its radius as an angle.
A query at angle t from a centroid finds nothing in the cell above cos(t - radius).  A search reads the nearest cells of each
query until they hold k vectors, then those others whose bound reaches the k-th cosine found: the rows are those of ``retrieval.vector_top_k``,
whatever is skipped; where all cells overlap all are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.operators.retrieval import QUERY_BLOCK, rank
from sparkquarry.sources import store

CELLS, SAMPLE, ROUNDS = 256, 20_000, 8
SLACK = 1e-6  # of a cosine: bounds are never cut by rounding


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def fit_centroids(vectors: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of spherical k-means, at most as many as there are vectors; deterministic."""
    unit = _unit(vectors)
    centroids = unit[np.linspace(0, len(unit) - 1, min(cells, len(unit))).astype(int)]
    for _ in range(rounds):
        nearest = (unit @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, unit)
        empty = np.linalg.norm(sums, axis=1) < 1e-9
        sums[empty] = centroids[empty]
        centroids = _unit(sums)
    return centroids


def build(spark: SparkSession, root: str, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int = CELLS, sample: int = SAMPLE) -> store.Version:
    """Index rows(key, vector) at root as a new version.  Rows without a key or a whole vector of the usual length are left out."""
    whole = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)))
    own = whole.select(F.col(key).cast("long").alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    length = own.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    at = store.version(spark, root)
    if length is None:
        return store.commit(spark, root, at.noted(dim=0, least={}, counts={}))
    own = own.where(F.size("vector") == length.n)
    some = own.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(min(1.0, sample / length["count"]) * (1 << 30))).orderBy("key").limit(2 * sample).toArrow()  # about ``sample`` vectors
    if not some.num_rows:
        some = own.orderBy("key").limit(sample).toArrow()
    centroids = fit_centroids(some["vector"].combine_chunks().flatten().to_numpy().reshape(some.num_rows, -1), cells)
    shared = spark.sparkContext.broadcast(centroids)  # cells x dimensions

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1))
            near = unit @ shared.value.T
            cell = near.argmax(axis=1)
            lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * unit.shape[1], pa.array(unit.ravel()))
            yield pa.record_batch([batch.column("key"), lists, pa.array(cell), pa.array(near[np.arange(len(cell)), cell])], names=["key", "vector", "cell", "near"])

    placed = own.mapInArrow(assign, "key long, vector array<double>, cell long, near double")
    made = store.stage(placed.select("key", "vector", "cell", "near"), root, F.col("cell"), ["key"])
    new = at.changed("vectors", dict.fromkeys(at.tables.get("vectors", {}), []) | made)
    per = store.read(spark, root, new, "vectors", "key long, vector array<double>, cell long, near double").groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least")).collect()  # a row a cell
    table = spark.createDataFrame([(int(i), c.tolist()) for i, c in enumerate(centroids)], "cell long, centroid array<double>")
    new = new.changed("centroids", store.stage(table, root, F.lit("all")))
    return store.commit(spark, root, new.noted(dim=int(length.n), least={str(r.cell): r.least for r in per}, counts={str(r.cell): r.n for r in per}))


class Reader:
    """One version of an index: centroids, radii and counts of its cells."""

    def __init__(self, spark: SparkSession, root: str, number: int | None = None) -> None:
        self.spark, self.root, self.at = spark, root, store.version(spark, root, number)
        rows = store.read(spark, root, self.at, "centroids", "cell long, centroid array<double>").orderBy("cell").collect()  # cells x dimensions
        self.cells = [r.cell for r in rows if str(r.cell) in self.at.notes["counts"]]
        self.centroids = np.array([r.centroid for r in rows if str(r.cell) in self.at.notes["counts"]])
        self.radius = np.array([np.arccos(np.clip(self.at.notes["least"][str(c)], -1, 1)) for c in self.cells])
        self.counts = np.array([self.at.notes["counts"][str(c)] for c in self.cells])

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """(queries, cells): no vector of the cell has a higher cosine with the query."""
        angle = np.arccos(np.clip(unit @ self.centroids.T, -1, 1))
        return np.cos(np.maximum(0, angle - self.radius[None])) + SLACK

    def nearest(self, bound: np.ndarray, k: int) -> np.ndarray:
        """(queries, cells): the cells of highest bound that hold k vectors together."""
        order = np.argsort(-bound, axis=1, kind="stable")
        held = np.cumsum(self.counts[order], axis=1)
        first = np.zeros_like(bound, dtype=bool)
        np.put_along_axis(first, order, np.concatenate((np.ones((len(bound), 1), bool), held[:, :-1] < k), axis=1), axis=1)
        return first

    def hits(self, ids: np.ndarray, unit: np.ndarray, pairs: np.ndarray, k: int, digits: int) -> DataFrame:
        """(query_id, key, score): in each task the k best of each query among the cells that pairs(queries, cells) gives it."""
        used = np.flatnonzero(pairs.any(axis=0))
        rows = store.read(self.spark, self.root, self.at, "vectors", "key long, vector array<double>, cell long, near double", [self.cells[i] for i in used]).select("key", "vector", "cell")
        shared = self.spark.sparkContext.broadcast((ids, unit, {self.cells[i]: np.flatnonzero(pairs[:, i]) for i in used}))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, unit, asked = shared.value
            held = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
            for batch in batches:
                x = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
                keys, cell = batch.column("key").to_numpy(), batch.column("cell").to_numpy()
                for c in np.unique(cell).tolist():
                    here = np.flatnonzero(cell == c)
                    near = np.round(unit[asked[c]] @ x[here].T, digits)
                    for q, scores in zip(asked[c].tolist(), near, strict=True):
                        least = held[q][0][-1] if len(held[q][0]) >= k else -np.inf
                        some = scores >= least  # only what reaches the k-th is sorted
                        s, i = np.concatenate((held[q][0], scores[some])), np.concatenate((held[q][1], keys[here][some]))
                        order = np.lexsort((i, -s))[:k]
                        held[q] = s[order], i[order]
            sizes = [len(s) for s, _ in held]
            yield pa.record_batch([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([i for _, i in held] or [np.zeros(0, np.int64)])), pa.array(np.concatenate([s for s, _ in held] or [np.zeros(0)]))], names=["query_id", "key", "score"])

        return rows.mapInArrow(best, "query_id long, key long, score double")


def plan(reader: Reader, ids: np.ndarray, unit: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which (query, cell) pairs are read first, and which then because their bound reaches the k-th cosine."""
    bound = reader.bounds(unit)
    first = reader.nearest(bound, k)
    reached = {r.query_id: r.least for r in rank(reader.hits(ids, unit, first, k, digits), "key", k, digits).groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("least")).collect()}  # a row a query
    least = np.array([x if (x := reached.get(int(i))) is not None else -2.0 for i in ids])
    return first, ~first & (bound >= least[:, None] - 10.0**-digits)


def search(reader: Reader, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, key, score, rank) as ``retrieval.vector_top_k`` gives it for queries(query_id, vector), in blocks of QUERY_BLOCK."""
    asked = queries.select("query_id", vector).where(F.size(vector) == reader.at.notes["dim"])
    blocks, out = max(1, -(-asked.count() // QUERY_BLOCK)), None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()
        if own.empty or not reader.cells:
            continue
        ids, unit = own["query_id"].to_numpy(), _unit(np.stack(own[vector].to_numpy()).astype(np.float64))
        first, more = plan(reader, ids, unit, k, digits)
        part = reader.hits(ids, unit, first | more, k, digits)
        out = part if out is None else out.unionByName(part)
    out = reader.spark.createDataFrame([], "query_id long, key long, score double") if out is None else out
    return rank(out.select("query_id", F.col("key").alias(key), "score"), key, k, digits)
