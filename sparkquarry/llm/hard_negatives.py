"""Hard-negative mining (13): spanning trees of anchors bound the scores of all rows.

Components become whole numbers, floor(256 * x), so a score, the inner product of a row with an anchor, is a
whole number.  Anchors are dealt into blocks of about ``ANCHORS``, near ones together; a task builds the
minimum spanning tree of each block (Prim).  A block is then a broadcast of bounded size, and one pass over
all rows answers it: a slice of rows has its scores with the root, and for an edge of the tree of length d
a row of norm r scores at the child what it scores at the parent, plus or minus d * r.  Only rows whose bound
meets what the child still looks for are scored again; the others carry the wider bound on to the next edge.

A first pass looks for an anchor's positives: a row is scored while its upper bound reaches the worst of the
positives found so far.  A second looks for the negatives of each positive: the bound must meet its window
[percent * positive, positive] above the worst negative found so far.  A task keeps the best few of each anchor
(of each positive) and nothing else, which a window with a group limit merges; all rows meet every anchor of their
dimension.

Defined results: rows with a null label, vector or id, or with a null or non-finite component, take no part, nor do
empty vectors; rows of another length than an anchor's aren't compared with it; rows that repeat an id are candidates each,
and each anchor row is mined for itself, where "other" means another id; equal scores are ordered by id; an anchor without
other rows of its label has no positive and no result, a positive without a row in its window neither; scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquarry.llm.tables import cut, gather, load

ANCHORS, ROWS = 2048, 4096
EXACT = 2.0**52
LEAST = np.iinfo(np.int64).min


def prepared(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """(row, vec_id, label, vec) of the rows that take part; vec holds whole numbers as doubles."""
    x = F.transform(F.col(vec), lambda v: v.cast("double"))
    fine = F.forall(F.col(vec), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0) & fine)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * 256).cast("double")).alias("vec"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _dot(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond what doubles hold, in long arithmetic."""
    if rows.size and anchors.size and np.abs(rows).max() * np.abs(anchors).max() * rows.shape[1] >= EXACT:
        return rows.astype(np.int64) @ anchors.astype(np.int64).T
    return (rows @ anchors.T).astype(np.int64)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, length): rows in the order they join the minimum spanning tree from row 0, each one's parent (-1: root) and edge length."""
    n = len(vectors)
    norms = (vectors**2).sum(axis=1)
    best, parent = np.full(n, np.inf), np.full(n, -1)
    order, open_, at = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool), 0
    for i in range(n):
        order[i], open_[at] = at, False
        far = np.maximum(norms + norms[at] - 2 * vectors @ vectors[at], 0)
        closer = open_ & (far < best)
        best[closer], parent[closer] = far[closer], at
        at = int(np.where(open_, best, np.inf).argmin())
    length = np.array([0.0 if p < 0 else np.sqrt(((vectors[i] - vectors[p]) ** 2).sum()) for i, p in enumerate(parent)])
    return order, parent, length


def anchor_trees(anchors: DataFrame, size: int = ANCHORS) -> DataFrame:
    """(block, place, anchor, anchor_id, label, vec, parent, length) of anchors(row, vec_id, label, vec): blocks of one dimension, places in tree order.

    Anchors are ordered along a fixed direction and cut there, so blocks hold near ones; the cuts are a window over
    range totals and a number inside each range.
    """
    wave = F.aggregate(F.transform("vec", lambda v, i: v * F.cos(i * 1.7 + 0.3)), F.lit(0.0), lambda a, b: a + b)
    ranged = cut(anchors.withColumn("dim", F.size("vec")).withColumn("at", wave).repartitionByRange("dim", "at", "row").withColumn("part", F.spark_partition_id()))
    per = ranged.groupBy("dim", "part").agg(F.count("*").alias("n"))
    ahead = per.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("dim", "part").orderBy("at", "row")) - 1
    placed = ranged.withColumn("nth", nth).join(ahead.select("dim", "part", "ahead"), ["dim", "part"])
    placed = placed.withColumn("block", F.concat_ws(":", "dim", F.floor((F.col("ahead") + F.col("nth")) / size).cast("string")))

    def tree(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("at", "ascending"), ("row", "ascending")])
        order, parent, length = spanning_tree(_matrix(table["vec"].chunk(0)))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        out = table.take(order)
        up = np.where(parent[order] < 0, -1, place[parent[order]])
        columns = [out["block"], pa.array(np.arange(len(order))), out["row"], out["vec_id"], out["label"], out["vec"], pa.array(up), pa.array(length[order])]
        return pa.table(columns, names=["block", "place", "anchor", "anchor_id", "label", "vec", "parent", "length"])

    return placed.groupBy("block").applyInArrow(tree, "block string, place long, anchor long, anchor_id long, label long, vec array<double>, parent long, length double")


class _Best:
    """The k best (score, then smaller id) of each of some lists."""

    def __init__(self, lists: int, k: int) -> None:
        self.k = k
        self.score = [np.zeros(0, np.int64)] * lists
        self.id = [np.zeros(0, np.int64)] * lists
        self.worst = np.full(lists, LEAST)

    def add(self, at: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate((self.score[at], score)), np.concatenate((self.id[at], ids))
        if len(score) > 16 * self.k:  # only what reaches the k-th score needs sorting
            some = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[some], ids[some]
        order = np.lexsort((ids, -score))[: self.k]
        self.score[at], self.id[at] = score[order], ids[order]
        if len(order) == self.k:
            self.worst[at] = score[order[-1]]

    def rows(self, names: list[tuple], columns: list[str]) -> pa.RecordBatch:
        sizes = [len(x) for x in self.id]
        of = np.repeat(np.arange(len(sizes)), sizes)
        own = [pa.array([n[i] for n in names], pa.int64()).take(pa.array(of)) for i in range(len(names[0]))]
        return pa.record_batch([*own, pa.array(np.concatenate(self.id)), pa.array(np.concatenate(self.score))], names=columns)


class Tree:
    """One block of anchors, in the order of its spanning tree, as tasks read it."""

    def __init__(self, block: pa.Table) -> None:
        self.anchor, self.anchor_id, self.label, self.parent, self.length = (block[c].to_numpy() for c in ("anchor", "anchor_id", "label", "parent", "length"))
        self.vectors = _matrix(block["vec"].combine_chunks())
        self.last = {int(p): i for i, p in enumerate(self.parent)}  # the bounds of a parent are held until its last child

    def descend(self, x: np.ndarray, needs: Callable, take: Callable) -> int:
        """Every anchor meets all rows of x: take(place, rows, scores) gets those that needs(place, low, high) can't rule out by their bounds.  How many were scored."""
        norm, scored = np.sqrt((x**2).sum(axis=1)), 0
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for place, up in enumerate(self.parent.tolist()):
            if up < 0:
                low, high = np.full(len(x), -np.inf), np.full(len(x), np.inf)
                open_ = np.arange(len(x))
            else:
                reach = self.length[place] * norm
                reach = reach + 1 + 1e-9 * (np.abs(bounds[up][1]) + reach)  # rounding never cuts a row off
                low, high = bounds[up][0] - reach, bounds[up][1] + reach
                open_ = np.flatnonzero(needs(place, low, high))
                if self.last[up] == place:
                    del bounds[up]
            if len(open_):
                exact = _dot(x[open_], self.vectors[place : place + 1])[:, 0]
                low[open_] = high[open_] = exact
                take(place, open_, exact)
                scored += len(open_)
            if place in self.last:
                bounds[place] = (low, high)
        return scored


def _answers(rows: DataFrame, tree: Tree, lists: int, k: int, looked: Callable, names: list[tuple], columns: list[str]) -> DataFrame:
    """(*columns): in each task the k best of each list; looked(best, ids, labels) -> (needs, take) for a slice of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(lists, k)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                tree.descend(_matrix(part.column("vec")), *looked(best, part.column("vec_id").to_numpy(), part.column("label").to_numpy()))
        if lists:
            yield best.rows(names, columns)

    of_size = rows.where(F.size("vec") == tree.vectors.shape[1]).select("vec_id", "label", "vec")
    return of_size.mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def _positives(rows: DataFrame, tree: Tree, k: int) -> DataFrame:
    def looked(best: _Best, ids: np.ndarray, labels: np.ndarray) -> tuple[Callable, Callable]:
        def needs(place: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return (labels == tree.label[place]) & (high >= best.worst[place])

        def take(place: int, at: np.ndarray, scores: np.ndarray) -> None:
            some = (labels[at] == tree.label[place]) & (ids[at] != tree.anchor_id[place]) & (scores >= best.worst[place])
            if some.any():
                best.add(place, scores[some], ids[at][some])

        return needs, take

    return _answers(rows, tree, len(tree.anchor), k, looked, [(int(x),) for x in tree.anchor], ["anchor", "positive_id", "positive_score"])


def _negatives(rows: DataFrame, tree: Tree, windows: dict[int, list[tuple[int, int]]], k: int, percent: int) -> DataFrame:
    """windows: for an anchor its positives as (number, score)."""
    of = [windows.get(int(a), []) for a in tree.anchor]
    names = [(int(a), number) for a, own in zip(tree.anchor, of, strict=True) for number, _ in own]
    first = np.concatenate(([0], np.cumsum([len(x) for x in of])))
    tops = [score for own in of for _, score in own]
    bottoms = [-(-percent * score // 100) for score in tops]

    def looked(best: _Best, ids: np.ndarray, labels: np.ndarray) -> tuple[Callable, Callable]:
        def needs(place: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            out = np.zeros(len(labels), dtype=bool)
            for i in range(first[place], first[place + 1]):
                out |= (high >= max(bottoms[i], best.worst[i])) & (low <= tops[i])
            return out & (labels != tree.label[place])

        def take(place: int, at: np.ndarray, scores: np.ndarray) -> None:
            other = labels[at] != tree.label[place]
            for i in range(first[place], first[place + 1]):
                some = other & (scores >= max(bottoms[i], best.worst[i])) & (scores <= tops[i])
                if some.any():
                    best.add(i, scores[some], ids[at][some])

        return needs, take

    return _answers(rows, tree, len(names), k, looked, names, ["anchor", "number", "negative_id", "negative_score"])


def _ranked(found: DataFrame, by: list[str], score: str, name: str, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), name)
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80, size: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); rows and anchors as ``prepared`` gives them, anchors among the rows."""
    trees = cut(anchor_trees(anchors, size))
    names = [r.block for r in trees.select("block").distinct().orderBy("block").toLocalIterator()]

    def mined() -> Iterator[DataFrame]:
        for name in names:
            own = trees.where(F.col("block") == name)
            tree = Tree(own.orderBy("place").toArrow())  # at most ``size`` vectors
            near = cut(_ranked(_positives(rows, tree, positives), ["anchor"], "positive_score", "positive_id", positives, "number"))
            windows: dict[int, list[tuple[int, int]]] = {}
            for r in near.orderBy("anchor", "number").collect():  # a few rows an anchor of the block
                windows.setdefault(r.anchor, []).append((r.number, r.positive_score))
            found = _ranked(_negatives(rows, tree, windows, negatives, percent), ["anchor", "number"], "negative_score", "negative_id", negatives, "rank")
            out = found.join(near, ["anchor", "number"]).join(own.select("anchor", "anchor_id"), "anchor")
            yield out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

    return gather(rows.sparkSession, mined(), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = cut(prepared(table.select("vec_id", label.alias("label"), "embedding")))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


ORACLE = """
WITH r AS (
  SELECT row_number() OVER () AS nth, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT nth, vec_id AS anchor_id, label, v FROM r WHERE vec_id % 100 = 0),
s AS (
  SELECT a.nth, a.anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM a, r WHERE len(a.v) = len(r.v)),
p AS (
  SELECT nth, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id) AS number
  FROM s WHERE same AND vec_id <> anchor_id QUALIFY number <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.nth, number ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.nth = p.nth AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
