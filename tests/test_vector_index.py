"""The stored vector index against the full scan, and how much of it is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquarry.operators import retrieval, vector_index

SCHEMA = "vec_id long, embedding array<double>"


def frame(spark, matrix, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(matrix)], SCHEMA)


def hits(df):
    return sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in df.collect())


def queries(spark, matrix):
    return frame(spark, matrix).withColumnRenamed("vec_id", "query_id")


@pytest.mark.parametrize("kind", ["clustered", "flat"])
def test_rows_are_those_of_the_scan(spark, tmp_path, kind):
    rng = np.random.RandomState(3)
    centres = rng.randn(12, 16)
    spread = 0.05 if kind == "clustered" else 3.0
    points = np.repeat(centres, 40, axis=0) + rng.randn(480, 16) * spread
    points[7] = points[3]  # a tie
    rows = frame(spark, points).unionByName(frame(spark, np.zeros((1, 16)), 900)).unionByName(spark.createDataFrame([(901, [1.0, 2.0]), (902, None), (903, []), (None, [0.5] * 16)], SCHEMA))
    asked = queries(spark, np.concatenate((points[::60] + 0.01, rng.randn(3, 16), np.zeros((1, 16)))))
    root = str(tmp_path / "index")
    vector_index.build(spark, root, rows.repartition(3), cells=24, sample=200)
    reader = vector_index.Reader(spark, root)
    assert reader.counts.sum() == 481
    for k in (1, 10):
        want = hits(retrieval.vector_top_k(rows.where("size(embedding) = 16 AND vec_id IS NOT NULL"), asked, k))
        assert hits(vector_index.search(reader, asked, k)) == want
    unit = vector_index._unit(points[::60] + 0.01)
    first, more = vector_index.plan(reader, np.arange(len(unit)), unit, 10, 6)
    share = (first | more).mean()
    assert share < 0.5 if kind == "clustered" else share > 0.5
    exact = unit @ vector_index._unit(points).T
    bound = reader.bounds(unit).max(axis=1)
    assert (bound >= exact.max(axis=1)).all()


def test_versions_and_empty_tables(spark, tmp_path):
    root = str(tmp_path / "index")
    empty = spark.createDataFrame([], SCHEMA)
    asked = queries(spark, np.eye(3))
    vector_index.build(spark, root, empty)
    assert vector_index.search(vector_index.Reader(spark, root), asked, 2).count() == 0
    vector_index.build(spark, root, frame(spark, np.eye(3)).withColumn("cell", F.lit("clash")), cells=2)
    vector_index.build(spark, root, frame(spark, np.eye(3)[:2], 50), cells=9)
    ids = lambda number: {r.vec_id for r in vector_index.search(vector_index.Reader(spark, root, number), asked, 3).collect()}
    assert ids(2) == {0, 1, 2} and ids(3) == {50, 51}
    assert vector_index.search(vector_index.Reader(spark, root), asked.limit(0), 3).count() == 0
