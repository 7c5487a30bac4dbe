"""Hard-negative mining against scores of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquarry.llm import hard_negatives, registry
from tests.oracle import assert_matches

SCHEMA = "vec_id long, embedding array<double>, label int"


def mined(rows):
    """Rows (vec_id, vector, label) of the result by plain loops."""
    fine = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, y in fine:
        if a % 100:
            continue
        score = [(-sum(p * q for p, q in zip(v, w, strict=True)), i, z) for i, w, z in fine if len(w) == len(v)]
        for s, i, _ in sorted(x for x in score if x[2] == y and x[1] != a)[:5]:
            inside = [(t, j) for t, j, z in score if z != y and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, i, n, j, -s, -t) for n, (t, j) in enumerate(sorted(inside)[:5], 1)]
    return sorted(out)


def result(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def mine(spark, rows, schema=SCHEMA, **more):
    table = hard_negatives.prepared(spark.createDataFrame(rows, schema).repartition(3))
    return hard_negatives.hard_negatives(hard_negatives.cut(table), hard_negatives.cut(table).where("vec_id % 100 = 0"), **more)


@pytest.mark.parametrize("size", [3, 2048])
def test_equals_all_pairs(spark, size):
    """Clusters, ties, repeated rows and several blocks of anchors."""
    rng = np.random.RandomState(4)
    centres = rng.randn(4, 6)
    rows = [(int(i), [float(round(x, 1)) for x in centres[i % 4] + rng.randn(6) * 0.4], int(rng.randint(3))) for i in range(0, 900, 5)]
    rows += rows[3:9] + rows[:1]
    got = result(mine(spark, rows, size=size))
    assert len(got) > 100 and got == mined(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.45, 9.0], 2), (3, None, 1), (4, [nan, 1.0], 2), (5, [inf, 0.0], 2), (6, [1.0, None], 2), (7, [1.0, 0.0], None), (None, [0.5, 0.0], 2), (8, [], 2), (100, [0.5], 1), (101, [0.5], 2), (200, [0.1, 0.1, 0.1], 7)]
    rows += [(9, [0.41, -2.0], 2), (10, [0.5, 1.0], 3), (11, [0.3, 1.0], 3), (300, [-1.0, 0.0], 4), (12, [1.0, 0.0], 4)]
    assert result(mine(spark, rows)) == mined(rows) and mined(rows)
    assert mine(spark, []).count() == 0
    large = [(100, [3e6, -2e6], 1), (1, [4e6, 1e6], 1), (2, [3.5e6, 1e6], 2), (3, [3.9e6, 1e6 + 7], 2)]
    assert result(mine(spark, large)) == mined(large) and mined(large)
    odd = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("row", "vec", "block", "anchor", "place", "rank", "number")})
    assert hard_negatives.prepared(odd).count() == len([r for r in rows if r[0] in (0, 1, 2, 9, 10, 11, 12, 100, 101, 200, 300)])


def test_tree_is_minimal_and_spares_scores():
    rng = np.random.RandomState(7)
    vectors = rng.randint(-99, 99, (40, 5)).astype(float)
    order, parent, length = hard_negatives.spanning_tree(vectors)
    far = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2))
    joined, total = {0}, 0.0
    while len(joined) < 40:
        d, j = min((far[i, j], j) for i in joined for j in range(40) if j not in joined)
        joined.add(j)
        total += d
    assert math.isclose(length.sum(), total) and order[0] == 0 and (parent < 0).sum() == 1
    assert all(list(order).index(parent[i]) < list(order).index(i) for i in order[1:])


def test_bounds_spare_most_scores_of_clusters():
    """Rows far from what an anchor looks for are ruled out by their bounds, and none that it wants is."""
    import pyarrow as pa

    rng = np.random.RandomState(8)
    centres = rng.randn(8, 16) * 300
    x = np.floor(np.repeat(centres, 200, axis=0) + rng.randn(1600, 16) * 4)
    anchors = np.floor(np.repeat(centres, 4, axis=0) + rng.randn(32, 16) * 4)
    order, parent, length = hard_negatives.spanning_tree(anchors)
    place = np.argsort(order)
    block = pa.table({"anchor": order, "anchor_id": order, "label": order, "vec": list(anchors[order]), "parent": np.where(parent[order] < 0, -1, place[parent[order]]), "length": length[order]})
    tree, seen = hard_negatives.Tree(block), {}
    exact = x @ anchors[order].T
    least = np.sort(exact, axis=0)[-50]
    scored = tree.descend(x, lambda p, low, high: high >= least[p], lambda p, at, s: seen.update({p: set(at[s >= least[p]])}))
    assert all(seen[p] == set(np.flatnonzero(exact[:, p] >= least[p])) for p in range(32))
    assert scored < 0.5 * exact.size


def test_query_on_a_larger_table(spark):
    assert_matches(registry.queries()["op13_hard_negatives"](spark, "/root/testdata/sf0.1"), registry.oracle_sql()["op13_hard_negatives"], "/root/testdata/sf0.1")
