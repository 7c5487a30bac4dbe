"""N-gram Jaccard join against counts over all pairs that share an n-gram."""

import random

import numpy as np
import pytest

from sparkquarry.llm import jaccard_join
from tests.llm import brute
from tests.llm.test_operators import empty, near_copies, odd, table  # noqa: F401  (fixtures)


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def related():
    """Groups of texts at every distance from one another, stock passages in unrelated texts, nested texts and short ones."""
    random.seed(11)
    stock = [[f"s{j}_{i}" for i in range(40)] for j in range(3)]
    texts = []
    for g in range(6):
        base = [f"g{g}_{random.randrange(300)}" for _ in range(random.choice([30, 90, 200]))]
        for _ in range(25):
            w = list(base)
            for _ in range(random.randrange(0, 12)):
                w[random.randrange(len(w))] = f"e{random.randrange(10_000)}"
            if random.random() < 0.3:
                w = w[: int(len(w) * random.uniform(0.7, 1))]
            texts.append(" ".join(w))
    for j in range(40):
        own = [f"u{j}_{i}" for i in range(random.choice([3, 8, 30]))]
        texts.append(" ".join(own + stock[j % 3] + (stock[0] if j % 2 else [])))
    return texts + texts[:10] + near_copies()


@pytest.mark.parametrize("k,percent,block", [(4, 85, 4), (1, 50, 16)])
def test_equals_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = dict(enumerate(related()))
    rows = jaccard_join.jaccard_join(table(spark, texts.values()).repartition(5), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_components(texts, k, percent)
    sets = {i: brute.shingles(t, k) for i, t in texts.items()}
    assert all(r.n_equal == (sum(s == sets[r.doc_id] for s in sets.values()) if sets[r.doc_id] else 1) for r in rows)


def test_result_does_not_depend_on_the_order(spark, monkeypatch):
    """Any order of n-grams gives the same components, as does one with all frequencies alike."""
    texts = dict(enumerate(related()))
    want = brute.near_components(texts, 4, 85)
    docs = table(spark, texts.values())
    monkeypatch.setattr(jaccard_join, "frequency_ranks", lambda counters, parts: np.zeros(jaccard_join.CELLS, np.uint16))
    assert result(jaccard_join.jaccard_join(docs, 4, 85)) == want
    ranks = np.random.RandomState(0).randint(0, 60_000, jaccard_join.CELLS).astype(np.uint16)
    monkeypatch.setattr(jaccard_join, "frequency_ranks", lambda counters, parts: ranks)
    assert result(jaccard_join.jaccard_join(docs, 4, 85)) == want


def test_frequencies_are_sums_of_all_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FAN_IN", 2)
    texts = [f"common words here now and own {i}" for i in range(30)]
    made = jaccard_join.described(table(spark, texts).repartition(7), 4)
    ranks = jaccard_join.frequency_ranks(made.where("segment IS NOT NULL").select("part", "segment", "counts"), 7)
    assert ranks.max() == round(np.log2(31) * 1024) and len(ranks) == jaccard_join.CELLS


def test_bounds():
    for percent in (50, 80, 85, 100):
        for x in range(1, 60):
            for y in range(x, 60):
                least = next((i for i in range(x + 1) if 100 * i >= percent * (x + y - i)), None)
                bound = jaccard_join.least_overlap(x, y, percent)
                assert bound == least if least is not None else bound > x
                if least is not None:  # what is left out of both prefixes can't hold the overlap
                    assert x - jaccard_join.prefix(x, percent) < least and y - jaccard_join.prefix(y, percent) < least


def test_edges(spark, odd, empty):  # noqa: F811
    rows = jaccard_join.jaccard_join(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].component_id == 4 and by_id[0].component_id == 0 and by_id[0].n_shingles == 0 and by_id[None].component_id is None
    assert by_id[4].n_equal == 4 and by_id[1].n_equal == 1
    assert jaccard_join.jaccard_join(empty).count() == 0
