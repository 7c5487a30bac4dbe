"""Routing floors against the full product of breakpoints and cases."""

import math
import random

import pytest

from sparkquarry.operators import calibration

CASES = "score double, margin double, correct boolean, ranked int"


def usable(x):
    return x is not None and math.isfinite(x)


def by_product(rows):
    """Every pair of floors over every case."""
    above = lambda xs: sorted({y for x in xs for y in (x, math.nextafter(x, math.inf))})
    scores = above([s for s, _, _, _ in rows if usable(s)])
    margins = above([m for _, m, _, _ in rows if usable(m)] or [0.0])
    best = None
    for s in scores:
        for m in margins:
            sure = [usable(a) and usable(b) and a >= s and b >= m for a, b, _, _ in rows]
            if any(x and not c for x, (_, _, c, _) in zip(sure, rows, strict=True)):
                continue
            fanout = sum(1 if x else min(3, n or 0) for x, (_, _, _, n) in zip(sure, rows, strict=True)) / len(rows)
            best = max(best or (-1,), (sum(sure), -fanout, s, m))
    return best


def chosen(spark, rows, **more):
    found = calibration.choose_floors(spark.createDataFrame(rows, CASES), **more).collect()
    return [(r.correct, -r.average_fanout, r.score_floor, r.margin_floor) for r in found]


@pytest.mark.parametrize("seed", range(4))
def test_floors_equal_the_full_product(spark, seed):
    rng = random.Random(seed)
    grid = [3, 20, 1000][seed % 3]
    rows = []
    for _ in range(rng.choice([1, 8, 60])):
        score, margin = (round(rng.gauss(0, 1) * grid) / grid for _ in range(2))
        correct = rng.random() < 1 / (1 + math.exp(-2 * score - margin - [0, 2, -8][seed % 3]))
        rows.append((score, None if rng.random() < 0.1 else margin, correct, rng.randrange(1, 6)))
    rows += rows[:3]
    want = by_product(rows)
    for range_rows in (3, 50_000)[seed % 2 :]:
        got = chosen(spark, rows, range_rows=range_rows)
        assert len(got) == 1 and got[0][0] == want[0] and got[0][2:] == want[2:] and math.isclose(got[0][1], want[1])


def test_floors_of_odd_cases(spark):
    nan = float("nan")
    rows = [(1.0, 0.5, True, 3), (nan, 0.5, True, 3), (None, None, None, None), (2.0, nan, False, 2), (2.0, float("inf"), False, 2), (0.5, 0.7, True, 9)]
    assert chosen(spark, rows)[0] == pytest.approx(by_product(rows))
    assert chosen(spark, [(1.0, 0.5, False, 3)])[0] == pytest.approx(by_product([(1.0, 0.5, False, 3)]))
    assert chosen(spark, [(1.0, None, True, 3)])[0] == pytest.approx(by_product([(1.0, None, True, 3)]))
    assert chosen(spark, []) == []


def test_no_pairs_of_floors_in_the_plan(spark):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        calibration.choose_floors(spark.createDataFrame([(1.0, 0.5, True, 3)] * 3, CASES)).explain()
    text = out.getvalue()
    assert "CartesianProduct" not in text


def test_running_totals_over_ranges(spark):
    rows = [(float(i), i % 7, i % 5 if i % 3 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "at double, s long, m long")
    got = {r["at"]: (r.s, r.m) for r in calibration.running(df, "at", {"s": "sum", "m": "max"}, range_rows=9).collect()}
    for at, _, _ in rows:
        over = [r for r in rows if r[0] >= at]
        assert got[at] == (sum(r[1] for r in over), max((r[2] for r in over if r[2] is not None), default=None))


def test_cases_that_floors_can_be_chosen_on(spark):
    schema = "query_id long, split string, role string, expected array<string>, fallback array<string>, subject string"
    rows = [
        (1, "calibration", "self", ["a"], ["a", "b"], "a"),
        (2, "calibration", "self", ["a", "b"], ["a"], "a"),
        (3, "calibration", "contrast_other", ["b"], ["b", "a"], "a"),
        (4, "calibration", "contrast_other", ["b"], ["a", "b"], "a"),
        (5, "calibration", "contrast_other", ["b"], ["c"], None),
        (6, "certification", "self", ["a"], ["a"], "a"),
        (7, "calibration", "named_self", ["a"], ["a"], "a"),
        (8, "calibration", "self", [], None, "a"),
    ]
    cases = calibration.calibration_cases(spark.createDataFrame(rows, schema))
    assert {r.query_id for r in cases.collect()} == {1, 2, 3, 4, 5, 8}
    found = {(r.query_id, r.reason) for r in calibration.case_violations(cases).collect()}
    several, outside = "expects several namespaces or none", "contrast case outside its fallback"
    assert found == {(2, several), (4, "contrast case routed to its subject"), (5, outside), (5, "contrast case without a subject"), (8, several)}
