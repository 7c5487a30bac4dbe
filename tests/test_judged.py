"""Judgments credited to hits against a plain greedy loop."""

import math
import random
from urllib.parse import unquote, urlparse

import pytest

from sparkquarry.operators import judged

HITS = "query_id long, rank int, url string, path string, repo_path string, section_path string"
JUDGMENTS = "query_id long, url string, repo_path string, section_path string, grade int"


def plain(x):
    return unquote((x or "").strip()).replace("\\", "/").strip("/")


def location(x):
    x = unquote((x or "").strip())
    parsed = urlparse(x)
    if parsed.netloc:
        return f"{parsed.netloc.lower()}/{plain(parsed.path)}".rstrip("/")
    return x.rstrip("/").lower()


def section(x):
    return " ".join((x or "").lower().split())


def key(j):
    return f"repo_path:{plain(j[2])}" if j[2] else f"url:{location(j[1])}" if j[1] else f"section_path:{section(j[3])}"


def paths(hit):
    _, _, url, path, repo, _ = hit
    parts = [p for p in plain(urlparse(url).path if "://" in (url or "") else url).split("/") if p]
    found = {plain(path), plain(repo), *("/".join(parts[i:]) for i in range(len(parts)))}
    for marker in ("blob", "tree"):
        if marker in parts and len(parts) > parts.index(marker) + 2:
            found.add("/".join(parts[parts.index(marker) + 2 :]))
    return found - {""}


def fits(j, hit):
    a, b = location(j[1]), location(hit[2])
    ok = bool(j[1] and a and b and (a in b or b in a)) or bool(j[2] and plain(j[2]) in paths(hit))
    have, want = section(hit[5]), section(j[3])
    return ok and (not j[3] or (bool(have) and (have in want or want in have)))


def greedy(hits, judgments):
    out = []
    for q in sorted({h[0] for h in hits}):
        own = {}
        for j in sorted((j for j in judgments if j[0] == q and j[4] > 0), key=lambda j: (-j[4], j[1] or "", j[2] or "", j[3] or "")):
            own.setdefault(key(j), j)
        used = set()
        for hit in sorted(h for h in hits if h[0] == q):
            free = sorted((-j[4], k) for k, j in own.items() if k not in used and fits(j, hit))
            if free:
                used.add(free[0][1])
                out.append((q, hit[1], free[0][1], -free[0][0]))
    return out


def made(seed):
    rng = random.Random(seed)
    names = ["a.py", "b.py", "src/a.py", "lib/a.py"]
    hits, judgments = [], []
    for q in range(12):
        for rank in range(1, rng.randrange(2, 9)):
            name = rng.choice(names)
            url = rng.choice([f"https://Host.example/o/r/blob/main/{name}", f"https://host.example/o/r/tree/v1/{name}/", "https://other.example/x%20y", "", None])
            hits.append((q, rank, url, rng.choice([name, None, f"/{name}"]), rng.choice([None, name]), rng.choice(["Guide  Setup", "setup", "", None])))
        for _ in range(rng.randrange(1, 7)):
            name = rng.choice(names)
            by_url = rng.choice([None, "host.example/o/r", f"https://HOST.example/o/r/blob/main/{name}", "https://other.example/x y", ""])
            judgments.append((q, by_url, rng.choice([None, name, f"{name}/"]), rng.choice([None, "", "SETUP", "guide"]), rng.randrange(0, 4)))
    return hits, judgments


@pytest.mark.parametrize("seed", range(2))
def test_assignment_is_greedy(spark, seed):
    hits, judgments = made(seed)
    wanted = judged.distinct_judgments(spark.createDataFrame(judgments, JUDGMENTS))
    got = judged.assigned(judged.matches(spark.createDataFrame(hits, HITS), wanted)).collect()
    want = greedy(hits, judgments)
    assert sorted((r.query_id, r["rank"], r.key, r.grade) for r in got) == sorted(want) and len(want) > 10


def test_rivals_for_one_hit_and_one_judgment_for_several_hits(spark):
    hits = [(1, 1, "https://h/o/r/blob/m/a.py", None, None, None), (1, 2, None, "a.py", None, None), (1, 3, None, None, "a.py", None), (2, 1, "https://h/x", None, None, "S")]
    judgments = [(1, None, "a.py", None, 1), (1, "h/o/r", None, None, 3), (2, None, None, "S", 3), (2, "h/x", None, "T", 2)]
    df = spark.createDataFrame(hits, HITS)
    found = {(r.query_id, r["rank"], r.grade) for r in judged.assigned(judged.matches(df, judged.distinct_judgments(spark.createDataFrame(judgments, JUDGMENTS)))).collect()}
    assert found == {(1, 1, 3), (1, 2, 1)}
    metrics = {r.query_id: r for r in judged.judged_metrics(df, spark.createDataFrame(judgments, JUDGMENTS)).collect()}
    assert math.isclose(metrics[1].ndcg, 1.0) and metrics[1].recall == 1 and math.isclose(metrics[1].precision, 2 / 3) and metrics[1].first_rank == 1
    assert metrics[2].composite == 0 and metrics[2].first_rank is None and metrics[2].judged == 2
    assert judged.judged_metrics(df, spark.createDataFrame([(1, "h", None, None, 0)], JUDGMENTS)).count() == 0


def test_first_hint(spark):
    hits = spark.createDataFrame([(1, 1, "https://a/Guide", "nothing"), (1, 2, "https://a/b", "About TOKENS"), (2, 1, "https://a/b", "tokens and url a/b"), (3, 1, None, None)], "query_id long, rank int, url string, text string")
    hints = [(1, "url", 1, "A/B"), (1, "topic", 1, "tokens"), (2, "topic", 1, "tokens"), (2, "url", 2, "a/b"), (2, "url", 1, "a"), (3, "topic", 1, ""), (4, "url", 1, "x")]
    got = {r.query_id: (r.passed, r["rank"], r.kind, r.hint) for r in judged.first_hint(hits, spark.createDataFrame(hints, "query_id long, kind string, ordinal int, hint string")).collect()}
    assert got == {1: (True, 2, "url", "a/b"), 2: (True, 1, "url", "a"), 3: (False, None, None, None), 4: (False, None, None, None)}
