"""Filter interaction audit against running every order over the rows one filter after the other."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from sparkquarry.llm import filter_audit
from tests.llm.test_operators import LONG, SCHEMA, empty, odd, table  # noqa: F401  (fixtures)

LABELS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(rows):
    """The letters that each (doc_id, part, text) fails."""
    out = []
    for doc, _, text in rows:
        text = text or ""
        words = WORD.findall(text)
        smaller = doc is not None and any(d is not None and d < doc and (t or "") == text for d, _, t in rows)
        tests = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": smaller,
        }
        out.append({k for k, v in tests.items() if v})
    return out


def by_orders(rows, labels):
    """(part, order, step) -> counts, every order run on the rows."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails, out = failing(rows), {}
    for part in {p or "" for _, p, _ in rows}:
        own = [(d, f) for (d, p, _), f in zip(rows, fails, strict=True) if (p or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left, before = own, []
            for step, letter in enumerate(order, 1):
                gone = [(d, f) for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                redundant = sum(letter in f and bool(f & set(before)) for _, f in own)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(f == {letter} for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                shapley[letter] += len(gone)
                before.append(letter)
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def result(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_lattice_counts_orders():
    reach, leave = filter_audit.lattice(4)
    assert reach[15] == leave[0] == 24 and reach[0b0101] == 2 and leave[0b0101] == 2 and reach[0b0111] == 6
    assert all(sum(reach[s] * leave[s | 1 << b] for s in reach if not s >> b & 1) == 24 for b in range(4))


def test_equals_running_every_order(spark):
    wide = " ".join(f"word{i}" for i in range(250))
    texts = [wide, wide, wide.upper(), "a b #", "x " * 300, "X " * 300, wide + " #", wide + " #", None, "", "A", LONG, "one $ two", wide]
    docs = spark.createDataFrame([(i, t, [None, "en", "", "de"][i % 4], "s", 0) for i, t in enumerate(texts)] * 2, SCHEMA)
    labels = [(i, i % 2, i % 3 == 0) for i in range(len(texts))] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (99, 1, 1)]
    labels = [(d, int(q), int(t)) for d, q, t in labels]
    rows = [(r.doc_id, r.lang, r.text) for r in docs.collect()]
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS), filter_audit.text_failures())
    assert result(got) == by_orders(rows, labels)


def test_edges(spark, odd, empty):  # noqa: F811
    labels = odd.select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"), F.lit(0).alias("part"))
    got = result(filter_audit.audit(odd, labels, filter_audit.text_failures()))
    rows = [(r.doc_id, r.lang, r.text) for r in odd.collect()]
    assert got == by_orders(rows, [(r.doc_id, 1, 0) for r in labels.collect()])
    assert filter_audit.audit(empty, labels, filter_audit.text_failures()).count() == 0
    assert len(result(filter_audit.audit(odd, labels.limit(0), filter_audit.text_failures()))) == len(got)


def test_other_filters(spark):
    docs = table(spark, ["a", "b b", "a", "c c c"])
    labels = spark.createDataFrame([], LABELS)
    got = filter_audit.audit(docs, labels, {"S": F.size("words") < 2, "L": F.size("words") > 2}, repeat=None, part="source")
    assert {(r.filter_order, r.step): (r.kept, r.removed) for r in got.collect()} == {("SL", 1): (2, 2), ("SL", 2): (1, 1), ("LS", 1): (3, 1), ("LS", 2): (1, 2)}
