"""The versioned store, the inverted index in it, and plans applied to it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkquarry.operators import apply, retrieval, text_index
from sparkquarry.sources import scratch, store

ROWS = "doc_id long, title string, section_path string, content string"


def words(n, rng, many=60):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), many)}" for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(5)
    rows = [(i, words(4, rng), words(2, rng), words(rng.choice([3, 30, 200]), rng, 400)) for i in range(240)]
    rows += [(240, None, None, None), (241, "", "", ""), (242, "W1 w1-W2", "x", "ÄÖ w3"), (None, "w1", "w1", "w1")]
    return spark.createDataFrame(rows, ROWS).withColumn("key", F.lit("clash"))


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(6)
    return spark.createDataFrame([(q, words(rng.choice([1, 3, 12]), rng, 500)) for q in range(25)] + [(90, None), (91, "nothing-like-it"), (92, "w1 w1 W1")], "query_id long, query string")


def hits(df):
    return sorted((r.query_id, r.doc_id, round(r.score, 5), r["rank"]) for r in df.collect())


# store


def test_a_version_is_all_or_nothing(spark, tmp_path, monkeypatch):
    root, key = str(tmp_path / "store"), F.col("id") % 4
    assert store.version(spark, root).number == 0 and store.numbers(spark, root) == []
    first = store.Version().changed("t", store.stage(spark.range(40), root, key)).changed("u", store.stage(spark.range(3), root, F.lit("all")))
    one = store.commit(spark, root, first.noted(made_by="test"))
    at = store.version(spark, root)
    assert (at.number, at.notes, at.tables) == (1, {"made_by": "test"}, one.tables)
    assert store.read(spark, root, at, "t", "id long").count() == 40 and store.read(spark, root, at, "t", "id long", [1, 7]).count() == 10
    assert store.read(spark, root, at, "none", "id long").count() == 0

    stale = at.changed("t", {"0": []})
    store.commit(spark, root, at.changed("t", {"1": []}).changed("t", store.stage(spark.range(1), root, F.lit(3)), add=True))
    with pytest.raises(store.Conflict):
        store.commit(spark, root, stale)
    monkeypatch.setattr(store, "numbers", lambda *_: [1])  # another writer takes the number after it was looked up
    with pytest.raises(store.Conflict):
        store.commit(spark, root, stale)
    monkeypatch.undo()
    now = store.version(spark, root)
    assert now.number == 2 and store.read(spark, root, now, "t", "id long").count() == 31 and store.read(spark, root, store.version(spark, root, 1), "t", "id long").count() == 40
    with pytest.raises(FileNotFoundError):
        store.version(spark, root, 9)
    lost = store.stage(spark.range(5), root, F.lit("x"))["x"][0].split("/")[0]
    assert store.unreferenced(spark, root) == [lost]


def test_scratch_is_deleted(spark):
    with scratch.folder(spark) as name:
        spark.range(3).write.parquet(name)
        kept = scratch.written(spark.read.parquet(name))
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) and kept.count() == 3


# inverted index


def test_index_gives_the_rows_of_a_scan(spark, tmp_path, documents, questions):
    """Several additions, merged segments, one field and three, few and many blocks."""
    root = str(tmp_path / "one")
    for part in range(3):
        text_index.add_documents(spark, root, documents.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)) == part), ["content"], buckets=8, block_docs=8)
    want = hits(retrieval.bm25_top_k(documents.where("doc_id IS NOT NULL"), questions, 7, fields={"content": 1.0}))
    for first_blocks in (1, 4):
        assert hits(text_index.bm25_search(text_index.Reader(spark, root), questions, 7, first_blocks=first_blocks)) == want
    text_index.merged_segments(spark, root)
    assert all(len(f) == 1 for f in store.version(spark, root).tables["postings"].values())
    assert hits(text_index.bm25_search(text_index.Reader(spark, root), questions, 7)) == want and want
    early = text_index.bm25_search(text_index.Reader(spark, root, 1), questions, 7)
    assert hits(early) == hits(retrieval.bm25_top_k(documents.where("doc_id % 3 = 0"), questions, 7, fields={"content": 1.0}))

    root, fields = str(tmp_path / "three"), list(retrieval.FIELD_WEIGHTS)
    text_index.add_documents(spark, root, documents, fields, buckets=8)
    want = hits(retrieval.bm25_top_k(documents.where("doc_id IS NOT NULL"), questions, 9, fields=retrieval.FIELD_WEIGHTS))
    assert hits(text_index.bm25_search(text_index.Reader(spark, root), questions, 9)) == want


def test_search_reads_the_buckets_of_its_terms(spark, tmp_path, documents):
    root = str(tmp_path / "index")
    text_index.add_documents(spark, root, documents, ["content"], buckets=64)
    asked = spark.createDataFrame([("w1",), ("w7",), ("w300",)], "term string")
    wanted = {r[0] for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(64))).collect()}
    stored = text_index.Reader(spark, root).of(asked)
    read = {int(re.search(r"_part=(\d+)", f)[1]) for f in stored.inputFiles()}
    assert read <= wanted and len(read) <= 3 and {r.term for r in stored.collect()} <= {"w1", "w7", "w300"}
    assert len(store.version(spark, root).tables["postings"]) > 30


def test_blocks_under_the_bound_are_not_scored(spark, tmp_path):
    """Short documents bound their blocks high, long ones low: with ten good hits the long ones stay unread."""
    rng = random.Random(9)
    rows = [(i, f"rare {words(3, rng)}") for i in range(40)] + [(100 + i, f"rare {words(400, rng, 300)}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, content string")
    root = str(tmp_path / "index")
    text_index.add_documents(spark, root, docs, ["content"], buckets=8, block_docs=10)
    reader, asked = text_index.Reader(spark, root), spark.createDataFrame([(1, "rare")], "query_id long, term string")
    stored = reader.of(asked.select("term"))
    known = text_index.term_weights(stored, reader.notes, [1.0])
    bound = text_index.bounds(stored, asked, known)
    exact = text_index.scored(stored, asked, known, bound.select("query_id", "block"))
    found, others = text_index.first_and_others(bound, lambda b: text_index.scored(stored, asked, known, b), 10, 6, 4)
    assert exact.count() == 120 and found.count() == 10
    assert others.count() < bound.count() / 2
    blocks = {r["key"]: r.block for r in stored.select("block", F.explode("postings.key").alias("key")).collect()}
    bounds = {r.block: r.bound for r in bound.collect()}
    assert all(r.score <= bounds[blocks[r["key"]]] + 1e-12 for r in exact.collect())


def test_posting_rows_are_made_where_documents_are_read(spark, documents):
    """A row for each term of a block, whole, without a shuffle of texts or of single postings."""
    docs, fields = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("key"), "title", "content"), ["title", "content"]
    made = text_index.postings(docs, fields, 3, block_docs=16)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    rows, want, got, held = made.collect(), {}, {}, {}
    for d in docs.collect():
        for field, text in enumerate((d.title, d.content)):
            terms = re.findall("[a-z0-9]+", (text or "").lower())
            want |= {(field, t, d["key"]): (terms.count(t), len(terms)) for t in terms}
    for r in rows:
        keys = [p["key"] for p in r.postings]
        assert keys == sorted(set(keys)) and r.n == len(keys) and r.max_tf == max(p.tf for p in r.postings) and r.min_length == min(p.length for p in r.postings)
        got |= {(r.field, r.term, p["key"]): (p.tf, p.length) for p in r.postings}
        held.setdefault(r.block, set()).update(keys)
    assert got == want and sum(r.n for r in rows) == len(want) and len({(r.field, r.term, r.block) for r in rows}) == len(rows)
    assert max(map(len, held.values())) <= 16 and {b >> 40 for b in held} == {3} and sum(map(len, held.values())) == len(set().union(*held.values()))


def test_blocks_are_bounded_by_words(monkeypatch):
    import numpy as np

    monkeypatch.setattr(text_index, "WORDS", 100)
    words = np.array([5, 60, 0, 30, 500, 7, 101, 99, 1])
    block = text_index._blocks(words, 4)
    for b in range(block.max() + 1):
        own = words[block == b]
        assert 1 <= len(own) <= 4 and (own.sum() <= 100 or len(own) == 1)
    assert all(words[block == b].max() <= words[block == b + 1].min() for b in range(block.max()))


def test_scores_that_round_to_one_value_tie_by_key(spark):
    bound = spark.createDataFrame([(1, 0, 2.0)], "query_id long, block long, bound double")
    score = lambda _: spark.createDataFrame([(1, 9, 1.0000004), (1, 2, 1.0000003), (1, 5, 0.5)], "query_id long, key long, score double")
    found, _ = text_index.first_and_others(bound, score, 1, 6, 4)
    assert [r["key"] for r in found.collect()] == [2]


def test_a_block_hands_on_its_best(spark, tmp_path, documents):
    """Of each query k documents a block at most, all of those that are among its k best."""
    root = str(tmp_path / "index")
    text_index.add_documents(spark, root, documents, ["content"], buckets=8, block_docs=60)
    asked = spark.createDataFrame([(1, "w1"), (1, "w2"), (2, "w5"), (2, "w1"), (2, "w1"), (3, "nothing")], "query_id long, term string")
    reader = text_index.Reader(spark, root)
    stored = reader.of(asked.select("term"))
    known = text_index.term_weights(stored, reader.notes, [1.0])
    chosen = text_index.bounds(stored, asked, known).select("query_id", "block")
    every, best = (text_index.scored(stored, asked, known, chosen, **limit).collect() for limit in ({}, {"k": 3}))
    place = lambda r: (-round(r.score, 6), r["key"])
    for q in (1, 2):
        want = sorted((r for r in every if r.query_id == q), key=place)[:3]
        assert [r["key"] for r in sorted((r for r in best if r.query_id == q), key=place)[:3]] == [r["key"] for r in want]
    assert len(best) <= 3 * chosen.count() < len(every) and {r.query_id for r in every} == {1, 2}


def test_keys_that_repeat_change_nothing(spark, tmp_path, documents, questions):
    root = str(tmp_path / "index")
    text_index.add_documents(spark, root, documents.limit(50), ["content"], buckets=4)
    with pytest.raises(ValueError, match="already or repeat"):
        text_index.add_documents(spark, root, documents.limit(1), ["content"])
    with pytest.raises(ValueError, match="already or repeat"):
        text_index.add_documents(spark, root, documents.where("doc_id = 200").union(documents.where("doc_id = 200")), ["content"])
    with pytest.raises(ValueError, match="fields"):
        text_index.add_documents(spark, root, documents.where("doc_id = 200"), ["title"])
    assert store.version(spark, root).number == 1
    empty = str(tmp_path / "empty")
    assert text_index.bm25_search(text_index.Reader(spark, empty), questions, 3).count() == 0
    text_index.add_documents(spark, empty, documents.limit(0), ["content"])
    assert text_index.bm25_search(text_index.Reader(spark, empty), questions, 3).count() == 0
    assert text_index.bm25_search(text_index.Reader(spark, root), questions.limit(0), 3).count() == 0


# plans


def plan(spark, *pairs):
    wanted = spark.createDataFrame([(i, "u", "a" * 64, h * 64) for i, h in pairs], "row_id string, canonical_url string, page_hash string, embedding_text_hash string")
    return wanted, wanted.select(F.col("row_id").alias("id"), F.col("embedding_text_hash").alias("content"))


def card(spark, title, expected=None):
    return spark.createDataFrame([("n", expected, title)], "namespace string, expected_revision string, title string")


def state(spark, root):
    now = apply.Applied(spark, root)
    index = {(r.id, r.content[0]) for r in now.table("index").collect()}
    ledger = {(r.row_id, r.status, r.plan_id) for r in now.table("ledger").collect()}
    return now.at.number, index, ledger, [r.title for r in now.table("cards").collect()]


def test_an_apply_rewrites_the_buckets_it_touches(spark, tmp_path):
    root = str(tmp_path / "store")
    many = [(f"r{i}", "1") for i in range(200)]
    first = apply.apply_plan(spark, root, *plan(spark, *many), "p1", buckets=16).first()
    assert (first["rows_to_upsert"], first["index_buckets"], first["version"]) == (200, 16, 1)
    before = store.version(spark, root).tables
    one = apply.apply_plan(spark, root, *plan(spark, ("r0", "2"), *many[1:]), "p2").first()
    after = store.version(spark, root).tables
    assert (one["rows_to_upsert"], one["chunks_unchanged"], one["index_buckets"], one["ledger_buckets"]) == (1, 199, 1, 1)
    for table in ("index", "ledger"):
        assert len([b for b in before[table] if before[table][b] != after[table][b]]) == 1
    none = apply.apply_plan(spark, root, *plan(spark, ("r0", "2"), *many[1:]), "p3").first()
    assert (none["index_buckets"], none["ledger_buckets"]) == (0, 0) and store.version(spark, root).tables == after


def test_index_ledger_and_card_follow_plans(spark, tmp_path):
    root = str(tmp_path / "store")
    apply.apply_plan(spark, root, *plan(spark, ("a", "1"), ("b", "1")), "p1", card=card(spark, "one"), buckets=4)
    assert state(spark, root) == (1, {("a", "1"), ("b", "1")}, {("a", "active", "p1"), ("b", "active", "p1")}, ["one"])
    apply.apply_plan(spark, root, *plan(spark, ("b", "2"), ("c", "1")), "p2")
    assert state(spark, root)[1:] == ({("a", "1"), ("b", "2"), ("c", "1")}, {("a", "retained_stale", "p1"), ("b", "active", "p2"), ("c", "active", "p2")}, ["one"])
    apply.apply_plan(spark, root, *plan(spark, ("a", "3"), ("b", "2")), "p3")
    assert ("a", "active", "p3") in state(spark, root)[2] and ("c", "retained_stale", "p2") in state(spark, root)[2]
    apply.apply_plan(spark, root, *plan(spark, ("b", "2")), "p4", delete_stale=True)
    assert state(spark, root)[1:3] == ({("b", "2")}, {("b", "active", "p2")})
    apply.apply_plan(spark, root, *plan(spark), "p5", delete_stale=True)
    assert state(spark, root) == (5, set(), set(), ["one"])
    with pytest.raises(ValueError, match="columns"):
        wanted, chunks = plan(spark, ("b", "2"))
        apply.apply_plan(spark, root, wanted, chunks.withColumn("more", F.lit(1)), "p6")


@pytest.mark.parametrize("fails", [("stage", 1), ("stage", 3), ("commit", 1)])
def test_a_crash_at_any_point_changes_nothing(spark, tmp_path, monkeypatch, fails):
    root = str(tmp_path / "store")
    apply.apply_plan(spark, root, *plan(spark, ("a", "1"), ("b", "1")), "p1", card=card(spark, "one"), buckets=4)
    before, revision = state(spark, root), apply.Applied(spark, root).table("cards").first()["card_revision"]
    name, nth = fails
    real, calls = getattr(store, name), []

    def crash(*args, **kwargs):
        calls.append(1)
        if len(calls) == nth:
            raise RuntimeError("lost")
        return real(*args, **kwargs)

    monkeypatch.setattr(store, name, crash)
    change = dict(delete_stale=True, card=card(spark, "two", revision))
    with pytest.raises(RuntimeError):
        apply.apply_plan(spark, root, *plan(spark, ("b", "2"), ("c", "1")), "p2", **change)
    monkeypatch.undo()
    assert state(spark, root) == before
    apply.apply_plan(spark, root, *plan(spark, ("b", "2"), ("c", "1")), "p2", **change)
    assert state(spark, root) == (2, {("b", "2"), ("c", "1")}, {("b", "active", "p2"), ("c", "active", "p2")}, ["two"])


def test_conflicts_change_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    apply.apply_plan(spark, root, *plan(spark, ("a", "1")), "p1", card=card(spark, "one"), buckets=4)
    before = state(spark, root)
    for wrong in (card(spark, "two"), card(spark, "two", "other revision")):
        with pytest.raises(store.Conflict, match="revision"):
            apply.apply_plan(spark, root, *plan(spark, ("a", "2")), "p2", card=wrong)
    with pytest.raises(store.Conflict, match="current"):
        apply.apply_plan(spark, root, *plan(spark, ("a", "2")), "p2", expected=0)
    assert state(spark, root) == before
    real = store.stage

    def overtaken(*args, **kwargs):
        monkeypatch.undo()
        apply.apply_plan(spark, root, *plan(spark, ("z", "9")), "other")
        return real(*args, **kwargs)

    monkeypatch.setattr(store, "stage", overtaken)
    with pytest.raises(store.Conflict):
        apply.apply_plan(spark, root, *plan(spark, ("a", "2")), "p2")
    assert state(spark, root)[1:3] == ({("a", "1"), ("z", "9")}, {("a", "retained_stale", "p1"), ("z", "active", "other")})
