"""Trace ingestion by keyed state against classification over the whole store."""

import json
import random
import shutil

from pyspark.sql import functions as F

from sparkquarry.streaming import traces

ENVELOPE = "trace_id string, payload string"


def put(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps({"trace_id": t, "payload": p}) for t, p in rows))


def test_outcomes_are_those_of_classify(spark, tmp_path):
    """Batches with copies, conflicts, replays, rejected envelopes and one id that a third of them share."""
    rng, inbox = random.Random(2), tmp_path / "inbox"
    inbox.mkdir()
    store, receipts, checkpoint = (str(tmp_path / x) for x in ("store", "receipts", "checkpoint"))
    stored = spark.createDataFrame([], "trace_id string, content_hash string")
    for number in range(3):
        rows = [(rng.choice(["hot", f"t{rng.randrange(30)}", f"u{number}-{rng.randrange(20)}"]), rng.choice(['{"n": 1}', '{"n": 1}', f'{{"n": {rng.randrange(3)}}}', "no json", None])) for _ in range(120)] + [(None, "{}"), ("t1", " {} "), ("t2", "{")]
        put(inbox, f"{number}.json", rows)
        traces.ingest(spark, str(inbox), store, receipts, checkpoint).awaitTermination(120)
        want = traces.classify(spark.createDataFrame(rows, ENVELOPE), stored)
        got = spark.read.parquet(f"{receipts}/batch={number}")
        count = lambda df: sorted(((r.trace_id, r.content_hash, r.outcome, r["count"]) for r in df.groupBy("trace_id", "content_hash", "outcome").count().collect()), key=str)
        assert count(got) == count(want)
        new = {(r.trace_id, r.content_hash) for r in want.where("outcome = 'committed'").collect()}
        kept = spark.read.parquet(f"{store}/batch={number}").collect()
        assert len(kept) == len(new) and {(r.trace_id, r.content_hash) for r in kept} == new
        stored = spark.createDataFrame([*stored.collect(), *new], "trace_id string, content_hash string")


def test_a_batch_never_reads_the_store(spark, tmp_path):
    """The store can be gone: what is known is the state, whose size a batch doesn't read either."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    store, receipts, checkpoint = (str(tmp_path / x) for x in ("store", "receipts", "checkpoint"))

    def drain():
        query = traces.ingest(spark, str(inbox), store, receipts, checkpoint)
        query.awaitTermination(120)
        return query

    put(inbox, "0.json", [(f"t{i}", "{}") for i in range(500)])
    drain()
    shutil.rmtree(store)
    put(inbox, "1.json", [("t7", "{}"), ("t8", '{"other": 1}'), ("new", "{}")])
    query = drain()
    assert {(r.trace_id, r.outcome) for r in spark.read.parquet(f"{receipts}/batch=1").collect()} == {("t7", "replayed"), ("t8", "conflict"), ("new", "committed")}
    assert [r.trace_id for r in spark.read.parquet(store).collect()] == ["new"]
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 501 and state["numRowsUpdated"] == 1
    before = {r.trace_id for r in spark.read.parquet(store).collect()}
    drain()  # nothing new arrived
    assert {r.trace_id for r in spark.read.parquet(store).collect()} == before


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """The last batch runs again after a crash before its commit: the same rows in the same folder."""
    inbox, checkpoint = tmp_path / "inbox", tmp_path / "checkpoint"
    inbox.mkdir()
    store, receipts = (str(tmp_path / x) for x in ("store", "receipts"))
    for number, rows in enumerate([[("a", "{}"), ("b", "{}")], [("a", "{}"), ("b", '{"n": 1}'), ("c", "{}")]]):
        put(inbox, f"{number}.json", rows)
        traces.ingest(spark, str(inbox), store, receipts, str(checkpoint)).awaitTermination(120)
    seen = lambda: (sorted(map(tuple, spark.read.parquet(store).select("trace_id", "content_hash", F.col("batch").cast("int")).collect())), sorted(map(tuple, spark.read.parquet(receipts).select("trace_id", "outcome", "batch").collect())))
    before = seen()
    (checkpoint / "commits" / "1").unlink()
    (checkpoint / "commits" / ".1.crc").unlink(missing_ok=True)
    traces.ingest(spark, str(inbox), store, receipts, str(checkpoint)).awaitTermination(120)
    assert seen() == before and ("c", "committed", 1) in before[1]
