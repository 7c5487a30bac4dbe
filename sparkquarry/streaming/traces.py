"""Query traces: runs and spans of an event stream, graph checks, and exactly-once ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.query import StreamingQuery

from sparkquarry.functions.text import sha256

ENVELOPE = T.StructType([T.StructField("trace_id", T.StringType()), T.StructField("payload", T.StringType())])
STATUS = ("ok", "error")
PAYLOAD_BYTES = 65_536
STATE_STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def spans(events: DataFrame) -> DataFrame:
    """(trace_id, span_id, name, started_at, duration_ms, status): a trace is a user's day, each event a span."""
    day = F.date_format("ts", "yyyyMMdd")
    return events.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), day).alias("trace_id"), F.col("event_id").alias("span_id"), F.col("event_type").alias("name"),
        F.col("ts").alias("started_at"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
    )


def runs(rows: DataFrame) -> DataFrame:
    """One row a trace: spans, errors, first and last start, total duration (rounded to a microsecond), status."""
    return rows.groupBy("trace_id").agg(
        F.count("*").alias("spans"), F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).alias("errors"), F.min("started_at").alias("started_at"), F.max("started_at").alias("ended_at"),
        F.sum(F.round(F.col("duration_ms") * 1000).cast("long")).alias("duration_us"),
    ).withColumn("status", F.when(F.col("errors") > 0, "error").otherwise("ok"))


def stage_latency(rows: DataFrame) -> DataFrame:
    """(name, spans, min_ms, max_ms, total_us) by stage; sums are of whole microseconds, so they don't depend on order."""
    return rows.groupBy("name").agg(F.count("*").alias("spans"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), F.sum(F.round(F.col("duration_ms") * 1000).cast("long")).alias("total_us"))


def daily_volume(run: DataFrame) -> DataFrame:
    """(day, retrievals, average_ms, successful, incomplete) of runs: traces by day of their start; incomplete ones have one span only."""
    return run.groupBy(F.to_date("started_at").alias("day")).agg(
        F.count("*").alias("retrievals"), F.round(F.sum("duration_us") / F.count("*") / 1000, 1).alias("average_ms"),
        F.sum(F.when(F.col("status") == "ok", 1).otherwise(0)).alias("successful"), F.sum(F.when(F.col("spans") == 1, 1).otherwise(0)).alias("incomplete"),
    )


def stage_percentiles(rows: DataFrame) -> DataFrame:
    """(stage, calls, average_ms, p95_ms) of spans; durations count by the tenth of a millisecond, which bounds what the percentile keeps."""
    tenth = F.round("duration_ms", 1)
    return rows.groupBy(F.col("name").alias("stage")).agg(
        F.count("*").alias("calls"), F.round(F.sum(F.round(F.col("duration_ms") * 1000).cast("long")) / F.count("*") / 1000, 1).alias("average_ms"), F.round(F.percentile(tenth, 0.95), 1).alias("p95_ms")
    )


def outcome_matrix(run: DataFrame, *columns: str) -> DataFrame:
    """How many runs have each combination of the columns, for example mode, widened, fallback reason and failures."""
    return run.groupBy(*columns).agg(F.count("*").alias("retrievals"))


def envelope_violations(envelopes: DataFrame) -> DataFrame:
    """(trace_id, reason) of envelopes(trace_id, payload) that must not be stored: no id, no JSON object, over PAYLOAD_BYTES, no numeric or a negative duration."""
    body = F.try_parse_json("payload")
    good = F.startswith(F.trim("payload"), F.lit("{")) & body.isNotNull()
    duration = F.try_variant_get(body, "$.ms", "double")
    rules = [
        (F.coalesce(F.trim("trace_id"), F.lit("")) == "", "id missing"),
        (~F.coalesce(good, F.lit(False)), "no object"),
        (F.octet_length(F.coalesce("payload", F.lit(""))) > PAYLOAD_BYTES, "too large"),
        (F.coalesce(good, F.lit(False)) & F.coalesce(duration < 0, F.lit(False)), "negative duration"),
    ]
    return envelopes.select("trace_id", F.explode(F.array_compact(F.array(*[F.when(x, F.lit(why)) for x, why in rules]))).alias("reason"))


def graph_violations(rows: DataFrame) -> DataFrame:
    """(trace_id, reason) for spans(trace_id, span_id, parent_span_id, started_at, ended_at): roots other than one, missing parents, spans outside their parent."""
    roots = rows.groupBy("trace_id").agg(F.sum(F.when(F.col("parent_span_id").isNull(), 1).otherwise(0)).alias("roots")).where("roots <> 1").select("trace_id", F.lit("not one root").alias("reason"))
    parents = rows.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("started_at").alias("_from"), F.col("ended_at").alias("_to"))
    linked = rows.where("parent_span_id IS NOT NULL").join(parents, ["trace_id", "parent_span_id"], "left")
    outside = (F.col("started_at") < F.col("_from")) | (F.col("ended_at") > F.col("_to"))
    reason = F.when(F.col("_from").isNull(), "parent missing").when(outside, "outside its parent")
    return roots.unionByName(linked.select("trace_id", reason.alias("reason")).where("reason IS NOT NULL")).distinct()


def classify(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """batch(trace_id, payload) with content_hash and outcome: rejected (no JSON object), committed, replayed (stored with the same content) or conflict.

    Of copies inside one batch the smallest content is the one that counts; the others are replays or conflicts.
    """
    ok = F.col("trace_id").isNotNull() & F.coalesce(F.startswith(F.trim("payload"), F.lit("{")) & F.try_parse_json("payload").isNotNull(), F.lit(False))
    rows = batch.withColumn("content_hash", sha256(F.col("payload"))).withColumn("_ok", ok)
    first = rows.where("_ok").groupBy("trace_id").agg(F.min("content_hash").alias("_first"))
    known = stored.select("trace_id", F.col("content_hash").alias("_stored"))
    both = rows.join(first, "trace_id", "left").join(known, "trace_id", "left")
    reference = F.coalesce("_stored", "_first")
    outcome = F.when(~F.col("_ok"), "rejected").when(F.col("content_hash") != reference, "conflict").when(F.col("_stored").isNotNull(), "replayed").otherwise("committed")
    return both.select("trace_id", "payload", "content_hash", outcome.alias("outcome"))


def envelope_key() -> Column:
    """What an envelope's state is kept by: its trace id; an envelope that isn't stored has no state and is dealt out by its content."""
    return F.when(F.col("_ok"), F.concat(F.lit("trace:"), "trace_id")).otherwise(F.concat(F.lit("rejected:"), F.coalesce("content_hash", F.lit(""))))


def settle(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Outcomes of one key's envelopes in a batch; the state is the content hash that its trace was stored with.

    Copies are held by hash, the payload of the smallest hash alone.
    """
    if not key[0].startswith("trace:"):
        for part in parts:
            yield part[["trace_id", "content_hash"]].assign(outcome="rejected", payload=None)
        return
    known = state.get[0] if state.exists else None
    ids, least, payload = [], None, None
    for part in parts:
        ids.append(part[["trace_id", "content_hash"]])
        at = part["content_hash"].idxmin()
        if least is None or part.at[at, "content_hash"] < least:
            least, payload = part.at[at, "content_hash"], part.at[at, "payload"]
    reference = known or least
    if known is None:
        state.update((least,))
    new = known is None
    for part in ids:
        same = part["content_hash"] == reference
        out = part.assign(outcome=np.where(~same, "conflict", "committed" if new else "replayed"), payload=None)
        if payload is not None and same.any() and new:
            out.loc[same.idxmax(), "payload"] = payload  # the trace is stored once, with the first of its equal copies
            payload = None
        yield out


def ingest(spark: SparkSession, inbox: str, store: str, receipts: str, checkpoint: str, files_per_batch: int = 128) -> StreamingQuery:
    """Drain a folder of JSON envelopes into a store, once each; every envelope leaves a receipt.

    What a trace was stored with is keyed state (RocksDB in the checkpoint), so a batch looks up the ids that it has and
    never reads the store: its cost follows the batch.  It writes its traces and receipts under its own batch folder and overwrites them when it is replayed after a
    crash, with the state as it was before it, so either is there once however often a batch runs.  Outcomes are those of ``classify``.
    """
    ok = F.col("trace_id").isNotNull() & F.coalesce(F.startswith(F.trim("payload"), F.lit("{")) & F.try_parse_json("payload").isNotNull(), F.lit(False))
    stream = spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_batch).json(inbox)
    keyed = stream.withColumn("content_hash", sha256(F.col("payload"))).withColumn("_ok", ok).withColumn("key", envelope_key())
    settled = keyed.select("key", "trace_id", "payload", "content_hash").groupBy("key").applyInPandasWithState(settle, "trace_id string, content_hash string, outcome string, payload string", "content_hash string", "update", "NoTimeout")

    def write(batch: DataFrame, number: int) -> None:
        made = batch.persist()
        made.where("payload IS NOT NULL").select("trace_id", "payload", "content_hash").write.mode("overwrite").parquet(f"{store}/batch={number}")
        made.select("trace_id", "content_hash", "outcome").write.mode("overwrite").parquet(f"{receipts}/batch={number}")
        made.unpersist()

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return settled.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, name, spans, total_us) of a stream of spans with a watermark on started_at."""
    return stream.withWatermark("started_at", late).groupBy(F.window("started_at", width), "name").agg(F.count("*").alias("spans"), F.sum(F.round(F.col("duration_ms") * 1000).cast("long")).alias("total_us"))
