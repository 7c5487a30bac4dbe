"""Content-derived keys, the diff of a desired manifest against a ledger, and the next ledger.

Manifest rows: row_id, canonical_url, page_hash, embedding_text_hash (further columns pass through).
Ledger rows: row_id, canonical_url, page_hash, embedding_text_hash, status in STATUSES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions.text import sha256

STATUSES = ("active", "retained_stale", "deleted")


def row_id(site: Column, url: Column, section: Column, chunk_hash: Column, ordinal: Column | None = None) -> Column:
    """ts_ and 32 hex digits of SHA-256 over the newline-joined parts; an ordinal above 0 takes part."""
    parts = F.concat_ws("\n", site, url, section, chunk_hash)
    if ordinal is not None:
        parts = F.when(ordinal > 0, F.concat_ws("\n", parts, F.lit("duplicate"), ordinal.cast("string"))).otherwise(parts)
    return F.concat(F.lit("ts_"), F.substring(sha256(parts), 1, 32))


def embedding_hash(text: Column, precision: Column) -> Column:
    return sha256(F.when(precision == "float32", text).otherwise(F.concat(F.lit("embedding_precision="), precision, F.lit("\n"), text)))


def with_row_ids(chunks: DataFrame, site: str, order: list[str]) -> DataFrame:
    """chunks(canonical_url, section_path, chunk_hash, ...) with duplicate_ordinal and row_id; equal chunks of one URL and section are numbered in the given order."""
    same = Window.partitionBy("canonical_url", "section_path", "chunk_hash").orderBy(*order)
    chunks = chunks.withColumn("duplicate_ordinal", (F.row_number().over(same) - 1).cast("long"))
    return chunks.withColumn("row_id", row_id(F.lit(site), F.col("canonical_url"), F.col("section_path"), F.col("chunk_hash"), F.col("duplicate_ordinal")))


def duplicate_row_ids(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("row_id").agg(F.count("*").alias("copies")).where("copies > 1")


def diff(manifest: DataFrame, ledger: DataFrame) -> DataFrame:
    """(row_id, canonical_url, action, previous_status) of every row of either side.

    action: unchanged, changed, reactivate_retained_stale, new, stale or retained_stale.  An unknown row
    of a URL that has active rows is ``changed``, of another URL ``new``.  Deleted ledger rows count as absent.
    """
    state = ledger.where(F.col("status").isin("active", "retained_stale"))
    theirs = state.select("row_id", F.col("status").alias("previous_status"), F.col("embedding_text_hash").alias("_old"), F.col("canonical_url").alias("_old_url"))
    live = state.where("status = 'active'").select(F.col("canonical_url").alias("_live")).distinct()
    ours = manifest.select("row_id", "canonical_url", F.col("embedding_text_hash").alias("_new"), F.lit(True).alias("_wanted"))
    both = ours.join(theirs, "row_id", "full_outer").join(live, F.col("canonical_url") == F.col("_live"), "left")
    active, retained = F.col("previous_status") == "active", F.col("previous_status") == "retained_stale"
    action = (
        F.when(F.col("_wanted").isNull(), F.when(active, "stale").otherwise("retained_stale"))
        .when(active & (F.col("_old") == F.col("_new")), "unchanged")
        .when(active, "changed")
        .when(retained, "reactivate_retained_stale")
        .when(F.col("_live").isNotNull(), "changed")
        .otherwise("new")
    )
    return both.select("row_id", F.coalesce("canonical_url", "_old_url").alias("canonical_url"), action.alias("action"), "previous_status")


def diff_summary(changes: DataFrame) -> DataFrame:
    """One row of counts by action."""
    count = lambda *names: F.coalesce(F.sum(F.when(F.col("action").isin(*names), 1).otherwise(0)), F.lit(0)).cast("long")
    return changes.agg(
        count("unchanged").alias("chunks_unchanged"),
        count("new", "changed", "reactivate_retained_stale").alias("rows_to_upsert"),
        count("new").alias("rows_new"),
        count("changed").alias("rows_changed"),
        count("reactivate_retained_stale").alias("rows_reactivated"),
        count("stale").alias("stale_rows"),
        count("retained_stale").alias("retained_stale_rows"),
    )


def page_counts(pages: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: pages added, changed, unchanged, removed; a page is unchanged if its hash is among the active rows' hashes of its URL."""
    before = ledger.where("status = 'active'").select("canonical_url", "page_hash").distinct()
    before = before.groupBy("canonical_url").agg(F.collect_set("page_hash").alias("hashes"))  # a page has few hashes
    both = pages.select("canonical_url", "page_hash").distinct().join(before, "canonical_url", "full_outer")
    count = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).cast("long")
    ours, theirs = F.col("page_hash").isNotNull(), F.col("hashes").isNotNull()
    same = F.array_contains("hashes", F.col("page_hash"))
    return both.agg(
        count(ours & ~theirs).alias("pages_added"),
        count(ours & theirs & ~same).alias("pages_changed"),
        count(ours & theirs & same).alias("pages_unchanged"),
        count(~ours).alias("pages_removed"),
    )


def next_ledger(manifest: DataFrame, ledger: DataFrame, plan_id: str, delete_stale: bool = False) -> DataFrame:
    """The ledger after an apply: (row_id, canonical_url, page_hash, embedding_text_hash, plan_id, status).

    Upserted rows are active under plan_id, unchanged ones keep theirs, rows no longer wanted are retained as
    stale or, with delete_stale, leave; deleted rows leave.
    """
    old = ledger.where("status <> 'deleted'").select("row_id", *[F.col(c).alias(f"_{c}") for c in ("canonical_url", "page_hash", "embedding_text_hash", "plan_id", "status")])
    both = manifest.select("row_id", "canonical_url", "page_hash", "embedding_text_hash", F.lit(True).alias("_wanted")).join(old, "row_id", "full_outer")
    kept = (F.col("_status") == "active") & (F.col("_embedding_text_hash") == F.col("embedding_text_hash"))
    wanted = F.col("_wanted").isNotNull()
    pick = lambda c: F.when(wanted & ~F.coalesce(kept, F.lit(False)), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    out = both.select(
        "row_id", pick("canonical_url"), pick("page_hash"), pick("embedding_text_hash"),
        F.when(wanted & ~F.coalesce(kept, F.lit(False)), F.lit(plan_id)).otherwise(F.col("_plan_id")).alias("plan_id"),
        F.when(wanted, "active").otherwise("retained_stale").alias("status"),
    )
    return out.where("status = 'active'") if delete_stale else out


def ledger_violations(ledger: DataFrame) -> DataFrame:
    """(rule, rows) of each broken ledger rule: key present and unique, hashes of 64 hex digits, a known status."""
    rules = {
        "row_id missing": F.col("row_id").isNull() | (F.col("row_id") == ""),
        "page_hash malformed": ~F.coalesce(F.col("page_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "embedding_text_hash malformed": ~F.coalesce(F.col("embedding_text_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "status unknown": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
    }
    broken = ledger.select(F.explode(F.array_compact(F.array(*[F.when(x, F.lit(name)) for name, x in rules.items()]))).alias("rule"))
    repeated = ledger.groupBy("row_id").count().where("count > 1").select(F.lit("row_id repeated").alias("rule"))
    return broken.unionByName(repeated).groupBy("rule").agg(F.count("*").alias("rows"))


def table_hash(df: DataFrame, key: str) -> DataFrame:
    """One row (rows, content_hash): a hash of all rows that doesn't depend on their order or partitioning.

    Per-row SHA-256 values are summed in eight 32-bit lanes, so nothing is sorted or collected.
    """
    whole = sha256(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    lanes = [F.sum(F.conv(F.substring(whole, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(8)]
    summed = df.select(key, *[c for c in df.columns if c != key]).agg(F.count("*").alias("rows"), *lanes)
    return summed.select("rows", sha256(F.concat_ws(",", *[F.coalesce(F.col(f"l{i}").cast("string"), F.lit("0")) for i in range(8)])).alias("content_hash"))
