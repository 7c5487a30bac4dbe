"""Applying a plan: index, ledger and card change together, in one version of one store.

The three are tables of ``sources.store``, cut into buckets by the hash of their key.  An apply diffs the desired rows against
the ledger, rewrites the buckets of index and ledger that hold a changed row, puts the card beside them and commits:
readers see all of it or nothing, and buckets without a change keep their files.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkquarry.operators import manifest, routing, rows
from sparkquarry.sources import store

LEDGER = "row_id string, canonical_url string, page_hash string, embedding_text_hash string, plan_id string, status string"
BUCKETS = 256


class Applied:
    """What a version of the store holds."""

    def __init__(self, spark: SparkSession, root: str, number: int | None = None) -> None:
        self.spark, self.root, self.at = spark, root, store.version(spark, root, number)

    def _schema(self, table: str) -> T.StructType | str | None:
        return LEDGER if table == "ledger" else (made := self.at.notes.get(f"{table}_schema")) and T.StructType.fromJson(json.loads(made))

    def table(self, name: str, parts: list | None = None, schema: T.StructType | None = None) -> DataFrame:
        """index, ledger or cards; a table that isn't there yet is empty, with the schema given."""
        return store.read(self.spark, self.root, self.at, name, self._schema(name) or schema or T.StructType(), parts)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def _touched(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets of the keys, a bounded list."""
    return [r.bucket for r in keys.select(_bucket(key, buckets).alias("bucket")).distinct().collect()]


def _replaced(root: str, at: store.Version, table: str, new: DataFrame, key: str, touched: list[int], buckets: int) -> store.Version:
    """``at`` with the touched buckets of a table as new has them; those without rows are gone."""
    made = store.stage(new, root, _bucket(key, buckets), [key]) if touched else {}
    return at.changed(table, {str(b): [] for b in touched} | made)


def _with_card(now: Applied, at: store.Version, card: DataFrame, buckets: int) -> store.Version:
    """``at`` with one card(namespace, expected_revision, ...) created or updated; a Conflict if its revision isn't the expected one."""
    columns = [c for c in card.columns if c not in ("namespace", "expected_revision")]
    stored_schema = T.StructType([card.schema["namespace"], *[card.schema[c] for c in columns], T.StructField("card_revision", T.StringType())])
    known = now._schema("cards")
    if known and [(f.name, f.dataType) for f in known.fields] != [(f.name, f.dataType) for f in stored_schema.fields]:
        raise ValueError(f"the stored cards have the columns {known.simpleString()}")
    touched = _touched(card, "namespace", buckets)
    stored = now.table("cards", touched, stored_schema)
    after = routing.compare_and_set(stored, card, columns)
    lost = after.where("outcome = 'conflict'").select("namespace").limit(5).collect()
    if lost:
        raise store.Conflict(f"cards of another revision: {sorted(r.namespace for r in lost)}")
    new = routing.card_revision(after.select("namespace", *columns), [])
    made = _replaced(now.root, at, "cards", new.select(stored_schema.names), "namespace", touched, buckets)
    return made.noted(cards_schema=stored_schema.json())


def apply_plan(spark: SparkSession, root: str, wanted: DataFrame, chunks: DataFrame, plan_id: str, delete_stale: bool = False, card: DataFrame | None = None, buckets: int = BUCKETS, expected: int | None = None) -> DataFrame:
    """Put wanted(row_id, canonical_url, page_hash, embedding_text_hash) into effect; chunks(id, ...) are the index rows by row_id.

    Rows that are new or changed are put into the index, stale ones taken out if asked, the ledger follows, and card(namespace,
    expected_revision, ...), if given, is registered.  expected: the version that the plan was made from.  Another version, an apply in
    between, a card of another revision (Conflict) or a delta that the ledger contradicts (ValueError) changes nothing.
    Returns the one-row summary of the diff with the number of buckets rewritten and the new version.
    """
    now = Applied(spark, root)
    if expected is not None and expected != now.at.number:
        raise store.Conflict(f"version {now.at.number} is current, not {expected}")
    buckets = now.at.notes.get("buckets", buckets)
    index_schema, ledger = now._schema("index") or chunks.schema, now.table("ledger")
    if [(f.name, f.dataType) for f in index_schema.fields] != [(f.name, f.dataType) for f in chunks.schema.fields]:
        raise ValueError(f"the index has the columns {index_schema.simpleString()}")
    changes = manifest.diff(wanted, ledger)
    delta = rows.delta_rows(changes)
    broken = rows.delta_violations(delta, ledger).limit(5).collect()
    if broken:
        raise ValueError("; ".join(f"{r['row_id']}: {r['reason']}" for r in broken))
    summary = manifest.diff_summary(changes).first()

    put = chunks.join(delta.where("kind = 'upsert'").select(F.col("row_id").alias("id")), "id", "left_semi")
    gone = delta.where("kind = 'stale'" if delete_stale else "false").select(F.col("row_id").alias("id"))
    out_of_index = put.select("id").unionByName(gone).distinct()
    index_buckets = _touched(out_of_index, "id", buckets)
    new_index = now.table("index", index_buckets, index_schema).join(out_of_index, "id", "left_anti").unionByName(put)
    made = _replaced(root, now.at, "index", new_index.select(index_schema.names), "id", index_buckets, buckets)

    moved = delta.where("true" if delete_stale else "category <> 'retained_stale'").select("row_id").unionByName(ledger.where("status = 'deleted'").select("row_id"))
    ledger_buckets = _touched(moved, "row_id", buckets)
    here = _bucket("row_id", buckets).isin(ledger_buckets) if ledger_buckets else F.lit(False)
    new_ledger = manifest.next_ledger(wanted.where(here), now.table("ledger", ledger_buckets), plan_id, delete_stale=delete_stale)
    made = _replaced(root, made, "ledger", new_ledger, "row_id", ledger_buckets, buckets)
    if card is not None:
        made = _with_card(now, made, card, buckets)
    made = made.noted(buckets=buckets, index_schema=index_schema.json(), plan_id=plan_id)
    done = store.commit(spark, root, made)
    told = summary.asDict() | {"index_buckets": len(index_buckets), "ledger_buckets": len(ledger_buckets), "version": done.number}
    return spark.createDataFrame([tuple(told.values())], ", ".join(f"{c} long" for c in told))
