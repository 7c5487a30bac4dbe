"""Exact dedup (8): a cuckoo-filter index over live digests, sharded by digest.

Every text is normalised (A-Z lower-cased, null counts as empty) and hashed with SHA-256 where it is
read; only digests travel.  Each read task first combines its own equal digests, so a text that makes
up a third of the corpus reaches its shard as one row per task.  A shard streams its rows through a
``CuckooIndex``: a filter hit is verified against the full digests stored beside the fingerprints, a
full table doubles from the stored keys, and withdrawn digests are deleted.  The SHA-256 stands for the
content: two texts of one digest count as equal, which is not known ever to have happened.

Defined results: no rows give no rows; texts that are null, empty or repeated are ordinary rows
(null equals empty); rows that repeat an id with the same text are all ``kept`` in the report, and
``drop_duplicates`` keeps one of them; a null id is never preferred to another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.llm.tables import by_slice, cut, load

SLOTS = 4
MAX_KICKS = 200
KEYS_PER_SHARD = 400_000
COMBINE_ROWS = 100_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints whose slots also hold the stored key and its payload.

    >>> index = CuckooIndex(); index.put(b"k" * 32, 7, 1); index.get(b"k" * 32)
    [b'kkkkkkkkkkkkkkkkkkkkkkkkkkkkkkkk', 7, 1]
    """

    def __init__(self, buckets: int = 1024) -> None:
        self.mask, self.live, self.resizes = buckets - 1, 0, 0
        self.prints = [0] * (buckets * SLOTS)
        self.content: list[list | None] = [None] * (buckets * SLOTS)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[10:18], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & self.mask)

    def _slot(self, key: bytes) -> int:
        """The slot that holds exactly this key, or -1: fingerprints first, then the stored key."""
        mark, first, second = self._places(key)
        for bucket in (first, second):
            base = bucket * SLOTS
            for slot in range(base, base + SLOTS):
                if self.prints[slot] == mark and self.content[slot][0] == key:
                    return slot
        return -1

    def get(self, key: bytes) -> list | None:
        slot = self._slot(key)
        return self.content[slot] if slot >= 0 else None

    def put(self, key: bytes, doc: int | None, rows: int) -> None:
        """Insert a digest, or let the larger id take over its live entry and add its rows."""
        slot = self._slot(key)
        if slot >= 0:
            entry = self.content[slot]
            if entry[1] is None or (doc is not None and doc > entry[1]):
                entry[1] = doc
            entry[2] += rows
            return
        self._place([key, doc, rows])

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        self.prints[slot], self.content[slot] = 0, None
        self.live -= 1
        return True

    def _place(self, entry: list) -> None:
        mark, bucket, other = self._places(entry[0])
        for b in (bucket, other):
            base = b * SLOTS
            for slot in range(base, base + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.content[slot] = mark, entry
                    self.live += 1
                    return
        bucket = other
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.content[slot], entry = entry, self.content[slot]
            bucket = self._other(bucket, mark)
            base = bucket * SLOTS
            for free in range(base, base + SLOTS):
                if not self.prints[free]:
                    self.prints[free], self.content[free] = mark, entry
                    self.live += 1
                    return
        self._grow(entry)

    def _grow(self, homeless: list) -> None:
        """Double the table and place all stored keys again."""
        entries = [*self.entries(), homeless]
        self.__init__((self.mask + 1) * 2)
        self.resizes += 1
        for entry in entries:
            self._place(entry)

    def entries(self) -> Iterator[list]:
        return (e for e in self.content if e is not None)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row; digest is SHA-256 of the normalised text in UTF-8."""

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = part.column("text").cast(pa.large_binary())
        out = [hashlib.sha256((t.as_py() or b"").lower()).digest() for t in texts]  # bytes.lower() touches A-Z only
        yield pa.record_batch([part.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_slice(docs.select("doc_id", "text"), work, f"doc_id {kind}, digest binary")


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal digests of one task become one row, in runs of COMBINE_ROWS distinct digests."""
    held: dict[bytes, list] = {}
    for batch in batches:
        for doc, key, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "withdrawn")), strict=True):
            got = held.get((key, gone))
            if got is None:
                held[key, gone] = [doc, 1]
            else:
                got[0] = doc if got[0] is None or (doc is not None and doc > got[0]) else got[0]
                got[1] += 1
        if len(held) >= COMBINE_ROWS:
            yield _rows(held)
            held = {}
    if held:
        yield _rows(held)


def _rows(held: dict) -> pa.RecordBatch:
    keys, values = list(held), list(held.values())
    columns = [[k[0] for k in keys], [k[1] for k in keys], [v[0] for v in values], [v[1] for v in values]]
    kinds = [pa.binary(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "withdrawn", "doc_id", "rows"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: insert all rows, then delete what is withdrawn; what stays live is the result."""
    index, gone = CuckooIndex(), []
    for batch in batches:
        for key, withdrawn, doc, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if withdrawn:
                gone.append(key)
            else:
                index.put(key, doc, rows)
    for key in gone:
        index.delete(key)
    out = list(index.entries())
    for first in range(0, len(out), 20_000):
        part = out[first : first + 20_000]
        yield pa.record_batch([pa.array([e[i] for e in part], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.int64()))], names=["digest", "keep_id", "group_size"])


def live_digests(keys: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """(digest, keep_id, group_size) of the live digests of keys(doc_id long, digest), without the withdrawn ones."""
    events = keys.select(F.col("doc_id").cast("long").alias("doc_id"), "digest", F.lit(False).alias("withdrawn"))
    if withdrawn is not None:
        events = events.unionByName(withdrawn.select(F.lit(None).cast("long").alias("doc_id"), "digest", F.lit(True).alias("withdrawn")))
    combined = events.mapInArrow(_combined, "digest binary, withdrawn boolean, doc_id long, rows long")
    shards = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // KEYS_PER_SHARD))
    return combined.repartition(shards, "digest").mapInArrow(_indexed, "digest binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    withdrawn: documents (column text) whose texts are deleted from the index; documents with such a
    text get a null keep_id, group_size 0 and are not kept.
    """
    keys = cut(digests(docs))
    gone = digests(withdrawn.select(F.lit(0).cast("long").alias("doc_id"), "text")) if withdrawn is not None else None
    live = live_digests(keys, gone)
    # the digest table has one row a key, so a hot digest is a skewed left side that AQE splits
    return keys.join(live, "digest", "left").select(
        "doc_id",
        "keep_id",
        F.coalesce("group_size", F.lit(0)).alias("group_size"),
        F.coalesce(F.col("keep_id").eqNullSafe(F.col("doc_id")) & F.col("group_size").isNotNull(), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def digest_of(text: str) -> Column:
    """The digest of ``digests`` as an expression, in hex."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()).cast("binary"), 256)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text a row with a larger id repeats; all columns as they were.

    Rows that repeat both id and text (alike after lower-casing A-Z) are one document: one of them stays.  An id that stands for several texts
    keeps those of its rows that no larger id repeats.
    """
    kept = cut(exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")))
    once = kept.distinct()
    named = docs.withColumn("_sha", digest_of("text"))
    out = named.join(once, named["doc_id"].eqNullSafe(once["_kept_id"]) & (named["_sha"] == once["_kept_sha"]), "left_semi")
    return (out if kept.count() == once.count() else out.dropDuplicates(["doc_id", "_sha"])).drop("_sha")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
