"""MinHash near-dedup (1): fast similarity sketching, banding, exact verification.

Sketch (Dahlgaard, Knudsen, Thorup): for ``t`` rounds every shingle is hashed into one of ``t`` bins
and the bin keeps its smallest (round, value); in ``t`` more rounds round ``t + i`` throws every shingle
into bin ``i``, so every coordinate fills.  A text leaves as soon as its bins are full: most texts need
one or two rounds.  25 bands of 5 coordinates miss a pair at similarity 0.85 with probability 4e-7.

Texts with the same shingle set (128-bit set hash and size) are one class from the start.  In a band
bucket all classes are compared with the bucket's smallest one, which settles most groups in as many
comparisons as they have members.  Where a bucket still holds several components, the pairs across
components are compared inside block pairs of bounded size: counts of common shingles are one matrix
product, a pair is looked at in its first common bucket only, and nothing but confirmed links leaves the
task, so no link is lost and no pair list is ever written.  Links are confirmed on full sets of 48-bit
shingle hashes.

Defined results: null or wordless texts have an empty set and stand alone; rows that repeat an id are
reported each and count as one document; a null id has component null and joins nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.llm import textkit
from sparkquarry.llm.components import components
from sparkquarry.llm.tables import by_slice, cut, load

BANDS, ROWS = 25, 5
BLOCK = 192
BROADCAST_IDS = 2_000_000


def sketch(values: np.ndarray, text: np.ndarray, texts: int, t: int = BANDS * ROWS) -> np.ndarray:
    """(texts, t) coordinates of the sets values[text == i]; a text without values keeps the largest value."""
    empty = np.uint64(2**64 - 1)
    out = np.full(texts * t, empty, dtype=np.uint64)
    for i in range(2 * t):
        if not len(values):
            break
        h = textkit.mix(values, 100 + i)
        place = (h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24) if i < t else np.uint64(i - t)
        cell = text * t + place.astype(np.int64)
        np.minimum.at(out, cell, (h & np.uint64(2**48 - 1)) | np.uint64(i << 48))
        open_ = (out.reshape(texts, t) == empty).any(axis=1)
        go_on = open_[text]
        values, text = values[go_on], text[go_on]
    return out.reshape(texts, t)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order of (text, hash), the text of each, and the set size of each text."""
    value, text = textkit.Words(texts).shingles(k)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, text, np.bincount(text, minlength=len(texts)).astype(np.int64)


def _sum_by_text(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
    last = np.cumsum(n)
    return (total[last] - total[last - n]).view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, the set hash h1, h2, and one key for each band (none for an empty set)."""

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        value, text, n = shingle_sets(part.column("text"), k)
        lines = sketch(value, text, part.num_rows)
        keys = np.empty((part.num_rows, BANDS), dtype=np.uint64)
        for band in range(BANDS):
            key = np.full(part.num_rows, band + 1, dtype=np.uint64)
            for row in range(ROWS):
                key = textkit.mix(key * np.uint64(0x9E3779B97F4A7C15) + lines[:, band * ROWS + row], 2)
            keys[:, band] = key
        some = n > 0
        bands = textkit.ragged(keys[some].ravel().view(np.int64), some * BANDS)
        sums = [_sum_by_text(textkit.mix(value, seed), n) for seed in (11, 12)]
        yield pa.record_batch([part.column("doc_id"), pa.array(n), *map(pa.array, sums), bands], names=["doc_id", "n_shingles", "h1", "h2", "bands"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return by_slice(ids, work, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, items): the full set as packed 48-bit hashes."""

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        value, _, n = shingle_sets(part.column("text"), k)
        packed = value.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
        last = np.cumsum(n) * 6
        items = [packed[b - m * 6 : b] for b, m in zip(last.tolist(), n.tolist(), strict=True)]
        yield pa.record_batch([part.column("node"), pa.array(items, pa.binary())], names=["node", "items"])

    return by_slice(docs, work, "node long, items binary")


def _unpacked(items: bytes) -> np.ndarray:
    out = np.zeros((len(items) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(items, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left = None, None
        for batch in batches:
            keep = []
            a, b = batch.column("items_a"), batch.column("items_b")
            for i in range(batch.num_rows):
                x, y = a[i].as_py(), b[i].as_py()
                if x != held:
                    held, left = x, _unpacked(x)
                right = _unpacked(y)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ids = cut(ids)
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(some, "node", "left_semi")
    sets = cut(_sets(texts, k))
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
    return cut(both.select("a", "b", "items_a", "items_b").mapInArrow(_confirmed(percent), "a long, b long"))


def _across(percent: int):
    """Links between the two blocks of each (key, low_block, high_block), rows in that order."""

    def links(key: int, first: list, second: list) -> list[tuple[int, int]]:
        (node_a, label_a, bands_a, items_a), (node_b, label_b, bands_b, items_b) = first, second
        size_a, size_b = (np.array([len(x) for x in items]) for items in (items_a, items_b))
        open_ = (label_a[:, None] != label_b[None, :]) & (100 * np.minimum(size_a[:, None], size_b) >= percent * np.maximum(size_a[:, None], size_b))
        same = bands_a[:, None, :] == bands_b[None, :, :]
        open_ &= np.take_along_axis(bands_a[:, None, :], same.argmax(axis=2)[:, :, None], axis=2)[:, :, 0] == key  # each pair in its first common bucket
        use_a, use_b = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if not len(use_a):
            return []
        flat_a, flat_b = (np.concatenate([items[i] for i in use]) for items, use in ((items_a, use_a), (items_b, use_b)))
        shared = np.intersect1d(flat_a, flat_b)
        both = np.zeros((len(use_a), len(use_b)), dtype=np.float32)
        for start in range(0, len(shared), 8192):
            part = shared[start : start + 8192]
            left, right = (np.zeros((len(use), len(part)), dtype=np.float32) for use in (use_a, use_b))
            for out, flat, sizes in ((left, flat_a, size_a[use_a]), (right, flat_b, size_b[use_b])):
                at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
                hit = part[at] == flat
                out[np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]] = 1
            both += left @ right.T
        both = both.astype(np.int64)
        linked = (100 * both >= percent * (size_a[use_a][:, None] + size_b[use_b][None, :] - both)) & open_[np.ix_(use_a, use_b)]
        return [(int(node_a[use_a[i]]), int(node_b[use_b[j]])) for i, j in zip(*np.nonzero(linked), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("node", "label", "bands", "items")

        def done(at: tuple, rows: list[tuple]) -> pa.RecordBatch:
            sides = []
            for side in ([True, False] if at[1] != at[2] else [True]):
                own = [r[1:] for r in rows if r[0] == side]
                sides.append([np.array([r[0] for r in own]), np.array([r[1] for r in own]), np.array([r[2] for r in own]).reshape(-1, BANDS), [_unpacked(r[3]) for r in own]])
            found = links(at[0], sides[0], sides[-1]) if all(len(x[0]) for x in sides) else []
            return pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        at, rows = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("key", "low_block", "high_block")), strict=True)
            for now, *row in zip(keys, *(batch.column(c).to_pylist() for c in ("is_low", *names)), strict=True):
                if now != at:
                    if rows:
                        yield done(at, rows)
                    at, rows = now, []
                rows.append(tuple(row))
        if rows:
            yield done(at, rows)

    return run


def _verify_blocks(docs: DataFrame, rest: DataFrame, bands: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between classes of different labels in the buckets of rest(key, node, label, low, salts, salt).

    A bucket's classes are dealt into blocks of about BLOCK: those of the label ``low``, the bulk of a
    large group, meet only blocks of the others.  Two blocks are one unit of work of bounded size, and
    only confirmed links leave it.  A bucket's rows are spread over one salt a block before they learn how
    many blocks there are; each full set then travels once for every block that its own one meets.
    """
    ids = cut(rest.select("node").distinct())
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = cut(_sets(docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(some, "node", "left_semi"), k))
    bulk = F.col("label") == F.col("low")
    blocks = rest.groupBy("key", "salts").agg(*(F.ceil(F.count(F.when(x, 1)) / BLOCK).cast("int").alias(n) for x, n in ((~bulk, "others"), (bulk, "bulks"))))
    blocks = blocks.select("key", "others", "bulks", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = rest.join(blocks, ["key", "salt"]).withColumn("draw", F.xxhash64("node", "key"))
    dealt = dealt.withColumn("block", F.when(bulk, F.col("others") + F.pmod("draw", F.col("bulks"))).otherwise(F.pmod("draw", F.col("others"))).cast("int"))
    meets = F.sequence(F.lit(0), F.when(bulk, F.col("others")).otherwise(F.col("others") + F.col("bulks")) - 1)
    dealt = dealt.select("key", "node", "label", "block", F.explode(meets).alias("other"))
    dealt = dealt.select("key", "node", "label", F.least("block", "other").alias("low_block"), F.greatest("block", "other").alias("high_block"), (F.col("block") <= F.col("other")).alias("is_low"))
    full = dealt.join(bands.join(sets, "node"), "node")
    full = full.repartition("key", "low_block", "high_block").sortWithinPartitions("key", "low_block", "high_block")
    full = full.select("key", "low_block", "high_block", "is_low", "node", "label", "bands", "items")
    return cut(full.mapInArrow(_across(percent), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Documents are linked where 100 * intersection >= percent * union of their sets of k-word shingles.
    """
    sign = cut(signatures(docs, k))
    named = sign.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    classes = cut(named)
    sizes = classes.select("node", "n_shingles")
    banded = classes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1").select("key", "lead")
    members = cut(banded.join(shared, "key"))
    pairs = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(sizes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}")), side)
    pairs = cut(pairs.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b"))
    edges = _verify(docs, pairs, k, percent)
    label = cut(components(edges))
    # every leader has met its whole bucket; what else lies in different components is compared block by block
    rest = members.where("node <> lead").select("key", "node").join(label, "node", "left")
    rest = rest.select("key", "node", F.coalesce("root", "node").alias("label"))
    split = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high")
    split = cut(split)  # written, so that the join has its own exchange, whose hot buckets AQE can split
    rest = rest.join(split.select("key", "low", F.ceil(F.col("n") / BLOCK).cast("int").alias("salts")), "key")
    rest = cut(rest.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")))
    if not rest.isEmpty():
        more = _verify_blocks(docs, rest, classes.select("node", "bands"), k, percent)
        label = cut(components(edges.unionByName(more)))
    ids = classes.select("n_shingles", "h1", "h2", "node")
    ids = ids.join(label, "node", "left").withColumn("node", F.coalesce("root", "node"))
    out = sign.select("doc_id", "n_shingles", "h1", "h2").join(ids.select("n_shingles", "h1", "h2", F.col("node").alias("found")), ["n_shingles", "h1", "h2"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates, all columns as they were."""
    kept = near_duplicates(docs, k, percent).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), k=3, percent=85)
