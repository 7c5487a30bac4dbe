"""A persisted inverted index and BM25 over it: a search reads the postings of its own terms only.

Documents lie in blocks of up to ``block_docs`` and about WORDS words, those of like length together.  A posting row is one term of
one field in one block: the keys, counts and lengths of its documents, and beside them how many they are, the largest count and the
smallest length, which bound what any of them can score.  Rows are dealt over buckets by the hash of the term; a
bucket is a part of a ``sources.store``, so adding documents writes new folders and one new version, and a
search opens the buckets of its terms.

A task cuts blocks from the documents it reads, some BYTES of text at a time, and makes their posting rows whole, so texts aren't
shuffled and a posting travels once, in the list that is stored, on its way to its bucket.

A search ranks blocks by their bounds, scores the best few of each query, and then only those others whose bound reaches the
k-th score found: the rows are those of ``retrieval.bm25_top_k`` over the same documents, whatever is skipped.  The lists that a
block has for the queries' terms meet in one task, which hands on the k best of each query.
Document frequencies are sums over posting rows, and document and word counts are notes of the version.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquarry.functions.text import lexical_tokens
from sparkquarry.operators.retrieval import B, FIELD_WEIGHTS, K1, QUERY_BLOCK, rank
from sparkquarry.sources import scratch, store

BUCKETS, BLOCK_DOCS, FIRST_BLOCKS = 256, 4096, 4
WORDS, BYTES, ROWS = 2**20, 2**24, 2**14
POSTINGS = "field int, term string, block long, n int, max_tf int, min_length int, postings array<struct<key:long,tf:int,length:int>>"
KEYS = "key long"
_IN_TERM = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", dtype=np.uint8))


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets))


def _terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many terms each of the lower-case texts has, and the terms one after the other."""
    if not len(texts):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets - offsets[0]
    inside = _IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = ends[:-1][ends[:-1] < len(data)]
    begins[firsts] = inside[firsts]  # no term goes on into the next text
    at = np.flatnonzero(begins)
    places = np.append(np.cumsum(inside, dtype=np.int32)[at] - 1, inside.sum()).astype(np.int32)
    return np.diff(np.searchsorted(at, ends)), pa.StringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(data[inside]))


def _blocks(words: np.ndarray, block_docs: int) -> np.ndarray:
    """The number of each document's block: the shortest documents first, up to block_docs of them and, but for a single longer one, WORDS words."""
    order, out = np.argsort(words, kind="stable"), np.zeros(len(words), dtype=np.int64)
    begin, block, total = 0, 0, np.concatenate(([0], np.cumsum(words[order])))
    while begin < len(order):
        end = min(begin + block_docs, max(begin + 1, int(np.searchsorted(total, total[begin] + WORDS, side="right")) - 1))
        out[order[begin:end]] = block
        begin, block = end, block + 1
    return out


def _posting_rows(batch: pa.RecordBatch, fields: int, first: int, block_docs: int) -> tuple[list[pa.RecordBatch], int]:
    """POSTINGS rows of a batch (key, a lower-case text for each field), whose blocks are numbered from first, and how many blocks they are."""
    batch = batch.take(pc.sort_indices(batch.column(0)))  # lists are in order of their keys
    keys, read = batch.column(0).to_numpy(), [_terms(batch.column(1 + f)) for f in range(fields)]
    block, out = _blocks(sum(n for n, _ in read), block_docs), []
    for field, (length, terms) in enumerate(read):
        if not len(terms):
            continue
        coded = terms.dictionary_encode()
        doc = np.repeat(np.arange(len(keys)), length)
        doc_bits = len(keys).bit_length()
        code_bits = len(coded.dictionary).bit_length()
        each = np.sort(block[doc] << (code_bits + doc_bits) | coded.indices.to_numpy().astype(np.int64) << doc_bits | doc)
        begins = np.flatnonzero(np.concatenate(([True], each[1:] != each[:-1])))
        tf, each = np.diff(np.append(begins, len(each))).astype(np.int32), each[begins]
        own, doc = each >> doc_bits, each & ((1 << doc_bits) - 1)
        lengths = length[doc].astype(np.int32)
        begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ends = np.append(begins[1:], len(own))
        one = pa.StructArray.from_arrays([pa.array(keys[doc]), pa.array(tf), pa.array(lengths)], names=["key", "tf", "length"])
        columns = [
            pa.array(np.full(len(begins), field, dtype=np.int32)), coded.dictionary.take(pa.array(own[begins] & ((1 << code_bits) - 1))), pa.array(first + (own[begins] >> code_bits)),
            pa.array((ends - begins).astype(np.int32)), pa.array(np.maximum.reduceat(tf, begins)), pa.array(np.minimum.reduceat(lengths, begins)),
            pa.ListArray.from_arrays(pa.array(np.append(begins, len(own)).astype(np.int32)), one),
        ]
        made = pa.record_batch(columns, names=["field", "term", "block", "n", "max_tf", "min_length", "postings"])
        out += [made.slice(i, ROWS) for i in range(0, made.num_rows, ROWS)]
    return out, int(block.max()) + 1


def postings(docs: DataFrame, fields: list[str], segment: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """POSTINGS rows of docs(key, *fields); block numbers begin with the segment's, then the partition's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, block = [], 0, segment << 40 | TaskContext.get().partitionId() << 20
        for batch in batches:
            texts = sum(pc.binary_length(batch.column(1 + f)).to_numpy().astype(np.int64) for f in range(len(fields)))
            part = np.cumsum(texts) // BYTES
            for one in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(part)) + 1):
                waiting.append(batch.slice(int(one[0]), len(one)) if len(one) else batch)
                size += int(texts[one].sum())
                if size >= BYTES:
                    rows, made = _posting_rows(_one(waiting), len(fields), block, block_docs)
                    yield from rows
                    waiting, size, block = [], 0, block + made
        if sum(b.num_rows for b in waiting):
            yield from _posting_rows(_one(waiting), len(fields), block, block_docs)[0]

    lower = [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"f{i}") for i, f in enumerate(fields)]
    return docs.select("key", *lower).mapInArrow(run, POSTINGS)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def add_documents(spark: SparkSession, root: str, docs: DataFrame, fields: list[str], key: str = "doc_id", buckets: int = BUCKETS, block_docs: int = BLOCK_DOCS) -> store.Version:
    """Index docs(key, *fields) into the index at root, a new one or one of the same fields, as a new version.

    Rows without a key are left out; a key that comes twice, or that the index has, is a ValueError and changes nothing.
    """
    at = store.version(spark, root)
    known = at.notes or {"fields": fields, "buckets": buckets, "documents": 0, "words": [0] * len(fields), "segments": 0}
    if known["fields"] != fields:
        raise ValueError(f"the index has the fields {known['fields']}")
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), *fields)
    keys = own.select("key")
    twice = keys.unionByName(store.read(spark, root, at, "keys", KEYS)).groupBy("key").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"keys that are there already or repeat: {sorted(r.key for r in twice)}")
    made = store.stage(postings(own, fields, known["segments"], block_docs), root, _bucket("term", known["buckets"]), ["field", "term", "block"])
    listed = store.stage(keys, root, _bucket("key", known["buckets"]))
    new = at.changed("postings", made, add=True).changed("keys", listed, add=True)
    added = store.read(spark, root, store.Version(tables={"postings": made}), "postings", POSTINGS).select("field", F.aggregate("postings.tf", F.lit(0).cast("long"), lambda a, x: a + x).alias("words"))
    sums = {r.field: r.words for r in added.groupBy("field").agg(F.sum("words").alias("words")).collect()}
    words = [a + sums.get(i, 0) for i, a in enumerate(known["words"])]
    return store.commit(spark, root, new.noted(**known | {"documents": known["documents"] + keys.count(), "words": words, "segments": known["segments"] + 1}))


def merged_segments(spark: SparkSession, root: str) -> store.Version:
    """A new version in which every bucket is one folder; the rows are the same."""
    at = store.version(spark, root)
    stored = store.read(spark, root, at, "postings", POSTINGS)
    gone = dict.fromkeys(at.tables.get("postings", {}), [])
    made = store.stage(stored, root, _bucket("term", at.notes["buckets"]), ["field", "term", "block"])
    return store.commit(spark, root, at.changed("postings", gone | made))


class Reader:
    """One version of an index: its notes, and the postings of given terms."""

    def __init__(self, spark: SparkSession, root: str, number: int | None = None) -> None:
        self.spark, self.root, self.at = spark, root, store.version(spark, root, number)
        self.notes = self.at.notes

    def of(self, terms: DataFrame) -> DataFrame:
        """POSTINGS of terms(term), from their buckets; the terms are those of one block of queries and are broadcast."""
        buckets = [r.bucket for r in terms.select(_bucket("term", self.notes["buckets"]).alias("bucket")).distinct().collect()]
        return store.read(self.spark, self.root, self.at, "postings", POSTINGS, buckets).join(F.broadcast(terms.distinct()), "term", "left_semi")


def _impact(tf: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def bm25_search(reader: Reader, queries: DataFrame, k: int, key: str = "doc_id", weights: list[float] | None = None, k1: float = K1, b: float = B, digits: int = 6, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """(query_id, key, score, rank) as ``retrieval.bm25_top_k`` gives it for queries(query_id, query); queries go in blocks of QUERY_BLOCK."""
    schema = f"query_id long, {key} long, score double"
    if not reader.notes or not reader.notes["documents"]:
        return rank(reader.spark.createDataFrame([], schema), key, k, digits)
    asked = queries.select("query_id", F.explode(lexical_tokens(F.coalesce("query", F.lit("")))).alias("term"))
    blocks, out = max(1, -(-queries.count() // QUERY_BLOCK)), None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        part = _block_search(reader, own, k, weights or [FIELD_WEIGHTS.get(f, 1.0) for f in reader.notes["fields"]], k1, b, digits, first_blocks)
        out = part if out is None else out.unionByName(part)
    return rank(out.select("query_id", F.col("key").alias(key), "score"), key, k, digits)


def term_weights(stored: DataFrame, notes: dict, weights: list[float]) -> DataFrame:
    """(field, term, idf, mean, weight) of the terms whose postings are given."""
    per_field = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("field") + 1)
    means = [max(w / notes["documents"], 1e-300) for w in notes["words"]]
    known = stored.select("field", "term", "n").groupBy("field", "term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.lit(float(notes["documents"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return known.select("field", "term", idf.alias("idf"), per_field(means).alias("mean"), per_field(weights).alias("weight"))


def bounds(stored: DataFrame, asked: DataFrame, known: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, block, bound) of asked(query_id, term): no document of the block scores more.  Reads no posting list."""
    small = stored.select("field", "term", "block", "max_tf", "min_length").join(F.broadcast(known), ["field", "term"])
    most = small.withColumn("most", F.col("weight") * F.col("idf") * _impact(F.col("max_tf"), F.col("min_length"), F.col("mean"), k1, b))
    return most.groupBy("term", "block").agg(F.sum("most").alias("most")).join(F.broadcast(asked), "term").groupBy("query_id", "block").agg(F.sum("most").alias("bound"))


def scored(stored: DataFrame, asked: DataFrame, known: DataFrame, chosen: DataFrame, k1: float = K1, b: float = B, k: int | None = None, digits: int = 6) -> DataFrame:
    """(query_id, key, score) of the documents in the chosen(query_id, block) that have a term of the query; with k, the k best of each query in each block, by rounded score, then key."""
    weights = {(r.field, r.term): (r.weight * r.idf, r.mean) for r in known.collect()}  # of one block of queries, like what follows
    askers: dict[str, set[int]] = {}
    for r in asked.collect():
        askers.setdefault(r.term, set()).add(r.query_id)
    shared = stored.sparkSession.sparkContext.broadcast((weights, {t: np.array(sorted(q), dtype=np.int64) for t, q in askers.items()}))

    def score(lists: pa.Table, own: pa.Table) -> pa.Table:
        weights, askers = shared.value
        ids = np.unique(own["query_id"].to_numpy())
        if not lists.num_rows or not len(ids):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "key", "score"])
        terms, one = lists["term"].to_pylist(), pa.concat_arrays([c.flatten() for c in lists["postings"].chunks])
        key, tf, length = (one.field(c).to_numpy() for c in ("key", "tf", "length"))
        n = lists["n"].to_numpy()
        weight, mean = np.array([weights[x] for x in zip(lists["field"].to_pylist(), terms, strict=True)]).T.repeat(n, axis=1)
        part = weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        keys, doc = np.unique(key, return_inverse=True)
        total, ends = np.zeros((len(ids), len(keys))), np.concatenate(([0], np.cumsum(n)))
        for term, begin, end in zip(terms, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            at = np.searchsorted(ids, askers[term])
            at = at[ids[np.minimum(at, len(ids) - 1)] == askers[term]]
            total[at[:, None], doc[begin:end]] += part[begin:end]  # a document is once in a list
        if k is None or len(keys) <= k:
            at, of = np.nonzero(total)
        else:
            of = np.argsort(-np.round(total, digits), axis=1, kind="stable")[:, :k]  # keys are in order
            at, of = np.repeat(np.arange(len(ids)), k), of.ravel()
            at, of = at[total[at, of] > 0], of[total[at, of] > 0]
        return pa.table([pa.array(ids[at]), pa.array(keys[of]), pa.array(total[at, of])], names=["query_id", "key", "score"])

    lists = stored.select("field", "term", "block", "n", "postings").join(F.broadcast(chosen.select("block").distinct()), "block", "left_semi")
    own = chosen.select(F.col("block").alias("of"), F.col("query_id").cast("long").alias("query_id"))
    return lists.groupBy("block").cogroup(own.groupBy("of")).applyInArrow(score, "query_id long, key long, score double")


def first_and_others(bound: DataFrame, score: Callable[[DataFrame], DataFrame], k: int, digits: int, first_blocks: int) -> tuple[DataFrame, DataFrame]:
    """The k best of each query in its ``first_blocks`` blocks of highest bound, and the other blocks that could still hold one of its k best."""
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    nth = bound.withColumn("nth", F.row_number().over(order))
    found = score(nth.where(F.col("nth") <= first_blocks).select("query_id", "block"))
    found = scratch.written(found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), "key"))).where(F.col("nth") <= k))
    reached = found.groupBy("query_id").agg(F.min(F.when(F.col("nth") == k, F.col("score"))).alias("least"))
    others = nth.where(F.col("nth") > first_blocks).join(reached, "query_id", "left")
    # a bound within rounding of the k-th score may still tie with it
    others = others.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 2 * 10.0**-digits))
    return found.select("query_id", "key", "score"), others.select("query_id", "block")


def _block_search(reader: Reader, asked: DataFrame, k: int, weights: list[float], k1: float, b: float, digits: int, first_blocks: int) -> DataFrame:
    stored = reader.of(asked.select("term"))
    known = scratch.written(term_weights(stored, reader.notes, weights))
    score = lambda chosen: scored(stored, asked, known, chosen, k1, b, k, digits)
    found, others = first_and_others(scratch.written(bounds(stored, asked, known, k1, b)), score, k, digits, first_blocks)
    return found.unionByName(score(others)).where(F.round("score", digits) > 0)
