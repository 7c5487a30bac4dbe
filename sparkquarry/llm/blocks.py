"""Texts as blocks of word numbers, and exact counts of a block's keys over the whole corpus.

A block holds whole texts of about BLOCK words as numbers into the block's own vocabulary of 64-bit word
hashes, the most frequent first: a byte or two a word once compressed.  ``global_counts`` asks for every distinct
key of every block (n-grams, seeds) how often all blocks have it: a block sends each key once to the
bucket of its leading bits, a bucket sums and answers in the order asked.  A key in a third of all texts
is so one entry a block and not one a text; no bucket holds texts, and buckets grow in number with the
corpus, not in size.  Keys travel with as many bits as keep a false meeting of any two unlikely (twice the
logarithm of their number, 48 at least, 64 at most).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm import textkit

BLOCK, TEXTS = 300_000, 100_000
BUCKET = 500_000
NTH = 17  # bits of a row number that count the texts of its block
_UNSIGNED = (np.uint8, np.uint16, np.uint32, np.uint64)


def pack(x: np.ndarray) -> bytes:
    """Non-negative whole numbers, byte planes compressed."""
    kind = next(k for k in _UNSIGNED if not len(x) or int(x.max()) <= np.iinfo(k).max)
    planes = np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, kind().itemsize).T).tobytes()
    return np.array([len(x), kind().itemsize], dtype=np.int64).tobytes() + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    n, width = np.frombuffer(packed[:16], dtype=np.int64).tolist()
    planes = pa.Codec("zstd").decompress(packed[16:], n * width, asbytes=True)
    kind = next(k for k in _UNSIGNED if k().itemsize == width)
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(width, n).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed).astype(np.uint64), dtype=np.uint64)


def text_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(block, ids, marks, sizes, vocabulary, numbers, sequence) of docs(id, mark, text); write it before use, that fixes the blocks.

    ids and marks as they come, sizes in words; words are lower-cased (A-Z).  A longer text is a block by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, sizes, hashes, words = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            flat = np.maximum(np.concatenate(hashes), np.uint64(1))
            vocabulary, sequence = np.unique(flat, return_inverse=True)
            listed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in map(pa.concat_arrays, (ids, marks))]
            order = np.argsort(-np.bincount(sequence, minlength=len(vocabulary)), kind="stable")
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.arange(len(order))
            columns = [*listed, textkit.ragged(np.concatenate(sizes), np.array([sum(map(len, sizes))]), pa.int64())]
            columns += [pa.array([x], pa.binary()) for x in (pack_sorted(vocabulary), pack(order), pack(number[sequence]))]
            return pa.record_batch(columns, names=["ids", "marks", "sizes", "vocabulary", "numbers", "sequence"])

        for batch in batches:
            for part in textkit.slices(batch):
                made = textkit.Words(part.column("text"))
                ids.append(part.column("id"))
                marks.append(part.column("mark"))
                sizes.append(made.n)
                hashes.append(made.hashes)
                words += len(hashes[-1])
                if words >= size or sum(map(len, ids)) >= TEXTS:
                    yield block()
                    ids, marks, sizes, hashes, words = [], [], [], [], 0
        if ids:
            yield block()

    kind = docs.schema["id"].dataType.simpleString()
    made = docs.select("id", F.col("mark").cast("boolean").alias("mark"), "text").mapInArrow(run, f"ids array<{kind}>, marks array<boolean>, sizes array<long>, vocabulary binary, numbers binary, sequence binary")
    return made.select(F.monotonically_increasing_id().alias("block"), "*")


class Block:
    """One row of text_blocks: word hashes by number, the numbers of all words, and where each text begins."""

    def __init__(self, batch: pa.RecordBatch, row: int) -> None:
        self.sizes = batch.column("sizes")[row].values.to_numpy().astype(np.int64)
        vocabulary, numbers, sequence = (batch.column(c)[row].as_py() for c in ("vocabulary", "numbers", "sequence"))
        self.vocabulary = unpack_sorted(vocabulary)[unpack(numbers)]
        self.sequence = unpack(sequence).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)


def row_number(block: int, nth: np.ndarray) -> np.ndarray:
    """One number for the nth text of a block: 2**16 blocks a partition and 2**NTH texts a block have their own."""
    return ((block >> 33) << 33 | (block & (2**33 - 1)) << NTH) + nth


def block_of(row: Column) -> Column:
    return F.shiftleft(F.shiftright(row, 33), 33) + F.shiftright(row.bitwiseAND(F.lit(2**33 - 1)), NTH)


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the leading 24 bits, so sorted keys lie in sorted buckets."""
    return ((keys >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)


def global_counts(blocks: DataFrame, keys_of: Callable[[pa.RecordBatch, int], list[tuple[np.ndarray, np.ndarray]]], size: int) -> DataFrame:
    """(block, kind, bucket, n, total, distinct): for the keys of each block, in order, how often all blocks have them.

    keys_of(batch, row): for each kind, sorted distinct 64-bit keys of the row and their counts in it (0: only asked for).
    total and distinct: the sum and the number of counted keys of the bucket, on one of its rows, 0 on the others.  size: about how many keys of a kind all blocks have.
    """
    buckets = max(1, -(-size // BUCKET))
    bits = min(64, max(48, 2 * size.bit_length()))
    mask = np.uint64((2**bits - 1) << (64 - bits))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name = batch.column("block")[row].as_py()
                for kind, (keys, counts) in enumerate(keys_of(batch, row)):
                    keys = keys & mask
                    of = _buckets(keys, buckets)
                    edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(keys) else np.zeros(1, int)
                    rows = [(int(of[a]), pack_sorted(keys[a:b]), pack(counts[a:b])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary()))]
                    yield pa.record_batch([pa.array([name] * len(rows), pa.int64()), pa.array([kind] * len(rows), pa.int32()), *columns], names=["block", "kind", "bucket", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        keys, counts = [unpack_sorted(x.as_py()) for x in table["keys"]], [unpack(x.as_py()) for x in table["counts"]]
        ends = np.cumsum([len(x) for x in keys])
        flat, own = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        new = np.concatenate(([True], flat[order][1:] != flat[order][:-1]))
        sums = np.add.reduceat(own[order], np.flatnonzero(new))
        found = np.empty(len(flat), dtype=np.int64)
        found[order] = sums[np.cumsum(new) - 1]
        told = [pack(x) for x in np.split(found, ends[:-1])]
        only = lambda x: pa.array([int(x)] + [0] * (len(told) - 1), pa.int64())
        return pa.table([table["block"], table["kind"], table["bucket"], pa.array(told, pa.binary()), only(sums.sum()), only((sums > 0).sum())], names=["block", "kind", "bucket", "n", "total", "distinct"])

    asked = blocks.mapInArrow(ask, "block long, kind int, bucket long, keys binary, counts binary")
    return asked.groupBy("kind", "bucket").applyInArrow(answer, "block long, kind int, bucket long, n binary, total long, distinct long")


def with_counts(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """blocks with ``answers``: the rows of global_counts that belong to each."""
    told = counts.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "n")).alias("answers"))
    return blocks.join(told.hint("merge"), "block", "left")  # one plan at every size


def counts_of(answers: pa.Scalar, kinds: int) -> list[np.ndarray]:
    """For each kind the counts of the block's keys in their order."""
    rows = sorted(((x["kind"], x["bucket"], x["n"]) for x in answers.as_py() or []), key=lambda r: r[:2])
    return [np.concatenate([np.zeros(0, np.int64), *(unpack(n).astype(np.int64) for kind, _, n in rows if kind == k)]) for k in range(kinds)]
