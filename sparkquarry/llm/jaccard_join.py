"""N-gram Jaccard join (12): blocked sparse products of the document by n-gram incidence matrix.

Documents with the same set of word n-grams (128-bit set hash and size) are one row of the matrix, a class.  Two
sets of x and y n-grams reach the similarity only with an overlap of at least ``least_overlap(x, y)``; so with
the n-grams of all sets in one order they share one of their first ``prefix(x)`` and ``prefix(y)``.  Only these columns of a row
are multiplied: a column that one class has alone is dropped, the classes of the others are candidates.

Order: rare n-grams first, so that columns are short.  The frequencies come from a sketch of ``CELLS`` counters over every
n-gram of every text, summed as a tree, of one size for any corpus; where n-grams share a counter the order is another one, and the
result the same.

Overlaps accumulate in two products.  That of the prefixes counts what two sets share up to where the shorter prefix ends; with
what lies behind it this bounds the overlap, and pairs under ``least_overlap`` are discarded.  Only classes with a pair left
send their full row, and the product of full rows gives the links.

Every column first meets its smallest class: the members of a leader are dealt into blocks of ``BLOCK``, the leader's row goes out
once for each.  This settles groups of near copies in about as many overlaps as they have members.  What of a
column still lies in different components is one unit of work, or, beyond ``BLOCK`` classes, is cut by size and into blocks, and two
blocks are a unit unless their sizes rule one another out; a pair belongs to the first column that its prefixes share.
Nothing but confirmed links leaves the products; no list of pairs is written.

Defined results: null or wordless texts have an empty set, stand alone and link with nothing; rows that repeat an
id are documents of their own; a null id has component null and joins nothing; no rows give no rows.
Sets are compared by 48-bit hashes of their n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.llm import textkit
from sparkquarry.llm.blocks import pack, unpack
from sparkquarry.llm.components import components
from sparkquarry.llm.tables import cut, load

CELLS, SEGMENTS, FAN_IN = 2**21, 16, 32
BLOCK = 192
COLUMNS, BATCH, ROWS, TEXTS = 8192, 4096, 1000, 60_000
BROADCAST_IDS = 2_000_000


def prefix(size, percent: int):
    """How many of a set's n-grams, in the common order, a similar set must share one of."""
    return size - (percent * size + 99) // 100 + 1


def least_overlap(x, y, percent: int):
    """The overlap from which on sets of x and y n-grams reach the similarity."""
    return -(-percent * (x + y) // (100 + percent))


def _as_bytes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _as_hashes(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of bounded text size and number."""
    for batch in batches:
        for part in textkit.slices(batch):
            for first in range(0, part.num_rows, TEXTS):
                yield part.slice(first, TEXTS)


def gram_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 64-bit n-gram hashes in order of (text, leading 48 bits), the text of each, and the set size of each text; at most TEXTS texts."""
    value, text = textkit.Words(texts).shingles(k)
    order = np.argsort((text.astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16)))
    value, text = value[order], text[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, text, np.bincount(text, minlength=len(texts)).astype(np.int64)


def _cell(values: np.ndarray) -> np.ndarray:
    return (textkit.mix(values, 21) & np.uint64(CELLS - 1)).astype(np.int64)


def _set_sums(value: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each set: sums of mixed members."""
    last, out = np.cumsum(n), []
    for seed in (11, 12):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(textkit.mix(value, seed), dtype=np.uint64)))
        out.append((total[last] - total[last - n]).view(np.int64))
    return out


def described(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2) of every row, and at the end of each task SEGMENTS rows (part, segment, counts) of its n-gram counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part = np.zeros(CELLS, dtype=np.int32), TaskContext.get().partitionId()
        for piece in _pieces(batches):
            value, _, n = gram_sets(piece.column("text"), k)
            cells, n_of = np.unique(_cell(value), return_counts=True)
            counts[cells] += n_of.astype(np.int32)
            yield pa.record_batch([piece.column("doc_id"), pa.array(n), *map(pa.array, _set_sums(value, n)), *(pa.nulls(len(n), t) for t in (pa.int64(), pa.int32(), pa.binary()))], names=names)
        pieces = [pack(x) for x in np.split(counts, SEGMENTS)] if counts.any() else []
        m = len(pieces)
        yield pa.record_batch([*(pa.nulls(m, pa.int64()) for _ in range(4)), pa.array([part] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array(pieces, pa.binary())], names=names)

    names = ["doc_id", "n_shingles", "h1", "h2", "part", "segment", "counts"]
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, part long, segment int, counts binary")


def frequency_ranks(counters: DataFrame, parts: int) -> np.ndarray:
    """For each cell a rank that grows with its count: counters(part, segment, counts) summed FAN_IN parts at a time, then SEGMENTS rows are read."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack(x.as_py()).astype(np.int64) for x in table["counts"])
        return pa.table([pa.array([table["above"][0].as_py()], pa.int64()), table["segment"].slice(0, 1), pa.array([pack(total)], pa.binary())], names=["part", "segment", "counts"])

    while parts > 1:
        above = counters.withColumn("above", F.floor(F.col("part") / FAN_IN))
        counters = cut(above.groupBy("segment", "above").applyInArrow(add, "part long, segment int, counts binary"))
        parts = -(-parts // FAN_IN)
    found = np.zeros(CELLS, dtype=np.int64)
    for row in counters.collect():
        found[row.segment * (CELLS // SEGMENTS) :][: CELLS // SEGMENTS] = unpack(row.counts)
    return np.round(np.log2(1 + found) * 1024).astype(np.uint16)


def prefixes(docs: DataFrame, ranks: np.ndarray, k: int, percent: int) -> DataFrame:
    """(doc_id, n, h1, h2, head): the prefix in the common order, packed numbers of rank and 48-bit hash; only of sets that aren't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            value, text, n = gram_sets(part.column("text"), k)
            sums = _set_sums(value, n)
            gram = ranks[_cell(value)].astype(np.uint64) << np.uint64(48) | value >> np.uint64(16)
            order = np.argsort(gram)
            order = order[np.argsort(text[order].astype(np.uint16), kind="stable")]
            last, size = np.cumsum(n), np.where(n > 0, prefix(n, percent), 0)
            ordered = gram[order][np.arange(len(value)) - (last - n)[text] < size[text]].tobytes()
            ends = np.cumsum(size) * 8
            heads = [ordered[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.record_batch([part.column("doc_id"), pa.array(n.astype(np.int32)), *map(pa.array, sums), pa.array(heads, pa.binary())], names=["doc_id", "n", "h1", "h2", "head"]).filter(pa.array(n > 0))

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(run, "doc_id long, n int, h1 long, h2 long, head binary")


def _of(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of some ids, without a shuffle of the others while the ids are few."""
    some = cut(ids.select(key).distinct())
    return rows.join(F.broadcast(some) if some.count() <= BROADCAST_IDS else some, key, "left_semi")


def full_rows(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(class, items): the full sets of wanted(class, doc_id, n, h1, h2), packed in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            value, _, n = gram_sets(part.column("text"), k)
            packed, last = _as_bytes(value >> np.uint64(16)), np.cumsum(n) * 6
            items = [packed[b - m * 6 : b] for b, m in zip(last.tolist(), n.tolist(), strict=True)]
            yield pa.record_batch([part.column("doc_id"), pa.array(n.astype(np.int32)), *map(pa.array, _set_sums(value, n)), pa.array(items, pa.binary())], names=["doc_id", "n", "h1", "h2", "items"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = _of(ids, wanted.select("doc_id"), "doc_id").mapInArrow(run, "doc_id long, n int, h1 long, h2 long, items binary")
    return made.join(wanted.hint("merge"), ["doc_id", "n", "h1", "h2"]).select("class", "items")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of every left set with every right one: the product of their incidence over the columns that both sides have."""
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    shared, out = np.intersect1d(flat_l, flat_r), np.zeros((len(left), len(right)), dtype=np.float32)
    for start in range(0, len(shared), COLUMNS):
        part, sides = shared[start : start + COLUMNS], []
        for sets, flat in ((left, flat_l), (right, flat_r)):
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            sides.append(np.zeros((len(sets), len(part)), dtype=np.float32))
            sides[-1][np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit], at[hit]] = 1
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _by_unit(columns: list[str], unit: int, names: list[str], work: Callable):
    """mapInArrow over rows sorted by their first ``unit`` columns: work(unit, rows) gives the rows of longs of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, found = None, [], []

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in range(len(names))], names=names)

        for batch in (b.slice(first, ROWS) for b in batches for first in range(0, b.num_rows, ROWS)):
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if row[:unit] != at:
                    if len(rows) > 1:
                        found += work(at, rows)
                    if len(found) >= BATCH:
                        yield out()
                        found = []
                    at, rows = row[:unit], []
                rows.append(row[unit:])
        if len(rows) > 1:
            found += work(at, rows)
        yield out()

    return run


def within_reach(heads_a: list[np.ndarray], n_a: np.ndarray, heads_b: list[np.ndarray], n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets can overlap enough: what their prefixes share, and at most the smaller rest behind the end of the shorter one."""
    last_a, last_b = (np.array([h[-1] for h in heads]) for heads in (heads_a, heads_b))
    seen_a = np.array([np.searchsorted(h, last_b, side="right") for h in heads_a])
    seen_b = np.array([np.searchsorted(h, last_a, side="right") for h in heads_b]).T
    most = overlaps(heads_a, heads_b) + np.minimum(n_a[:, None] - seen_a, n_b[None] - seen_b)
    return most >= least_overlap(n_a[:, None], n_b[None], percent)


def _leader_and_members(rows: list[tuple], read: Callable) -> tuple | None:
    """The leader's and the members' (class, n, read(row)) of rows (side, class, n, packed)."""
    sides = [[(c, n, read(x)) for side, c, n, x in rows if side == s] for s in (0, 1)]
    return (sides[0][0], sides[1]) if all(sides) else None


def _heads(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.uint64)


def _led_near(percent: int) -> Callable:
    """Of a leader and the members of one block, which prefixes don't rule out."""

    def work(_, rows: list[tuple]) -> list[tuple[int, int]]:
        if not (found := _leader_and_members(rows, _heads)):
            return []
        (lead, n, head), members = found
        near = within_reach([head], np.array([n]), [h for _, _, h in members], np.array([m for _, m, _ in members]), percent)[0]
        return [(lead, c) for (c, _, _), ok in zip(members, near.tolist(), strict=True) if ok]

    return work


def _led_links(percent: int) -> Callable:
    """Links of a leader with the members of one block, from full rows."""

    def work(_, rows: list[tuple]) -> list[tuple[int, int]]:
        if not (found := _leader_and_members(rows, _as_hashes)):
            return []
        (lead, n, own), members = found
        both = overlaps([own], [x for _, _, x in members])[0]
        return [(lead, c) for (c, m, _), shared in zip(members, both.tolist(), strict=True) if shared >= least_overlap(n, m, percent)]

    return work


def _led(pairs: DataFrame, rows: DataFrame, packed: str, work: Callable) -> DataFrame:
    """(a, b) that work gives of pairs(a, b) over rows(class, n, packed): the members b of a leader a in blocks of about BLOCK, its row sent once for each."""
    many = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"))
    dealt = pairs.join(many, "a", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("b"), "blocks"), F.lit(0)))
    dealt = cut(dealt.select("a", "block", "b"))
    sides = [dealt.select("a", "block", F.lit(1).alias("side"), F.col("b").alias("class")), dealt.select("a", "block").distinct().select("a", "block", F.lit(0).alias("side"), F.col("a").alias("class"))]
    names = ["a", "block", "side", "class", "n", packed]
    both = sides[0].unionByName(sides[1])
    both = both.join(_of(rows, both, "class").hint("merge"), "class").select(names)  # one plan at every size
    both = both.repartition("a", "block").sortWithinPartitions("a", "block")
    return cut(both.mapInArrow(_by_unit(names, 2, ["a", "b"], work), "a long, b long"))


def _open(rows_a: list, rows_b: list, percent: int) -> np.ndarray:
    """Which pairs of (class, label, n, ...) lie in different components and have sizes that can reach the similarity."""
    (label_a, n_a), (label_b, n_b) = (tuple(np.array([r[i] for r in rows]) for i in (1, 2)) for rows in (rows_a, rows_b))
    return (label_a[:, None] != label_b[None]) & (100 * np.minimum(n_a[:, None], n_b[None]) >= percent * np.maximum(n_a[:, None], n_b[None]))


def _sides(at: tuple, rows: list[tuple]) -> tuple[list, list]:
    """Rows (is_low, ...) of the unit (key, low, high) as its two blocks; a block that meets itself is both."""
    low = [r[1:] for r in rows if r[0]]
    return low, low if at[1] == at[2] else [r[1:] for r in rows if not r[0]]


def _left(at: tuple, sides: tuple[list, list], pairs: np.ndarray) -> list[tuple]:
    """(key, low, high, class) of the classes that have a pair left."""
    found = {side[i][0] for side, axis in zip(sides, (1, 0), strict=True) for i in np.flatnonzero(pairs.any(axis=axis)).tolist()}
    return [(*at, c) for c in sorted(found)]


def _by_place(percent: int) -> Callable:
    """Classes with a pair left by component, size and the place of the column, the first that the pair shares; rows (is_low, class, label, n, place)."""

    def work(at: tuple, rows: list[tuple]) -> list[tuple]:
        sides = _sides(at, rows)
        if not all(sides):
            return []
        pairs = _open(*sides, percent)
        if pairs.any():
            n_a, n_b, rest_a, rest_b = (np.array(x) for x in ([r[2] for r in sides[0]], [r[2] for r in sides[1]], [r[2] - r[3] for r in sides[0]], [r[2] - r[3] for r in sides[1]]))
            pairs &= np.minimum(rest_a[:, None], rest_b[None]) >= least_overlap(n_a[:, None], n_b[None], percent)
        return _left(at, sides, pairs)

    return work


def _by_prefix(percent: int) -> Callable:
    """Classes with a pair left by the product of the prefixes; rows (is_low, class, label, n, head)."""

    def work(at: tuple, rows: list[tuple]) -> list[tuple]:
        sides = _sides(at, rows)
        if not all(sides):
            return []
        heads = [[_heads(r[3]) for r in side] for side in sides]
        n_a, n_b = (np.array([r[2] for r in side]) for side in sides)
        pairs = _open(*sides, percent) & within_reach(heads[0], n_a, heads[1], n_b, percent)
        if pairs.any():
            key = np.array([at[0]]).view(np.uint64)[0]
            pairs &= overlaps(*([h[: np.searchsorted(h, key)] for h in own] for own in heads)) == 0
        return _left(at, sides, pairs)

    return work


def _across(percent: int) -> Callable:
    """Links between the two blocks of a unit; rows (is_low, class, label, n, items)."""

    def work(at: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        sides = _sides(at, rows)
        if not all(sides):
            return []
        both = overlaps(*([_as_hashes(r[3]) for r in side] for side in sides))
        n_a, n_b = (np.array([r[2] for r in side]) for side in sides)
        linked = _open(*sides, percent) & (both >= least_overlap(n_a[:, None], n_b[None], percent))
        return [(sides[0][i][0], sides[1][j][0]) for i, j in zip(*np.nonzero(linked), strict=True)]

    return work


UNIT = ["key", "low", "high"]


def _units(rest: DataFrame, percent: int) -> DataFrame:
    """(key, low, high, is_low, class, label, n, place) of rest(key, class, label, n, place, of), where ``of`` is how many classes the column has.

    A column of up to BLOCK classes is one unit.  A larger one is cut by size classes first (a set links within its own and the
    next one only), then by a hash of the class inside each, and pairs of such blocks are the units.
    """
    own = ["class", "label", "n", "place"]
    whole = rest.where(F.col("of") <= BLOCK).select("key", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(True).alias("is_low"), *own)
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)))
    sized = rest.where(F.col("of") > BLOCK).withColumn("step", step.cast("int"))
    many = cut(sized.groupBy("key", "step").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    near = many.select("key", "step", "blocks", F.explode(F.array(*(F.col("step") + i for i in (-1, 0, 1)))).alias("other"))
    near = near.join(many.select("key", F.col("step").alias("other"), F.col("blocks").alias("others")), ["key", "other"])
    meets = near.groupBy("key", "step").agg(F.first("blocks").alias("blocks"), F.sort_array(F.collect_list(F.struct("other", "others"))).alias("meets"))  # three at most
    sized = sized.join(cut(meets), ["key", "step"])
    name = lambda step, block: F.shiftleft(step.cast("long"), 32) + block + 1
    sized = sized.withColumn("own", name(F.col("step"), F.pmod(F.xxhash64("class"), F.col("blocks"))))
    others = F.flatten(F.transform("meets", lambda m: F.transform(F.sequence(F.lit(0), m["others"] - 1), lambda i: name(m["other"], i))))
    met = sized.select("key", *own, "own", F.explode(others).alias("met"))
    return whole.unionByName(met.select("key", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), (F.col("own") <= F.col("met")).alias("is_low"), *own))


def _in_units(units: DataFrame, last: str, out: list[str], work: Callable) -> DataFrame:
    names = [*UNIT, "is_low", "class", "label", "n", last]
    dealt = units.repartition(*UNIT).sortWithinPartitions(*UNIT).select(names)
    return cut(dealt.mapInArrow(_by_unit(names, 3, out, work), ", ".join(f"{c} long" for c in out)))


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_equal (documents of the same set, itself included).

    Documents are linked where 100 * intersection >= percent * union of their sets of k-word shingles; component_id is the smallest id reachable.
    """
    made = cut(described(docs, k))
    sign = made.where("segment IS NULL").select("doc_id", "n_shingles", "h1", "h2")
    ranks = frequency_ranks(made.where("segment IS NOT NULL").select("part", "segment", "counts"), docs.rdd.getNumPartitions())
    classes = sign.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(F.col("n_shingles").cast("int").alias("n"), "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_equal"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))

    heads = cut(prefixes(docs, ranks, k, percent).join(classes.select("class", "doc_id", "n", "h1", "h2"), ["doc_id", "n", "h1", "h2"]).select("class", "n", "head"))

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(first, ROWS) for b in batches for first in range(0, b.num_rows, ROWS)):
            packed = batch.column("head").to_pylist()
            sizes = np.array([len(x) // 8 for x in packed], dtype=np.int64)
            at, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.record_batch([pa.array(np.frombuffer(b"".join(packed), dtype=np.int64)), *(batch.column(c).take(pa.array(at)) for c in ("class", "n")), pa.array(place.astype(np.int32))], names=["key", "class", "n", "place"])

    entries = heads.mapInArrow(columns, "key long, class long, n int, place int")
    shared = entries.groupBy("key").agg(F.min("class").alias("lead"), F.max("class").alias("most")).where("lead < most")
    members = entries.join(cut(shared.select("key", "lead")).hint("merge"), "key")  # one plan at every size
    members = cut(members.where("class <> lead"))
    pairs = members.select(F.col("lead").alias("a"), F.col("class").alias("b"), "n").distinct().join(classes.select(F.col("class").alias("a"), F.col("n").alias("n_a")), "a")
    pairs = cut(pairs.where(f"100 * least(n, n_a) >= {percent} * greatest(n, n_a)").select("a", "b"))
    near = _led(pairs, heads, "head", _led_near(percent))

    def rows_of(ids: DataFrame) -> DataFrame:
        """Full rows of ids(class); the other texts have sent their prefix only."""
        return cut(full_rows(docs, cut(ids.distinct().join(classes, "class").select("class", "doc_id", "n", "h1", "h2")), k).join(classes.select("class", "n"), "class"))

    ends = near.select(F.explode(F.array("a", "b")).alias("class"))
    edges = _led(near, rows_of(ends), "items", _led_links(percent))
    label = cut(components(edges))

    rest = members.select("key", "class", "n", "place").join(label.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("root", "class")).drop("root")
    mixed = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("of")).where("low < high").select("key", "of")
    rest = cut(rest.join(cut(mixed), "key"))
    if not rest.isEmpty():
        units, left = _units(rest, percent), [*UNIT, "class"]
        open_ = _in_units(units, "place", left, _by_place(percent))
        units = cut(units.drop("place").join(open_, left))
        open_ = _in_units(units.join(_of(heads.select("class", "head"), units, "class").hint("merge"), "class"), "head", left, _by_prefix(percent))
        units = cut(units.join(open_, left))
        if not units.isEmpty():
            full = units.join(rows_of(units.select("class")).select("class", "items").hint("merge"), "class")
            label = cut(components(edges.unionByName(_in_units(full, "items", ["a", "b"], _across(percent)).distinct())))
    grouped = classes.join(label.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    told = cut(grouped.join(least, "root").select(F.col("n").cast("long").alias("n_shingles"), "h1", "h2", "component_id", "n_equal"))
    out = sign.withColumn("known", F.col("doc_id").isNotNull()).join(told.withColumn("known", F.lit(True)), ["n_shingles", "h1", "h2", "known"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_equal", F.lit(1)).alias("n_equal"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(load(spark, sf_dir, "documents"), k=4, percent=85)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS nth, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, nth, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS items FROM d),
c AS (SELECT row_number() OVER (ORDER BY min(doc_id)) AS class, min(doc_id) AS doc_id, list_sort(items) AS items, len(items) AS n, count(*) AS n_equal FROM s WHERE len(items) > 0 AND doc_id IS NOT NULL GROUP BY list_sort(items), len(items)),
e AS (SELECT class, n, hash(unnest(items)) AS item FROM c),
o AS (SELECT a.class AS a, b.class AS b FROM e a JOIN e b ON a.item = b.item AND a.class < b.class AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL HAVING 185 * count(*) >= 85 * (any_value(a.n) + any_value(b.n))),
l AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
r AS (SELECT class AS a, class AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT r.a AS class, min(c.doc_id) AS component_id FROM r JOIN c ON c.class = r.b GROUP BY r.a)
SELECT s.doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, coalesce(c.n_equal, 1) AS n_equal
FROM s LEFT JOIN c ON c.items = list_sort(s.items) AND s.doc_id IS NOT NULL LEFT JOIN m ON m.class = c.class
"""
