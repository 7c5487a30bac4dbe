"""Benchmark decontamination (7): template windows with typed slots.

A text becomes a template: numbers, units (after a number) and names (a capital inside a sentence) turn
into typed placeholders, other words stay, lower-cased and without outer punctuation.  Windows of WINDOW
words are hashed in two forms and joined with those of the benchmark: as templates, where at least half of
the words are literal, and as the words themselves, which letter case and what counts as a name don't change.

A benchmark item is found in a document where windows of one form cover at least MIN_COVERAGE of the item's
windows of that form.  Template windows count where their slots agree with the item's: every item value
stands for one document value, the one that most windows give it (ties: the first place in the document),
over the whole item.  So a re-parameterised question counts like a verbatim one; ``verbatim`` tells them apart.

The benchmark's window hashes reach the tasks that read documents in blocks of at most BLOCK, one scan each,
so only matching windows are shuffled and the broadcast has a fixed bound whatever the benchmark's size.  Of
an item with n windows one of the n - ceil(n MIN_COVERAGE) + 1 rarest must match: only these are joined with
all documents, the others just for the pairs so found, so a window that many items and documents share isn't
multiplied out.

Defined results: null or empty texts and items have no windows; an item shorter than WINDOW words has windows
of its own length; below SHORTEST words it is found as words only, and with less than SHORT_BYTES bytes only
where it is a whole document; an item without a half-literal window is found as words only; rows that repeat
an id are one document or item; rows with a null id are one document or item of id null.  Texts in scripts
without spaces are single words: they are found where spaces or line ends set them off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquarry.llm import textkit
from sparkquarry.llm.tables import by_slice, cut, load

WINDOW, SHORTEST, SHORT_BYTES, MIN_COVERAGE = 8, 5, 24, 0.5
TEMPLATE, WORDS = 0, 1
BLOCK = 4_000_000
NUMBER, UNIT, NAME = (np.uint64(x) for x in (1, 2, 3))

#: Units of measure, time and money that follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent degrees degree "
    "usd eur dollar dollars euro euros cent cents hz khz mhz ghz w kw mw v a k b kb mb gb tb mph kph"
).split()


def _hash_of(words: list[str]) -> np.ndarray:
    return np.sort(textkit.Cores(pa.array([" ".join(words)])).hashes)


class Templates:
    """Template word hashes of a run of texts, with the slot values of placeholders."""

    def __init__(self, texts: pa.Array) -> None:
        words = textkit.Cores(texts)
        self.value, self.size = words.hashes, words.end - words.start
        self.text, self.n, self.first = words.text, words.n, words.first
        after_number = np.zeros(len(self.value), dtype=bool)
        after_number[1:] = words.number[:-1] & (words.text[1:] == words.text[:-1])
        unit = after_number & np.isin(self.value, _hash_of(UNITS)) if len(self.value) else after_number
        name = words.capital & ~words.opens
        self.slot = words.number | unit | name
        self.word = np.where(words.number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, self.value)))
        self.slots_before = np.concatenate(([0], np.cumsum(self.slot)))

    def windows(self, size: int, form: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of each run of size words of one text, as templates only those at least half literal."""
        m = len(self.word) - size + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        inside = self.text[:m] == self.text[size - 1 :]
        if form == TEMPLATE:
            inside &= 2 * (self.slots_before[size:] - self.slots_before[:m]) <= size
        hashes, _ = textkit.runs(self.word if form == TEMPLATE else self.value, np.zeros(len(self.word), np.int8), size)
        at = np.flatnonzero(inside)
        return textkit.mix(hashes[at], int(size + 100 * form)), at

    def slots(self, at: int, size: int) -> np.ndarray:
        return self.value[at : at + size][self.slot[at : at + size]].view(np.int64)


_FOUND = "id string, form int, hash long, position long, slots array<long>"


def _found(part: pa.RecordBatch, made: Templates, form: int, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    """Windows as rows: (hash, first word, size)."""
    hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _, _ in rows)])
    at = np.concatenate([np.zeros(0, np.int64), *(a for _, a, _ in rows)])
    slots = [made.slots(i, size) if form == TEMPLATE else [] for _, places, size in rows for i in places.tolist()]
    text = made.text[at]
    columns = [part.column("id").take(pa.array(text)), pa.array(np.full(len(at), form, np.int32)), pa.array(hashes.view(np.int64)), pa.array(at - made.first[text]), pa.array(slots, pa.list_(pa.int64()))]
    return pa.record_batch(columns, names=["id", "form", "hash", "position", "slots"])


def item_windows(items: DataFrame) -> DataFrame:
    """(id, form, hash, position, slots, size, whole) of every window of items(id, text); whole: it must be a whole document."""

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = Templates(part.column("text"))
        sizes = np.minimum(made.n, WINDOW)
        whole = (made.n < SHORTEST) & (np.bincount(made.text, weights=made.size, minlength=len(made.n)) < SHORT_BYTES)
        for size in np.unique(sizes[sizes > 0]).tolist():
            for form in (TEMPLATE, WORDS) if size >= SHORTEST else (WORDS,):
                hashes, at = made.windows(size, form)
                mine = sizes[made.text[at]] == size
                out = _found(part, made, form, [(hashes[mine], at[mine], size)])
                out = out.append_column("size", pa.array(np.full(out.num_rows, size, dtype=np.int64)))
                yield out.append_column("whole", pa.array(whole[made.text[at[mine]]]))

    return by_slice(items, work, f"{_FOUND}, size long, whole boolean").dropDuplicates(["id", "form", "position", "hash"])


def matching_windows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(id, form, hash, position, slots) of the windows of docs(id, text) whose hash is in known(form, hash, size, whole)."""
    spark = docs.sparkSession
    keys = known.groupBy("form", "hash", "size").agg(F.min("whole").alias("whole"))
    blocks = max(1, -(-keys.count() // BLOCK))
    out = None
    for block in range(blocks):
        own = keys.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == block).toPandas()
        own["key"] = own["hash"].to_numpy().view(np.uint64)
        own = own.sort_values("key")
        by_size = spark.sparkContext.broadcast({key: (g["key"].to_numpy(), g["whole"].to_numpy()) for key, g in own.groupby(["form", "size"])})

        def work(part: pa.RecordBatch, by_size=by_size) -> Iterator[pa.RecordBatch]:
            made = Templates(part.column("text"))
            rows: dict[int, list] = {TEMPLATE: [], WORDS: []}
            for (form, size), (sought, whole) in by_size.value.items():
                hashes, at = made.windows(size, form)
                if len(hashes):
                    place = np.minimum(np.searchsorted(sought, hashes), len(sought) - 1)
                    hit = (sought[place] == hashes) & (~whole[place] | (made.n[made.text[at]] == size))
                    rows[form].append((hashes[hit], at[hit], size))
            for form in (TEMPLATE, WORDS):
                yield _found(part, made, form, rows[form])

        part = by_slice(docs, work, _FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def _keyed(df: DataFrame, column: str) -> DataFrame:
    """(id, text) with the id as text, null as 'null'."""
    return df.select(F.coalesce(F.col(column).cast("long").cast("string"), F.lit("null")).alias("id"), "text")


def contamination(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, n_windows, n_covered, coverage, verbatim."""
    items = cut(item_windows(_keyed(benchmark, "item_id")))
    hits = cut(matching_windows(_keyed(docs, "doc_id"), items))
    theirs = items.select(F.col("id").alias("item"), "form", "hash", F.col("position").alias("item_position"), F.col("slots").alias("item_slots"))
    seen = hits.groupBy("form", "hash").agg(F.count("*").alias("seen"))
    per_item = Window.partitionBy("item", "form")
    ranked = theirs.join(seen, ["form", "hash"], "left").select("item", "form", "hash", "item_position", F.coalesce("seen", F.lit(0)).alias("seen"))
    ranked = ranked.withColumn("nth", F.row_number().over(per_item.orderBy("seen", "item_position"))).withColumn("n_windows", F.count("*").over(per_item))
    probes = ranked.where((F.col("seen") > 0) & (F.col("nth") <= F.col("n_windows") - F.ceil(F.col("n_windows") * min_coverage) + 1)).select("item", "form", "hash").distinct()
    pairs = cut(hits.join(probes, ["form", "hash"]).select("id", "item", "form").distinct())
    met = pairs.join(theirs, ["item", "form"]).join(hits, ["id", "form", "hash"])
    met = cut(met.select("id", "item", "form", "item_position", F.arrays_zip("item_slots", "slots").alias("slots"), "position"))
    values = met.where(F.size("slots") > 0).select("id", "item", "position", F.explode(F.array_distinct("slots")).alias("s"))
    votes = values.groupBy("id", "item", F.col("s.item_slots").alias("of"), F.col("s.slots").alias("is")).agg(F.count("*").alias("n"), F.min("position").alias("at"))
    said = votes.groupBy("id", "item", "of").agg(F.max_by("is", F.struct("n", -F.col("at"), "is")).alias("is"))
    said = said.groupBy("id", "item").agg(F.map_from_entries(F.collect_list(F.struct("of", "is"))).alias("said"))  # at most one entry a slot of the item
    agreed = met.join(said, ["id", "item"], "left").where(F.forall("slots", lambda s: s["slots"] == F.element_at("said", s["item_slots"])))
    sizes = theirs.groupBy("item", "form").agg(F.countDistinct("item_position").alias("n_windows"))
    covered = agreed.groupBy("id", "item", "form").agg(F.countDistinct("item_position").alias("n_covered")).join(sizes, ["item", "form"])
    covered = covered.withColumn("coverage", F.col("n_covered") / F.col("n_windows")).where(F.col("coverage") >= min_coverage)
    out = covered.groupBy("id", "item").agg(F.max(F.struct("coverage", "form", "n_windows", "n_covered")).alias("best"), (F.max("form") == WORDS).alias("verbatim"))
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("long")
    return out.select(number("id").alias("doc_id"), number("item").alias("item_id"), "best.n_windows", "best.n_covered", "best.coverage", "verbatim")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item, all columns as they were."""
    found = contamination(docs, benchmark).select(F.col("doc_id").alias("_found_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_found_id"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
