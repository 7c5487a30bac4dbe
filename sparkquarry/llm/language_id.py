"""Language ID (4): sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a space, and n-grams of 1 to 3 code points are
hashed into DIMS features.  The weight of a feature in a text is its relative frequency times its
inverse document frequency, taken over all learning texts; the model is fitted with
follow-the-regularised-leader (FTRL-proximal) under an elastic net on a sample of about FIT_ROWS texts
a language, and one temperature is calibrated on CALIBRATE_ROWS further texts a language.  Both bounds
are parameters; rows are sampled by a hash of the id.  The model is at most DIMS x languages numbers.

``keep_identified`` rejects by readability, which doesn't depend on how many languages there are: a text
goes if its n-grams are rarer, by their mean inverse document frequency, than those of the sampled texts of
every language by ODD standard deviations (robust between texts, and within a text of that length), or if it
has no letter.

Defined results: null or letterless texts are ``und`` with score 0; so is every text where nothing can be
learned (no labelled rows); with one label that is predicted with score 1; ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.llm import textkit
from sparkquarry.llm.tables import by_slice, crc_fold, load

DIMS = 1 << 16
FIT_ROWS, CALIBRATE_ROWS = 500, 150
SCALE, ODD, OVERLAP = 60.0, 6.0, 3.0  # n-grams overlap: so many of them count as one
UNDETERMINED = "und"

_letter = np.array([chr(c).isalpha() for c in range(0x10000)])


class Grams:
    """Hashed n-grams of a run of texts: feature and text of each occurrence, and whether a text has letters."""

    def __init__(self, texts: pa.Array) -> None:
        parts = [(t or "").lower() + " " for t in texts.to_pylist()]
        point = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        text = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        low = point < 0x10000
        keep = _letter[np.where(low, point, 0)]
        if not low.all():
            high, inverse = np.unique(point[~low], return_inverse=True)
            keep[~low] = np.array([chr(c).isalpha() for c in high.tolist()])[inverse]
        self.letters = np.bincount(text[keep], minlength=len(parts)) > 0
        point = np.where(keep, point, 32).astype(np.uint64)
        again = np.zeros(len(point), dtype=bool)
        again[1:] = ~keep[1:] & ~keep[:-1] & (text[1:] == text[:-1])
        point, text = point[~again], text[~again]
        features, owners = [], []
        for n in (1, 2, 3):
            m = len(point) - n + 1
            if m <= 0:
                break
            key = np.full(m, n, dtype=np.uint64)
            for i in range(n):
                key = key * np.uint64(1 << 21) + point[i : i + m]
            feature = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int32)
            inside = text[:m] == text[n - 1 :]
            features.append(feature[inside])
            owners.append(text[:m][inside])
        self.feature = np.concatenate(features) if features else np.zeros(0, np.int32)
        self.text = np.concatenate(owners) if owners else np.zeros(0, np.int32)
        self.n = np.bincount(self.text, minlength=len(parts))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, texts) of one task."""
    total = np.zeros(DIMS, dtype=np.int64)
    rows = 0
    for batch in batches:
        for part in textkit.slices(batch):
            grams = Grams(part.column("text"))
            rows += part.num_rows
            for first in range(0, part.num_rows, 64):
                mine = (grams.text >= first) & (grams.text < first + 64) if part.num_rows > 64 else slice(None)
                seen = np.zeros((64, DIMS), dtype=bool)
                seen[grams.text[mine] - first, grams.feature[mine]] = True
                total += seen.sum(axis=0, dtype=np.int64)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["feature", "texts"])


def _sampled(docs: DataFrame, counts: dict[str, int], rows: int) -> Column:
    """About ``rows`` rows a language, by a hash of the id that knows nothing of the language; rows of one id are drawn together."""
    draw = (F.pmod(F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit("draw")), F.lit(1 << 30)) / (1 << 30)).alias("draw")
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows / n))])
    return draw < F.element_at(share, docs["lang"])


def _sparse(docs: DataFrame) -> DataFrame:
    """(lang, holdout, features, counts): distinct features of each text."""

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        grams = Grams(part.column("text"))
        key, n = np.unique(grams.text.astype(np.int64) * DIMS + grams.feature, return_counts=True)
        sizes = np.bincount(key // DIMS, minlength=part.num_rows)
        columns = [part.column("lang"), part.column("holdout"), textkit.ragged((key % DIMS).astype(np.int32), sizes), textkit.ragged(n.astype(np.int32), sizes)]
        yield pa.record_batch(columns, names=["lang", "holdout", "features", "counts"])

    return by_slice(docs, work, "lang string, holdout boolean, features array<int>, counts array<int>")


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, dims: int, epochs: int = 6, batch: int = 32, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights (dims + 1, classes), the last row the bias, of a multinomial model by FTRL-proximal with elastic net."""
    z, n = (np.zeros((dims + 1, classes)) for _ in range(2))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    order = np.random.RandomState(7)
    for _ in range(epochs):
        shuffled = order.permutation(len(rows))
        for first in range(0, len(rows), batch):
            some = shuffled[first : first + batch]
            at, inverse = np.unique(np.concatenate([np.append(rows[i][0], dims) for i in some]), return_inverse=True)
            x = np.zeros((len(some), len(at)))
            x[np.repeat(np.arange(len(some)), [len(rows[i][0]) + 1 for i in some]), inverse] = np.concatenate([np.append(rows[i][1], 1.0) for i in some])
            w = weights(at)
            p = _softmax(x @ w)
            p[np.arange(len(some)), labels[some]] -= 1
            g = x.T @ p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(dims + 1))


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = np.log(_softmax(logits / np.exp(t)) + 1e-300)
        own = p[np.arange(len(labels)), labels].sum()
        rest = (p.sum() - own) / max(1, p.shape[1] - 1)
        return -(own * (len(labels) + 1) + rest) / (len(labels) + 2)  # Platt's smoothed targets: a separable sample stays finite

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class LanguageModel:
    """classes, weights scaled by idf and by 1 / temperature, (DIMS, classes), and bias; idf, and for each class the usual mean idf of a text and its deviations between and within texts."""

    def __init__(self, classes: list[str], weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, usual: np.ndarray) -> None:
        self.classes, self.weights, self.bias, self.idf, self.usual = classes, weights.astype(np.float32), bias, idf.astype(np.float32), usual

    def oddness(self, grams: Grams) -> np.ndarray:
        """By how many standard deviations a text's n-grams are rarer than usual in the language that they fit best."""
        n = np.maximum(grams.n, 1)
        mean = np.bincount(grams.text, weights=self.idf[grams.feature], minlength=len(grams.n)) / n
        of = [(mean - middle) / np.sqrt(among**2 + OVERLAP * within**2 / n) for middle, among, within in self.usual]
        return np.where(grams.letters, np.min(of, axis=0), 0.0)


def usual_rarity(means: np.ndarray, deviations: np.ndarray, sizes: np.ndarray) -> tuple[float, float, float]:
    """(median of the texts' mean idf, its robust deviation between long texts, 15 % at least, the usual deviation inside a text)."""
    if not len(means):
        return np.inf, 1.0, 1.0
    long = sizes >= np.median(sizes)
    middle = float(np.median(means[long]))
    among = 1.4826 * float(np.median(np.abs(means[long] - middle)))
    return middle, max(among, 0.15 * middle, 1e-3), max(float(np.median(deviations)), 1e-3)


def _fitted(classes: list[str], idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, kept, rarity = [], [], [], []
        for batch in batches:
            for lang, holdout, feature, count in zip(*(batch.column(c) for c in ("lang", "holdout", "features", "counts")), strict=True):
                f, c = feature.values.to_numpy(), count.values.to_numpy()
                if len(f):
                    rows.append((f, (c / c.sum() * idf[f] * SCALE)))
                    labels.append(classes.index(lang.as_py()))
                    kept.append(holdout.as_py())
                    mean = (c * idf[f]).sum() / c.sum()
                    rarity.append((mean, np.sqrt((c * (idf[f] - mean) ** 2).sum() / c.sum()), c.sum()))
        rarity = np.array(rarity).reshape(-1, 3)
        usual = np.array([usual_rarity(*rarity[np.array(labels, dtype=int) == c].T) for c in range(len(classes))])
        labels, kept = np.array(labels, dtype=int), np.array(kept, dtype=bool)
        order = sorted(range(len(rows)), key=lambda i: (labels[i], len(rows[i][0]), rows[i][1].sum()))  # reruns agree
        rows, labels, kept = [rows[i] for i in order], labels[order], kept[order]
        fit = np.flatnonzero(~kept) if not kept.all() else np.arange(len(rows))
        w = fit_ftrl([rows[i] for i in fit], labels[fit], len(classes), DIMS)
        held = np.flatnonzero(kept)
        t = calibrate(np.array([x @ w[f] + w[DIMS] for f, x in (rows[i] for i in held)]).reshape(-1, len(classes)), labels[held])
        at = np.flatnonzero((w != 0).any(axis=1) | (np.arange(DIMS + 1) == DIMS))
        yield pa.record_batch([pa.array(np.append(at, -1)), textkit.ragged(np.append((w[at] / t).ravel(), usual.ravel()), np.append(np.full(len(at), len(classes)), usual.size))], names=["feature", "weights"])

    return run


def train(docs: DataFrame, fit_rows: int = FIT_ROWS, calibrate_rows: int = CALIBRATE_ROWS) -> LanguageModel | None:
    """A model of docs(doc_id, text, lang), rows without lang left out; None without labelled rows that have letters."""
    known = docs.where("lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    classes = sorted(counts)
    seen = known.select("text").mapInArrow(_document_frequencies, "feature long, texts long").groupBy("feature").agg(F.sum("texts").alias("texts")).toPandas()
    total = int(seen.loc[seen["feature"] < 0, "texts"].sum())
    seen = seen[seen["feature"] >= 0]
    idf = np.full(DIMS, np.log(1.0 + total))
    idf[seen["feature"].to_numpy()] = np.log((1.0 + total) / (1.0 + seen["texts"].to_numpy())) + 0.1
    # one draw: its lower part fits, its upper part calibrates
    drawn = known.where(_sampled(known, counts, fit_rows + calibrate_rows))
    part = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("part")), F.lit(fit_rows + calibrate_rows))
    sample = _sparse(drawn.withColumn("holdout", part >= fit_rows).select("text", "lang", "holdout"))
    weights = sample.repartition(1).mapInArrow(_fitted(classes, idf), "feature long, weights array<double>").toPandas()  # a bounded sample
    usual = np.array(weights.loc[weights["feature"] < 0, "weights"].iloc[0]).reshape(-1, 3)
    weights = weights[weights["feature"] >= 0]
    w = np.zeros((DIMS + 1, len(classes)))
    w[weights["feature"].to_numpy()] = np.stack(weights["weights"].to_numpy())
    return LanguageModel(classes, w[:DIMS] * (idf * SCALE)[:, None], w[DIMS], idf, usual)


def _predicted(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score, oddness) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model, n = shared.value, part.num_rows
        grams = Grams(part.column("text"))
        if model is None:
            best, score, known, odd = np.zeros(n, int), np.zeros(n), np.zeros(n, bool), np.zeros(n)
            names = [UNDETERMINED]
        else:
            names, known, odd = model.classes, grams.letters, model.oddness(grams)
            logits = np.stack([np.bincount(grams.text, weights=model.weights[:, c][grams.feature], minlength=n) for c in range(len(names))], axis=1)
            p = _softmax(logits / np.maximum(grams.n, 1)[:, None] + model.bias)
            best, score = p.argmax(axis=1), np.where(known, p.max(axis=1), 0.0)
        langs = [names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
        yield pa.record_batch([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score), pa.array(odd)], names=["doc_id", "lang_pred", "score", "oddness"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_slice(docs.select("doc_id", "text"), work, f"doc_id {kind}, lang_pred string, score double, oddness double")


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    return _predicted(docs, model).drop("oddness")


def keep_identified(docs: DataFrame, odd: float = ODD) -> DataFrame:
    """docs whose language is identified and whose text reads like the labelled ones, all columns as they were.

    The model learns from the rows that have lang; where no row has, every text with a letter stays.  Of
    rows that repeat an id all stay if one does.
    """
    model = train(docs)
    if model is None:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    judged = _predicted(docs, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("oddness") <= odd)).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(judged, docs["doc_id"].eqNullSafe(judged["_id"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("held_out", crc_fold("doc_id", 5) == 0)
    found = predict(docs, train(docs.where("NOT held_out")))
    return found.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
