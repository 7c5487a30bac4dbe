"""LM scoring (2): a weighted backoff automaton over smoothed n-grams of the corpus.

All n-grams of orders 1, 2 and 3 of the learning texts count, whatever their number.  Smoothing is a
hierarchy of Dirichlet priors (MacKay and Peto): the probability of a word after a context adds a PRIOR
of pseudo-words, spread by the next shorter context, to the counts; below all contexts stands add-one over
single words.  As an automaton: every context that was learned is a state; a seen continuation is an arc
with its smoothed log-probability; the failure arc leads to the longest shorter suffix and weighs
PRIOR / (count of the context + PRIOR), so all continuations of a state sum to one.

The automaton of the whole corpus is never gathered.  Texts are read in blocks (``blocks.py``): a block
asks for the corpus counts of just its own n-grams, builds the part of the automaton that its texts can
walk through, and reads them once from left to right: the state is carried, an arc adds its weight, a
missing arc adds failure weights on the way down.  Texts are read in lanes of LANE tokens; a lane first
reads the two tokens before it, which settles its state because no state is longer.

Per n-gram of a block about six bytes are shuffled to its bucket and a count comes back; a bucket is
bounded, a frequent n-gram is one entry a block.

Defined results: null and empty texts are one end token; without learning texts every probability is 1;
ids may be null or repeat, each row is scored by itself; a null ``learns`` is false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.llm import blocks, textkit
from sparkquarry.llm.tables import crc_fold, cut, load

PRIORS, ORDER, LANE = (256.0, 16.0), 3, 64  # pseudo-words of orders 2 and 3
BLOCK = 500_000  # larger than elsewhere: the n-grams that a block's texts share are asked for once
END, START = np.uint64(0), np.uint64(0x5851F42D4C957F2D)


class Grams:
    """The n-grams of a block: tokens by number (0 the end, then words, last the start), pairs and triples by place of their key.

    ``hashes`` holds the 64-bit keys of each order, ``order`` their sorting, ``counts`` the learned occurrences.
    """

    def __init__(self, block: blocks.Block, learned: np.ndarray) -> None:
        words = np.concatenate(([END], block.vocabulary, [START]))
        self.start = len(words) - 1
        self.first = block.first + 2 * np.arange(len(block.first))
        self.tokens = np.zeros(self.first[-1], dtype=np.int64)
        self.tokens[self.first[:-1]] = self.start
        self.tokens[np.arange(len(block.text)) + 2 * block.text + 1] = block.sequence + 1
        self.owner = np.repeat(np.arange(len(block.sizes)), np.diff(self.first))
        counted = learned[self.owner].astype(np.float64)
        wide = len(words)
        self.two = np.flatnonzero(self.tokens != self.start)  # where a pair ends
        pairs, self.pair_at = np.unique(self.tokens[self.two - 1] * wide + self.tokens[self.two], return_inverse=True)
        place = np.full(len(self.tokens), -1)
        place[self.two] = self.pair_at
        self.three = self.two[self.tokens[self.two - 1] != self.start]
        triples, some, triple_at = np.unique(place[self.three - 1] * wide + self.tokens[self.three], return_index=True, return_inverse=True)
        self.context, self.word = np.divmod(pairs, wide)
        self.longer, self.last = np.divmod(triples, wide)
        self.shorter = place[self.three[some]] if len(triples) else np.zeros(0, int)  # the pair that ends a triple
        inner = self.tokens[self.two]
        self.counts = [
            np.bincount(inner, weights=counted[self.two], minlength=wide - 1)[: wide - 1],
            np.bincount(self.pair_at, weights=counted[self.two], minlength=len(pairs)),
            np.bincount(triple_at, weights=counted[self.three], minlength=len(triples)),
        ]
        join = lambda a, b, seed: textkit.mix(a * np.uint64(0x9E3779B97F4A7C15) + b, seed)
        of_pairs = join(words[self.context], words[self.word], 21)
        self.hashes = [words[:-1], of_pairs, join(of_pairs[self.longer], words[self.last], 22)]
        self.order = [np.argsort(h) for h in self.hashes]

    def asked(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(h[o], n[o].astype(np.int64)) for h, o, n in zip(self.hashes, self.order, self.counts, strict=True)]

    def told(self, answers: list[np.ndarray]) -> list[np.ndarray]:
        """Corpus counts in the order of hashes."""
        out = [np.empty(len(o), dtype=np.float64) for o in self.order]
        for x, o, n in zip(out, self.order, answers, strict=True):
            x[o] = n
        return out


class Automaton:
    """States, arcs and failure arcs of a block's n-grams with their corpus counts.

    State 0 is the empty context, then come single words and pairs that were learned as contexts.
    ``arcs`` holds sorted state * wide + word; ``fail`` and ``backoff`` the failure arcs.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, distinct: int, priors: tuple[float, float] = PRIORS) -> None:
        one, two, three = counts
        prior2, prior3 = priors
        self.wide = grams.start + 1
        p1 = (one + 1.0) / (tokens + distinct + 1.0)
        follows = np.append(one, one[0])  # a text begins as often as it ends
        follows[0] = 0
        p2 = (two + prior2 * p1[grams.word]) / (follows[grams.context] + prior2)
        p3 = (three + prior3 * p2[grams.shorter]) / (two[grams.longer] + prior3)
        number = np.cumsum(follows > 0)
        self.single = np.where(follows > 0, number, 0)  # the state of each word alone
        pair = (two > 0) & (grams.word > 0)
        pair_state = np.where(pair, np.cumsum(pair) + number[-1], 0)
        self.unigram = np.log10(p1)
        self.fail = np.concatenate((np.zeros(number[-1] + 1, np.int64), self.single[grams.word[pair]]))
        self.backoff = np.log10(np.concatenate(([1.0], prior2 / (follows[follows > 0] + prior2), prior3 / (two[pair] + prior3))))
        seen2, seen3 = two > 0, three > 0
        arcs = np.concatenate((self.single[grams.context[seen2]] * self.wide + grams.word[seen2], pair_state[grams.longer[seen3]] * self.wide + grams.last[seen3]))
        weight = np.log10(np.concatenate((p2[seen2], p3[seen3])))
        onward = np.concatenate((pair_state[seen2], pair_state[grams.shorter[seen3]]))
        order = np.argsort(arcs)
        self.arcs, self.weight, self.next = arcs[order], weight[order], onward[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, next state) of each word in each state."""
        gained, target = np.zeros(len(state)), np.zeros(len(state), np.int64)
        open_, here = np.arange(len(state)), state
        while len(open_):
            sought = here * self.wide + word[open_]
            at = np.minimum(np.searchsorted(self.arcs, sought), max(0, len(self.arcs) - 1))
            hit = (self.arcs[at] == sought) & (here > 0) if len(self.arcs) else np.zeros(len(open_), bool)
            gained[open_[hit]] += self.weight[at[hit]]
            target[open_[hit]] = self.next[at[hit]]
            root = open_[~hit & (here == 0)]
            gained[root] += self.unigram[word[root]]
            target[root] = self.single[word[root]]
            on = ~hit & (here > 0)
            open_, here = open_[on], here[on]
            gained[open_] += self.backoff[here]
            here = self.fail[here]
        return gained, target

    def read(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The log10 probability of each text; tokens have a start and an end around each."""
        lanes_of = -(-(np.diff(first) - 1) // LANE)
        owner = np.repeat(np.arange(len(lanes_of)), lanes_of)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
        begin = first[:-1][owner] + 1 + nth * LANE
        stop = np.minimum(begin + LANE, first[1:][owner])
        state = np.where(nth == 0, self.single[-1], 0)
        total = np.zeros(len(owner))
        for ahead in range(1 - ORDER, LANE):
            at = begin + ahead
            live = np.flatnonzero((at < stop) & ((ahead >= 0) | (nth > 0)))
            if not len(live):
                break
            gained, state[live] = self.step(state[live], tokens[at[live]])
            if ahead >= 0:
                total[live] += gained
        return np.bincount(owner, weights=total, minlength=len(lanes_of)).astype(float)


def _grams(batch: pa.RecordBatch, row: int) -> Grams:
    learned = batch.column("marks")[row].values.fill_null(False).to_numpy(zero_copy_only=False)
    return Grams(blocks.Block(batch, row), learned)


def score(docs: DataFrame, learns: Column | None = None, priors: tuple[float, float] = PRIORS) -> DataFrame:
    """Every row of docs(doc_id, text) under the model of the rows where ``learns`` holds (all without it):

    doc_id, n_tokens, n_known, train_tokens, base_score, score.
    """
    marked = docs.select(F.col("doc_id").alias("id"), (F.lit(True) if learns is None else F.coalesce(learns, F.lit(False))).alias("mark"), "text")
    made = cut(blocks.text_blocks(marked, BLOCK))
    tokens = made.agg(F.coalesce(F.sum(F.size("sizes") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0))).first()[0]
    counts = cut(blocks.global_counts(made, lambda batch, row: _grams(batch, row).asked(), tokens))
    learned, distinct = counts.where("kind = 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                grams = _grams(batch, row)
                own = grams.told(blocks.counts_of(batch.column("answers")[row], ORDER))
                model = Automaton(grams, own, learned, distinct, priors)
                inner, texts = grams.tokens[grams.two], grams.owner[grams.two]
                sums = lambda x, n=len(grams.first) - 1, texts=texts: np.bincount(texts, weights=x, minlength=n)
                columns = [batch.column("ids")[row].values, pa.array(np.diff(grams.first) - 1), pa.array(sums(own[0][inner] > 0).astype(np.int64))]
                columns += [pa.array(sums(model.unigram[inner]).astype(float)), pa.array(model.read(grams.tokens, grams.first))]
                yield pa.record_batch(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = blocks.with_counts(made, counts).mapInArrow(work, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(learned).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_fold("doc_id", 7) == 2
    found = score(load(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
