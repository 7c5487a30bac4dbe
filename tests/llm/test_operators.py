import difflib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkquarry.llm import blocks, chat_format, decontaminate, exact_dedup, language_id, line_dedup, lm_scoring, minhash_dedup, registry, source_mix, substring_dedup, tables, textkit, toxicity
from sparkquarry.llm.components import components
from tests.llm import brute
from tests.oracle import SF, assert_matches

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [None, "", " \n\t ", "one", "A b", "a B", "ÄÖ ß", "x\n\n\n\ny", LONG, "\U0001f600 � 　"]


def table(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), more.get("source", "s"), 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, a null id, and columns named like the operators' own."""
    docs = table(spark, ODD)
    docs = docs.unionByName(docs.where("doc_id BETWEEN 3 AND 5"))
    docs = docs.unionByName(spark.createDataFrame([(None, "no id", None, None, None), (50, "no source", None, None, None)], SCHEMA))
    for name in ("kept", "node", "key", "row", "hash", "size", "draw", "words", "score", "id", "n", "_id", "target", "_kept_id2", "block", "label"):
        docs = docs.withColumn(name, F.lit(name))
    return docs


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", [n for n in registry.MODULES if hasattr(registry.MODULES[n], "ORACLE")])
def test_oracle(spark, name):
    assert_matches(registry.queries()[name](spark, SF), registry.oracle_sql()[name])


# textkit


def test_word_and_shingle_hashes_are_position_free():
    texts = ["Alpha beta gamma delta", "zz alpha BETA gamma", None, "", "alpha beta"]
    kit = textkit.Words(pa.array(texts))
    assert kit.n.tolist() == [4, 3 + 1, 0, 0, 2]
    assert kit.hashes[0] == kit.hashes[5] and kit.hashes[1] == kit.hashes[6]
    value, text = kit.shingles(3)
    assert set(value[text == 0]) & set(value[text == 1]) and (text == 4).sum() == 1
    alone, _ = textkit.Words(pa.array(["alpha beta"])).shingles(3)
    assert alone[0] == value[text == 4][0]


def test_slices_keep_long_texts_whole():
    batch = pa.record_batch([pa.array(["x" * textkit.SLICE_BYTES * 2, "y", None, "z"])], names=["text"])
    assert [s.num_rows for s in textkit.slices(batch)] == [1, 3]


# 1 near duplicates


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]}


def near_copies():
    """A large group of near copies with varying distance, exact copies, and short texts."""
    random.seed(5)
    base = [f"b{random.randrange(400)}" for _ in range(120)]
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(random.randrange(0, 9)):
            w[random.randrange(len(w))] = f"e{random.randrange(10_000)}"
        texts.append(" ".join(w))
    return texts + texts[:20] + [" ".join(f"u{i}_{j}" for j in range(50)) for i in range(20)] + ["a b", "A  b", "a", "", None, "a b c", "a b c d"]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, k, percent):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    texts = dict(enumerate(near_copies()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(table(spark, texts.values()), k, percent).collect()}
    assert got == brute.near_components(texts, k, percent)


def test_near_duplicates_of_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.queries()["op1_minhash_dedup"](spark, SF).collect()}
    assert got == brute.near_components(texts, 3, 85)


def test_sketch_estimates_similarity():
    a = np.arange(1000, dtype=np.uint64)
    b = np.concatenate((a[:800], np.arange(5000, 5200, dtype=np.uint64)))
    s = minhash_dedup.sketch(textkit.mix(np.concatenate((a, b))), np.repeat([0, 1], 1000), 2, 512)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08
    tiny = minhash_dedup.sketch(textkit.mix(a[:1]), np.array([0]), 2, 64)
    assert (tiny[0] != 2**64 - 1).all() and (tiny[1] == 2**64 - 1).all()


def test_near_duplicates_edges(spark, odd, empty):
    rows = minhash_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].component_id == 4 and by_id[0].component_id == 0 and by_id[1].kept and by_id[None].component_id is None
    assert minhash_dedup.near_duplicates(empty).count() == 0
    kept = minhash_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.select("doc_id").collect()} == set(by_id) - {5}


# 2 language model


@pytest.mark.parametrize("size", [2000, 1_000_000])
def test_lm_scores_equal_a_dictionary_model(spark, monkeypatch, size):
    """Whole texts of the whole table: counts, base score and backoff score against plain dictionaries."""
    monkeypatch.setattr(lm_scoring, "BLOCK", size)
    monkeypatch.setattr(blocks, "BUCKET", 30_000)
    rows = registry.queries()["op2_lm_scoring"](spark, SF).collect()
    texts = {r.doc_id: brute.words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    model = brute.BackoffModel([t for i, t in texts.items() if not held[i]], lm_scoring.PRIORS)
    assert len(rows) == len(texts)
    for r in rows:
        t = [*texts[r.doc_id], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(model.one[w] > 0 for w in t), model.total)
        assert r.base_score == pytest.approx(sum(math.log10(model.base(w)) for w in t), abs=1e-6)
        assert r.score == pytest.approx(model.score(texts[r.doc_id]), abs=1e-6)
    fresh = [r for r in rows if r.held_out]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def test_states_of_the_automaton_are_distributions():
    """All words, the end and the mass of unknown words sum to one in every state."""
    texts = ["a b c a b c", "a b d", "b c a b", "a b c e", "c c c a", ""]
    made = textkit.Words(pa.array(texts))
    vocabulary, sequence = np.unique(made.hashes, return_inverse=True)
    columns = [pa.array([made.n.tolist()]), *(pa.array([x], pa.binary()) for x in (blocks.pack_sorted(vocabulary), blocks.pack(np.arange(len(vocabulary))), blocks.pack(sequence)))]
    block = blocks.Block(pa.record_batch(columns, names=["sizes", "vocabulary", "numbers", "sequence"]), 0)
    grams = lm_scoring.Grams(block, np.array([True] * 4 + [False, True]))
    counts = grams.told([n for _, n in grams.asked()])
    model = lm_scoring.Automaton(grams, counts, int(counts[0].sum()), int((counts[0] > 0).sum()))
    known = np.flatnonzero(counts[0] > 0)
    assert len(model.fail) > len(known)
    for state in range(len(model.fail)):
        gained, _ = model.step(np.full(len(known), state), known)
        below, s = 0.0, state
        while s:
            below, s = below + model.backoff[s], model.fail[s]
        assert (10**gained).sum() + 10 ** (below - math.log10(counts[0].sum() + len(known) + 1)) == pytest.approx(1)


def test_packed_numbers_come_back():
    rng = np.random.RandomState(3)
    for x in (np.zeros(0, np.int64), np.arange(300), rng.randint(0, 2**40, 1000), np.array([2**64 - 1], np.uint64)):
        assert (blocks.unpack(blocks.pack(x)).astype(np.uint64) == x.astype(np.uint64)).all()
        assert (blocks.unpack_sorted(blocks.pack_sorted(np.sort(x.astype(np.uint64)))) == np.sort(x.astype(np.uint64))).all()


def test_lm_edges(spark, odd, empty):
    rows = lm_scoring.score(odd).collect()
    assert len(rows) == odd.count() and all(r.n_tokens == r.n_known for r in rows) and all(r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    none = lm_scoring.score(odd.where("doc_id < 4"), F.lit(None).cast("boolean")).collect()
    assert {(r.base_score, r.score, r.n_known, r.train_tokens) for r in none} == {(0.0, 0.0, 0, 0)}
    assert lm_scoring.score(empty).count() == 0


# 3 chat formatting


def test_quote_links(spark):
    rows = [
        (1, 0, "user", "Shall we meet on Monday morning?\nThe room is free then."),
        (1, 1, "assistant", "Tuesday is better for me."),
        (1, 2, "user", "On Monday Ann wrote:\n> shall we  meet on MONDAY morning?\nYes, let us."),
        (1, 3, "assistant", "Bob wrote:\n> Yes, let us.\n>> Shall we meet on Monday morning?\n> > The room is free then.\nFine with me."),
        (1, 4, None, "> nobody ever said this line\nHm."),
        (2, 0, "user", "> Tuesday is better for me."),
        (None, 3, "user", None),
    ]
    got = {(r.conv_id, r.turn): r for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, t].parent_turn for t in range(5)] == [None, 0, 0, 2, 3]
    assert [got[1, t].depth for t in range(5)] == [0, 1, 1, 2, 3] and {got[1, t].root_turn for t in range(5)} == {0}
    assert got[1, 2].text == "Yes, let us." and got[1, 3].text == "Fine with me." and got[1, 4].markup == "<|user|>\nHm.\n<|end|>\n"
    assert got[2, 0].text == "" and got[2, 0].parent_turn is None and got[None, 3].depth == 0


def test_short_wrapped_and_cut_quotes(spark):
    rows = [
        (1, 0, "user", "Agreed."),
        (1, 1, "user", "The plan needs more people than we have at the moment, so we should ask the others first."),
        (1, 2, "user", "Yes, please."),
        (1, 3, "user", "> Agreed.\nWhy?"),
        (1, 4, "user", "On Mon 3 May Ann\nwrote:\n> The plan needs more\n> people than we have\n>\n> at the moment, so we\n> should ask the others first.\nFine."),
        (1, 5, "user", "> than we have at the\n> moment\nHow many?"),
        (1, 6, "user", ">  YES,  please.\nGood."),
        (1, 7, "user", "> nothing like it was said by anybody here\nOdd."),
        (1, 8, "user", ""),
        (1, None, "user", "> Agreed."),
        (1, 9, "user", "> Agreed.\n" + "> The plan needs more people\n" * 2 + LONG),
    ]
    got = {r.turn: r for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: got[t].parent_turn for t in got if t is not None} == {0: None, 1: 0, 2: 1, 3: 0, 4: 1, 5: 1, 6: 2, 7: 6, 8: 7, 9: 1}
    assert got[4].text == "Fine." and got[9].text == LONG and got[9].n_linked == 1 and got[None].parent_turn is None


def test_parents_of_a_quoted_table(spark):
    """Every message of the conversations quotes chosen earlier ones: nested, attributed, wrapped anew."""
    rng = random.Random(11)
    talks = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks.setdefault(r.conv_id, []).append(r)
    rows, truth = [], {}

    def wrapped(text, mark):
        w, out = text.split(), []
        while w:
            n = rng.randrange(3, 12)
            out.append(mark + " ".join(w[:n]))
            w = w[n:]
        return out

    for conv, turns in talks.items():
        for i, r in enumerate(turns):
            lines, parent = [], turns[i - 1].turn if i else None
            words = brute.words(r.text)
            if i and rng.random() < 0.7:
                j = rng.randrange(i)
                if len(brute.words(turns[j].text)) >= 3 and turns[j].text.split():
                    first = next(t.turn for t in turns[: j + 1] if brute.words(t.text) == brute.words(turns[j].text))
                    parent = first
                    inner = wrapped(turns[rng.randrange(j + 1)].text, ">> ") if rng.random() < 0.4 else []
                    lines = ["Somebody wrote:", *inner, *wrapped(turns[j].text, "> "), ""]
            truth[conv, r.turn] = parent, bool(words)
            rows.append((conv, r.turn, r.role, "\n".join([*lines, r.text])))
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in chat_format.format_chats(docs).collect()}
    wrong = [k for k, (parent, _) in truth.items() if got[k].parent_turn != parent]
    assert sum(parent is not None for parent, _ in truth.values()) > 30 and len(wrong) <= 0.02 * len(truth)


def test_long_conversations_and_spans(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "SPAN", 7)
    rows = [(1, 3 * i, "user", f"line number {i}") for i in range(100)] + [(1, 0, "user", "line number 0")]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.depth for r in got) == [0, *range(100)] and {r.root_turn for r in got} == {0}
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string, depth int, text2 string")).count() == 0


# 4 language


def test_language_accuracy_on_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    rows = registry.queries()["op4_language_id"](spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, odd, empty):
    rows = {r.doc_id: r for r in language_id.predict(odd, language_id.train(odd)).collect()}
    assert rows[0].lang_pred == "und" and rows[9].lang_pred == "und" and rows[3].lang_pred == "en" and rows[3].score == 1
    assert {r.lang_pred for r in language_id.predict(odd, language_id.train(empty)).collect()} == {"und"}
    assert language_id.predict(empty, None).count() == 0
    assert language_id.keep_identified(odd).columns == odd.columns
    assert language_id.keep_identified(odd.withColumn("lang", F.lit(None).cast("string"))).where("doc_id = 3").count() == 2


def test_ftrl_equals_a_dense_version():
    """Plain loops over all coordinates, one batch at a time, as the FTRL-proximal paper writes them."""
    rng = np.random.RandomState(5)
    labels = rng.randint(3, size=90)
    rows = [(np.unique(np.append(rng.choice(20, 4, replace=False), 20 + y)), None) for y in labels]
    rows = [(f, rng.rand(len(f))) for f, _ in rows]
    got = language_id.fit_ftrl(rows, labels, 3, 24, epochs=2, batch=32, alpha=0.3, beta=1.0, l1=0.02, l2=0.02)
    x = np.zeros((90, 25))
    for i, (f, v) in enumerate(rows):
        x[i, f], x[i, 24] = v, 1.0
    z, n, order = np.zeros((25, 3)), np.zeros((25, 3)), np.random.RandomState(7)

    def weights():
        w = np.zeros((25, 3))
        for i in range(25):
            for c in range(3):
                if abs(z[i, c]) > 0.02:
                    w[i, c] = -(z[i, c] - math.copysign(0.02, z[i, c])) / ((1.0 + math.sqrt(n[i, c])) / 0.3 + 0.02)
        return w

    for _ in range(2):
        shuffled = order.permutation(90)
        for first in range(0, 90, 32):
            some = shuffled[first : first + 32]
            w = weights()
            e = np.exp(x[some] @ w)
            g = x[some].T @ (e / e.sum(axis=1, keepdims=True) - np.eye(3)[labels[some]])
            for i in range(25):
                for c in range(3):
                    sigma = (math.sqrt(n[i, c] + g[i, c] ** 2) - math.sqrt(n[i, c])) / 0.3
                    z[i, c] += g[i, c] - sigma * w[i, c]
                    n[i, c] += g[i, c] ** 2
    assert np.allclose(got, weights())


def test_language_scores_equal_plain_tfidf(spark):
    texts = ["the cat sat on the mat", "der Hund saß auf der Matte", "Ünï çødé 42", None, "--", "a"]
    docs = table(spark, texts).withColumn("lang", F.when(F.col("doc_id") == 1, "de").otherwise("en"))
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}

    def features(text):
        """Hashed 1-, 2- and 3-grams of lower-cased letters, other runs as one space."""
        plain = "".join(c if c.isalpha() else " " for c in text.lower() + " ")
        while "  " in plain:
            plain = plain.replace("  ", " ")
        for n in (1, 2, 3):
            for i in range(len(plain) - n + 1):
                key = n
                for c in plain[i : i + n]:
                    key = (key * 2**21 + ord(c)) % 2**64
                yield (key * 0x9E3779B97F4A7C15) % 2**64 >> 48

    for i, text in enumerate(texts):
        if text is None or not any(map(str.isalpha, text)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        seen = list(features(text))
        logits = [sum(float(model.weights[f, c]) for f in seen) / len(seen) + model.bias[c] for c in range(2)]
        e = [math.exp(x - max(logits)) for x in logits]
        best = max(range(2), key=lambda c: (e[c], -c))
        assert got[i].lang_pred == model.classes[best] and got[i].score == pytest.approx(max(e) / sum(e), abs=1e-5)


def test_unreadable_texts_go_and_clean_ones_stay(spark):
    rng = random.Random(4)
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 12))) for _ in range(4000)]
    bad = [" ".join(rng.sample(junk, n)) for n in (20, 60, 200, 1000) for _ in range(5)] + ["漢字仮名交じり文章の例" * 8, "%% -- 12 !"]
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    more = spark.createDataFrame([(10**6 + i, t, None, "s", 0) for i, t in enumerate(bad)], SCHEMA)
    for languages in (None, ["en"]):
        some = docs if languages is None else docs.where(F.col("lang").isin(languages))
        kept = {r.doc_id for r in language_id.keep_identified(some.unionByName(more.select(*some.columns))).select("doc_id").collect()}
        readable = {r.doc_id for r in some.where("text RLIKE '[A-Za-z]'").select("doc_id").collect()}
        assert not {i for i in kept if i is not None and i >= 10**6} and len(readable - kept) <= 0.02 * len(readable)


def test_ftrl_is_sparse_and_calibrated():
    rng = np.random.RandomState(0)
    labels = np.arange(400) % 2
    rows = [(np.array([y, 2 + rng.randint(50)]), np.array([1.0, 1.0])) for y in labels]
    w = language_id.fit_ftrl(rows, labels, 2, 52, l1=1.0)
    assert w[0, 0] > 0 > w[0, 1] and (w[2:52] == 0).mean() > 0.5
    noisy = np.where(rng.rand(4000) < 0.8, 0, 1)
    assert language_id.calibrate(np.tile([10.0, 0.0], (4000, 1)), noisy) == pytest.approx(10 / math.log(4), rel=0.1)


# 5 lines


def test_line_dedup_equals_brute_force(spark, odd, empty):
    random.seed(2)
    texts = {i: "\n".join(random.choice("abc") for _ in range(random.randrange(0, 12))) for i in range(60)} | {60: None}
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(table(spark, texts.values())).collect()}
    assert got == brute.line_dedup(texts)
    rows = line_dedup.line_dedup(odd).collect()
    assert len(rows) == odd.count() and line_dedup.line_dedup(empty).count() == 0
    assert [r.text for r in rows if r.doc_id == 7] == ["x\n\n\n\ny"]


def test_a_long_text_of_covered_lines_costs_its_length(spark):
    many = "\n".join(f"line {i}" for i in range(60_000))
    rows = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, [many, many, f"{many}\nlast"])).collect()}
    assert rows[0].text == many and rows[1].text == "" and rows[2].text == "last" and rows[1].n_lines == len(rows[1].covered) == 60_000


# 6 toxicity


def test_machine_learns_a_pair():
    rng = np.random.RandomState(1)
    rows, labels = [], []
    for _ in range(1500):
        r = [f for f in (0, 1) if rng.rand() < 0.5] + list(2 + rng.choice(30, 3, replace=False))
        rows.append(np.array(r))
        labels.append(float(0 in r and 1 in r))
    bias, w, v = toxicity.fit_machine(rows, np.array(labels), np.ones(1500), 32, epochs=30, l1=0)
    assert v[0] @ v[1] > 0.5
    score = lambda r: bias + w[r].sum() + 0.5 * ((v[r].sum(0) ** 2).sum() - (v[r] ** 2).sum())
    assert np.mean([(score(r) > 0) == bool(y) for r, y in zip(rows, labels, strict=True)]) > 0.97


def test_training_finds_a_pair_of_harmless_terms(spark):
    rng = random.Random(5)
    texts, toxic = [], []
    for i in range(1500):
        pair = [["dunce"], ["tribe"], ["dunce", "tribe"], ["tribe"], ["dunce"], []][i % 6]
        texts.append(" ".join(rng.sample(pair + [f"n{rng.randrange(200)}" for _ in range(20)], len(pair) + 20)))
        toxic.append(int(len(pair) == 2 or i % 6 == 5))  # each word's own rate is that of all texts: 1 in 3
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    machine = toxicity.train(table(spark, texts), labels)
    both, one, other = machine.scores(pa.array(["n1 dunce n2 tribe", "n1 dunce n2", "n1 tribe n2"]))
    assert both > 0.8 and max(one, other) < 0.3


def test_evidence_does_not_grow_with_the_rows_a_sample_stands_for(spark, monkeypatch):
    counts = {r.feature: (r.zero, r.one) for r in toxicity.term_counts(spark.createDataFrame([("a b b", 0), ("a", 1), (None, 1), ("a c", 1)], "text string, toxic int")).collect()}
    assert sorted(counts.values()) == [(0, 1), (1, 0), (1, 2)]
    drawn = []
    monkeypatch.setattr(toxicity, "_fitted", lambda rates, used: drawn.append(sorted(used.tolist())) or (lambda batches: iter([pa.record_batch([pa.array([-1]), pa.array([0.0]), pa.array([[0.0] * 8])], names=["feature", "w", "v"])])))
    texts = ["insult" if i % 5 == 0 or i == 3 else "calm" for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    for positives, negatives in ((2500, 5000), (10, 20)):
        toxicity.train(table(spark, texts), labels, positives, negatives)
    assert drawn[0] == drawn[1] and len(drawn[0]) >= 1


def test_toxicity_on_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    rows = {r.doc_id: r for r in registry.queries()["op6_toxicity"](spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    ones, zeros = ([rows[r.doc_id].score for r in labels if r.toxic == y] for y in (1, 0))
    auc = np.mean([np.mean(np.array(zeros) < s) + 0.5 * np.mean(np.array(zeros) == s) for s in ones])
    assert auc > 0.9 and np.mean([s >= 0.5 for s in ones]) > 0.8 and np.mean([s >= 0.5 for s in zeros]) < 0.02


def test_toxicity_edges(spark, odd, empty):
    labels = spark.createDataFrame([(3, None), (4, 1), (4, 0), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(rows) == odd.count() and all(r.score > 0.99 for r in rows)
    assert all(r.score < 1e-9 for r in toxicity.score(odd, toxicity.train(odd, labels.limit(0))).collect())
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


# 7 decontamination


def test_templates_and_slots(spark, odd, empty):
    item = "A train leaves Paris at 9 and travels 120 km in 2 hours before Anna boards it at 9 sharp."
    again = "A train leaves Berlin at 7 and travels 300 km in 5 hours before Otto boards it at 7 sharp."
    broken = "A train leaves Berlin at 7 and travels 300 km in 5 hours before Otto boards it at 8 sharp."
    other = "A boat sails from Rome at 9 and needs 120 minutes for 40 miles while Anna sleeps below deck."
    docs = table(spark, [f"Some words. {item} More words.", again, broken, other, f"{item[:40]}", None, f"{item} {item}", item.upper()])
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert set(got) == {0, 1, 2, 6, 7} and got[0].verbatim and got[7].verbatim and not got[1].verbatim and got[1].coverage == 1
    assert not got[2].verbatim and got[2].coverage < 1  # one slip leaves the windows around it uncovered, no more
    assert decontaminate.decontaminate(odd, bench).count() == odd.count() and decontaminate.decontaminate(odd, bench).columns == odd.columns
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(odd, bench.limit(0)).count() == 0


def test_letter_case_numbers_and_short_items(spark):
    items = ["Compute 12 + 7 * 3 - 4", "2 + 2", "今日は天気がとても良いので散歩に行きましょう", "Mary Ann Smith met John Peter Miller Jones in Paris", "Name the largest planet of the solar system and its four brightest moons in order."]
    docs = [f"Homework. {items[0]} Good luck.", "2 + 2", "We know that 2 + 2 is 4 and 7 + 2 is 9.", f"x\n{items[2]}\ny", items[3].upper(), items[4].upper(), items[4].lower(), items[4].title(), f"{items[4][:40]} something else", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contamination(table(spark, docs), bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (3, 2), (4, 3), (5, 4), (6, 4), (7, 4)} and all(r.verbatim for r in got.values())


def test_slots_agree_over_the_whole_item(spark):
    item = "A farmer has 12 red hens and 30 white geese in the yard while the neighbour keeps 12 ducks near the old mill and sells 30 eggs a day."
    docs = [
        item.replace("12", "8").replace("30", "41"),
        item.replace("12", "8", 1).replace("30", "41"),  # 12 stands for 8 and 12: few windows disagree
        "".join(c if not c.isdigit() else str(i % 10) for i, c in enumerate(item)),  # every number another
        item.replace("12", "8").replace("30", "41").replace(" while", " and then, on the other side, while"),
    ]
    got = {r.doc_id: r for r in decontaminate.contamination(table(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert {0, 1, 3} <= set(got) and got[0].coverage == 1 and got[1].coverage < 1 and not got[0].verbatim


def test_reparameterised_items_of_the_table_are_found(spark):
    """Numbers and names of the benchmark's items changed, the copies put inside documents: recall at least 0.9, nothing else found."""
    rng = random.Random(9)
    sf = SF.replace("0.001", "0.01")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    plain = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 0").select("doc_id", "text")
    before = {(r.doc_id, r.item_id) for r in decontaminate.contamination(plain, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    rows, made = [], {}
    texts = [(r.doc_id, r.text or "") for r in plain.orderBy("doc_id").collect()]
    for (doc, text), (item, question) in zip(texts, items.items(), strict=False):
        numbers: dict = {}
        changed = re.sub(r"\d+", lambda m, numbers=numbers: numbers.setdefault(m[0], str(rng.randrange(100, 999))), question)
        changed = re.sub(r"(?<=[a-z,] )[A-Z][a-z]+", lambda m: {"Anna": "Olga"}.get(m[0], "Xavier"), changed)
        made[doc] = item
        rows.append((doc, f"{text}\n{changed}\n{text[:200]}"))
    rest = texts[len(rows) :]
    docs = spark.createDataFrame(rows + rest, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert len(made) >= 20 and sum((d, i) in got for d, i in made.items()) >= 0.9 * len(made)
    assert len(got - set(made.items()) - before) <= 1


def test_verbatim_passages_of_the_table_are_found(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 500)
    sf = SF.replace("0.001", "0.01")
    items = {r.item_id: " ".join(brute.words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = {r.doc_id: f" {' '.join(brute.words(r.text))} " for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if f" {x} " in t}
    got = {(r.doc_id, r.item_id) for r in registry.queries()["op7_decontaminate"](spark, sf).collect()}
    assert want and want <= got and len(got - want) <= 2


# 8 exact duplicates


def test_cuckoo_index_grows_and_deletes():
    index = exact_dedup.CuckooIndex(4)
    keys = [random.Random(i).randbytes(32) for i in range(3000)]
    for i, key in enumerate(keys + keys[:100]):
        index.put(key, i, 1)
    assert index.resizes and index.live == 3000 and index.get(keys[5])[1:] == [3005, 2]
    assert all(index.get(k) for k in keys) and index.get(b"x" * 32) is None
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert index.live == 1500 and all(index.get(k) for k in keys[1::2]) and not any(index.get(k) for k in keys[::2])


def test_exact_dedup_edges(spark, odd, empty):
    rows = exact_dedup.exact_dedup(odd).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and by_id[0].keep_id == 1 and by_id[4].keep_id == 5 and by_id[4].group_size == 4
    assert sum(r.kept for r in rows if r.doc_id == 3) == 2 and by_id[None].kept
    gone = exact_dedup.exact_dedup(odd, withdrawn=table(spark, ["ONE"])).where("doc_id = 3").collect()
    assert {(r.keep_id, r.kept, r.group_size) for r in gone} == {(None, False, 0)}
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter([1, 2, 3, 5, 6, 7, 8, 9, None, 50])
    assert exact_dedup.exact_dedup(empty).count() == 0


# 9 substring duplicates


def test_fenwick_chain_equals_quadratic():
    rng = random.Random(4)
    for _ in range(30):
        anchors = sorted({(rng.randrange(80), rng.randrange(80)) for _ in range(25)})
        pb, pa_ = [a[0] for a in anchors], [a[1] for a in anchors]
        best, path = substring_dedup.chain(pa_, pb)
        assert all(pb[i] < pb[j] and pa_[i] < pa_[j] for i, j in zip(path, path[1:], strict=False))
        tree = substring_dedup.Fenwick(80)
        seen = []
        for i, a in enumerate(pa_):
            want = max([(v, j) for v, j, p in seen if p < a], default=(-1e18, -1))
            assert tree.before(a) == want
            tree.raise_to(a, (float(pb[i]), i))
            seen.append((float(pb[i]), i, a))
        assert best >= substring_dedup.K


def test_fuzzy_passages(spark, odd, empty):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = noise(90)
    fuzzy = [w for i, w in enumerate(passage) if i % 30 != 17]
    fuzzy[40] = "changed"
    texts = [noise(100), noise(40) + passage + noise(60), noise(20) + passage + noise(10), noise(70) + fuzzy + noise(5), passage[:45] + noise(50), noise(500)]
    rows = substring_dedup.repeated_passages(table(spark, [" ".join(t) for t in texts])).collect()
    found = {r.doc_id: r for r in rows}
    assert set(found) == {2, 3} and {r.source_doc_id for r in rows} == {1}
    assert (found[2].start_word, found[2].end_word, found[2].source_start, found[2].identity) == (20, 110, 40, 1.0)
    assert abs(found[3].start_word - 70) <= 1 and found[3].n_words >= 85 and 0.9 < found[3].identity < 1
    assert substring_dedup.repeated_passages(empty).count() == 0
    assert substring_dedup.repeated_passages(odd).count() == 0


def _noise(rng, n):
    return [f"v{rng.randrange(3000)}" for _ in range(n)]


def test_a_passage_put_together_from_pieces_is_found_whole(spark):
    """A holds 45 words, B other 45, C and D both hold the 90 in one piece: D's copy of C must be reported."""
    rng = random.Random(1)
    texts, groups = [], []
    for _ in range(40):
        a, b = _noise(rng, 45), _noise(rng, 45)
        for parts in ((30, a, 30), (30, b, 30), (20, a, b, 20), (25, a, b, 15)):
            texts.append(" ".join(w for p in parts for w in (p if isinstance(p, list) else _noise(rng, p))))
        groups.append((len(texts) - 2, len(texts) - 1))
    got = {(r.source_doc_id, r.doc_id) for r in substring_dedup.repeated_passages(table(spark, texts)).collect() if r.n_words >= 88}
    assert len(got & set(groups)) >= 36


def test_alignment_counts_words_once():
    rng = np.random.RandomState(1)
    for _ in range(50):
        a = rng.randint(1000, 10**6, 80).astype(np.uint32)
        cut = sorted(rng.choice(np.arange(10, 70), 2, replace=False))
        b = np.concatenate((a[: cut[0]], a[cut[0] + 1 : cut[1]], rng.randint(1, 900, 2).astype(np.uint32), a[cut[1] :]))  # a word gone, two put in
        anchors = [(i, j) for j in range(len(b) - 5) for i in range(75) if (a[i : i + 6] == b[j : j + 6]).all()]
        got = substring_dedup.align(a, b, [i for i, _ in anchors], [j for _, j in anchors])
        assert got == (0, 80, 0, 81, 79)
    best, path = substring_dedup.chain([1, 5, 9, 40], [11, 15, 19, 50])
    assert path == [0, 1, 2, 3] and best > substring_dedup.LEAST_CHAIN


def test_recall_of_fuzzy_passages(spark):
    """Passages of 100 words with 3 to 15 % of the words changed, dropped or put in, against plain word alignment."""
    rng = random.Random(2)
    texts, planted = [], {}
    for share in (0.03, 0.06, 0.1, 0.15):
        for _ in range(30):
            passage = _noise(rng, 100)
            again = []
            for w in passage:
                kind = rng.random() / share
                again += [w] if kind >= 1 else [f"v{rng.randrange(3000)}"] if kind < 0.6 else [] if kind < 0.8 else [w, "extra"]
            texts += [" ".join(_noise(rng, 30) + passage + _noise(rng, 40)), " ".join(_noise(rng, 50) + again + _noise(rng, 20))]
            same = sum(m.size for m in difflib.SequenceMatcher(None, passage, again, autojunk=False).get_matching_blocks())
            planted[len(texts) - 1] = same / max(len(passage), len(again))
    found = {r.doc_id for r in substring_dedup.repeated_passages(table(spark, texts)).collect()}
    assert found <= set(planted)
    for low, high, least in ((0.95, 1, 1.0), (0.9, 0.95, 0.9), (0.8, 0.9, 0.75)):
        some = [d for d, p in planted.items() if low <= p < high]
        assert len(some) >= 10 and sum(d in found for d in some) >= least * len(some)


def test_rows_that_repeat_an_id_and_hot_passages(spark):
    rng = random.Random(6)
    passage = _noise(rng, 60)
    rows = [(i % 40, " ".join(_noise(rng, 20) + passage + _noise(rng, 20)), "en", "s", 0) for i in range(80)] + [(None, " ".join(passage), "en", "s", 0)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.doc_id > r.source_doc_id and r.n_words >= 60 for r in got)
    assert Counter(r.doc_id for r in got if r.source_doc_id == 0) == {i: 2 for i in range(1, 40)}


def test_passages_of_the_table_cover_exact_repeats(spark):
    texts = {r.doc_id: brute.words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    covered = {i: set() for i in texts}
    for r in registry.queries()["op9_substring_dedup"](spark, SF).collect():
        covered[r.doc_id].update(range(r.start_word, r.end_word))
    seen = {}
    for i in sorted(texts):
        w = texts[i]
        for p in range(len(w) - 49):
            if seen.setdefault(tuple(w[p : p + 50]), i) != i:
                assert covered[i] >= set(range(p, p + 50))


# 10 mixing


def test_targets_are_capped_and_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in source_mix.targets(sizes).collect()}
    assert got["a"] == 20 and got[None] == 0 and sum(got.values()) == pytest.approx(1510 * 1.5)
    assert got["c"] <= 1000 and got["b"] <= 2000


def test_mix_edges(spark, odd, empty):
    rows = source_mix.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.plays <= 2 for r in rows)
    assert source_mix.mix(empty).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, source_mix.mix(odd.repartition(3)).collect()))


@pytest.mark.parametrize("ids", ["null", "one", "few", "own"])
def test_mix_meets_its_targets_with_null_and_repeated_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(source_mix, "PART", 50)
    monkeypatch.setattr(source_mix, "SLICE", 20)
    name = {"null": lambda i: None, "one": lambda i: 7, "few": lambda i: i % 5, "own": lambda i: i}[ids]
    rows = [(name(i), " ".join(["w"] * (1 + i % 3)), None, "ab"[i % 2], 0) for i in range(1200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = source_mix.mix(docs).collect()
    assert len(got) == 1200 and all(0 <= r.plays <= 2 for r in got)
    for source in "ab":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.size * r.plays for r in mine) - mine[0].target) <= 3
    assert sorted(map(str, got)) == sorted(map(str, source_mix.mix(docs.repartition(5)).collect()))


def test_mix_of_the_table_comes_near_its_targets(spark):
    sf = SF.replace("0.001", "0.01")
    rows = registry.queries()["op10_source_mix"](spark, sf).toPandas()
    source = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").toPandas()
    per = rows.merge(source, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "max"), largest=("size", "max"))
    assert ((per.taken - per.target).abs() <= per.largest).all() and (rows.taken <= 2 * rows["size"]).all()


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "source_mix"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in source.select("doc_id", "text").collect()}
    docs, kept = source, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "source_mix" or docs.columns == source.columns
    readable = {i for i, t in texts.items() if any(map(str.isalpha, t or ""))}
    assert kept["language_id"] <= readable and len(readable - kept["language_id"]) <= 0.02 * len(readable)
    last = {}
    for i in sorted(kept["language_id"]):
        last[(texts[i] or "").translate(brute.LOWER)] = i
    assert kept["exact_dedup"] == set(last.values())
    groups = brute.near_components({i: texts[i] for i in kept["exact_dedup"]}, 5, 80)
    assert kept["near_dedup"] == {i for i, (_, root) in groups.items() if i == root}
    assert kept["source_mix"] == kept["decontaminate"] <= kept["near_dedup"]
    before = set(os.listdir(tables.shared_dir(spark)))
    assert corpus_pipeline.run(spark, SF).count() == len(kept["source_mix"])
    assert len(set(os.listdir(tables.shared_dir(spark))) - before) == len(corpus_pipeline.STAGES)  # nothing else stays


def test_pipeline_edges(spark, odd, empty):
    import corpus_pipeline

    for docs, some in ((odd, True), (empty, False)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = tables.cut(stage(spark, docs, SF))
            assert name == "source_mix" or docs.columns == columns
        assert (docs.count() > 0) == some


def test_runs_of_one_word_are_passages(spark):
    noise = [" ".join(f"n{d}_{i}" for i in range(30)) for d in range(3)]
    texts = [f"{noise[0]} {'as ' * 80}{noise[1]}", f"{'as ' * 70}{noise[2]}", "as " * 20]
    rows = substring_dedup.repeated_passages(table(spark, texts)).collect()
    assert [(r.doc_id, r.source_doc_id, r.start_word) for r in rows] == [(1, 0, 0)] and rows[0].n_words >= 60
