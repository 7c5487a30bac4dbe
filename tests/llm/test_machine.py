"""The factorization machine's scores as a double loop over the pairs of a text's features."""

import math

import numpy as np
import pyarrow as pa

from sparkquarry.llm import toxicity


def test_scores_are_sums_over_all_pairs():
    rng = np.random.RandomState(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 2, 7, 30, 200)] + [None, "W1 w1 w2", "unknown things only"]
    feature, _ = toxicity.terms(pa.array([" ".join(words)]))
    known = np.unique(feature)[::2]  # every second feature has parameters
    w, v = rng.randn(len(known)) * 0.2, rng.randn(len(known), toxicity.FACTORS) * 0.3
    machine = toxicity.Machine(-0.7, known, w, v)
    place = {int(f): i for i, f in enumerate(known)}
    got = machine.scores(pa.array(texts))
    for text, p in zip(texts, got.tolist(), strict=True):
        own = sorted({place[int(f)] for f in toxicity.terms(pa.array([text]))[0] if int(f) in place})
        margin = -0.7 + sum(w[i] for i in own)
        for a, i in enumerate(own):
            for j in own[a + 1 :]:
                margin += sum(x * y for x, y in zip(v[i], v[j], strict=True))
        assert math.isclose(p, 1 / (1 + math.exp(-max(-30, min(30, margin)))), rel_tol=1e-9)
    assert math.isclose(got[0], 1 / (1 + math.exp(0.7)))
