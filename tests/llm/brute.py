"""Plain Python versions that the operators are compared with."""

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def near_components(texts, k, percent):
    """{id: (set size, smallest id reachable)} by comparing every pair that shares a shingle."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        met = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                met[j] += 1
            holders[s].append(i)
        for j, n in met.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def line_dedup(texts):
    """{id: text} without lines under a three-line window that occurred before."""
    seen, out = set(), {}
    for i in sorted(texts):
        lines = (texts[i] or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            window = tuple(lines[p : p + 3])
            if window in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(window)
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


class BackoffModel:
    """Order 3 with Dirichlet priors over dictionaries; None is the end, "<s>" the start."""

    def __init__(self, texts, priors):
        self.priors, self.one, self.two, self.three = priors, Counter(), Counter(), Counter()
        for t in texts:
            t = ["<s>", *t, None]
            self.one.update(t[1:])
            self.two.update(zip(t, t[1:], strict=False))
            self.three.update(zip(t, t[1:], t[2:], strict=False))
        self.total, self.distinct = sum(self.one.values()), len(self.one)
        self.texts = len(texts)

    def base(self, w):
        return (self.one[w] + 1) / (self.total + self.distinct + 1)

    def probability(self, history, w):
        """By backing off: the longest learned context first, failure weights on the way down."""
        if not history:
            return self.base(w)
        context = self.two[history] if len(history) == 2 else self.texts if history == ("<s>",) else self.one[history[0]]
        seen = (self.three if len(history) == 2 else self.two)[(*history, w)]
        prior = self.priors[len(history) - 1]
        below = self.probability(history[1:], w)
        return (seen + prior * below) / (context + prior) if context else below

    def score(self, words):
        t = ["<s>", *words, None]
        return sum(math.log10(self.probability(tuple(t[max(0, i - 2) : i]), t[i])) for i in range(1, len(t)))
