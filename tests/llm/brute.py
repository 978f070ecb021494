"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(_LOWER)


def quality_counts(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:]))
    count = Counter(windows)
    covered = {i + k for i, g in enumerate(windows) if count[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered),
    )


def shingles(text):
    w = SPACE_WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(texts):
    """{id: (set size, smallest reachable id)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def contamination(text, items):
    """(words, hit words, item ids) for items {id: text}."""
    spans = defaultdict(set)
    for i, t in items.items():
        w = ALNUM_WORD.findall(lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            spans[tuple(w[k : k + n])].add(str(i))
    w = ALNUM_WORD.findall(lower(text))
    hit, found = set(), set()
    for n in {len(s) for s in spans}:
        for k in range(len(w) - n + 1):
            if ids := spans.get(tuple(w[k : k + n])):
                hit |= set(range(k, k + n))
                found |= ids
    return len(w), len(hit), sorted(found)


def places(text, phrases):
    """(words, [(start, label)]) of phrases that stand consecutively."""
    w = ALNUM_WORD.findall(lower(text))
    out = []
    for phrase, label in phrases:
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), out


class BackoffModel:
    """Absolute discounting over the n-grams that reach a share of the tokens."""

    def __init__(self, training, rate, discount=0.5):
        self.counts = Counter(t for text in training for t in text)
        self.total, self.discount = sum(self.counts.values()), discount
        least = max(1.0, rate * self.total)
        kept = {1: {(w,): n for w, n in self.counts.items() if n >= least}}
        for n in (2, 3):
            found = Counter()
            for text in training:
                for i in range(len(text) - n + 1):
                    g = tuple(text[i : i + n])
                    if g[:-1] in kept[n - 1] and g[1:] in kept[n - 1]:
                        found[g] += 1
            kept[n] = {g: c for g, c in found.items() if c >= least}
        self.kept = kept
        self.after = defaultdict(list)
        for n in (2, 3):
            for g in kept[n]:
                self.after[g[:-1]].append(g[-1])
        self._weights = {}

    def unigram(self, word):
        return (self.counts[word] + 1) / (self.total + len(self.counts) + 1)

    def weight(self, context):
        if context not in self._weights:
            words, n = self.after.get(context, []), len(context)
            taken = sum(
                (self.kept[n + 1][(*context, w)] - self.discount) / self.kept[n][context] for w in words
            )
            lower = sum(self.p(context[1:], w) for w in words)
            self._weights[context] = (1 - taken) / (1 - lower)
        return self._weights[context]

    def p(self, context, word):
        if not context:
            return self.unigram(word)
        n = len(context)
        if context not in self.kept[n]:
            return self.p(context[1:], word)
        gram = (*context, word)
        if gram in self.kept[n + 1]:
            return (self.kept[n + 1][gram] - self.discount) / self.kept[n][context]
        return self.weight(context) * self.p(context[1:], word)

    def score(self, text):
        return sum(math.log10(self.p(tuple(text[max(0, i - 2) : i]), w)) for i, w in enumerate(text))
