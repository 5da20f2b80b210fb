"""Brute-force versions that the operators are held against."""

import math

import numpy as np

from affinity.llm import lm


class Walker:
    """A backoff automaton built state by state from counts, walked one token at a time."""

    def __init__(self, texts):
        self.count = {}
        for text in texts:
            tokens = [b"", *text.encode().lower().split(), b""]
            for n in (1, 2, 3):
                for i in range(0 if n > 1 else 1, len(tokens) - n + 1):
                    gram = tuple(tokens[i : i + n])
                    self.count[gram] = self.count.get(gram, 0) + 1
        of = lambda n: [c for g, c in self.count.items() if len(g) == n]
        words, pairs, triples = of(1), of(2), of(3)
        kinds = [np.array(lm.classes(np.array(x, np.int64)), float).reshape(2, -1) for x in (words, pairs)]
        beta = tuple(lm.beta_of(*k, n) for k, n in zip(kinds, (len(pairs), len(triples))))
        self.weights = lm.Weights(sum(words), len(words), sum(c == 1 for c in words), beta)

    def unigram(self, w):
        return float(self.weights.unigram(np.array([self.count.get((w,), 0)]))[0])

    def failure(self, h):
        c = self.count.get(h, 0)
        return c ** self.weights.beta[len(h) - 1] / (c + c ** self.weights.beta[len(h) - 1]) if c else 1.0

    def probability(self, w, h):
        if not h:
            return self.unigram(w)
        c, lower = self.count.get(h, 0), self.probability(w, h[1:])
        return (1 - self.failure(h)) * self.count.get((*h, w), 0) / c + self.failure(h) * lower if c else lower

    def score(self, text):
        total, state = 0.0, (b"",) if (b"",) in self.count else ()
        for w in [*text.encode().lower().split(), b""]:
            while state and (*state, w) not in self.count:  # failure arcs
                total += math.log10(self.failure(state))
                state = state[1:]
            total += math.log10(self.probability(w, state))
            state = (*state, w)[-2:] if (w,) in self.count else ()
        return total
