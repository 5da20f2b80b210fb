"""Toxicity by maximum-scoring segments.

A word's score is the log-odds of its use, or that of its beginning, in toxic against other labelled documents,
smoothed by a Dirichlet prior that follows the pooled frequencies; words without
evidence of toxicity share one pooled, negative score. A linear scan over a text's
scores finds every maximal segment. Under the score's own null model segment scores
follow an extreme-value law, P(S >= x) = 1 - exp(-K n e^(-lambda x)): lambda solves
sum p0(w) e^(lambda s(w)) = 1 and K is fitted to the other labelled documents. The bits
``lambda S - ln(K n)`` of the significant segments add up, and a logistic curve fitted on
the labelled documents turns the sum into the probability that the label is 1.

A word counts where its likelihood ratio is beyond chance among all words tested, so the
lexicon grows with the labels. The lexicon and the curve are fitted on at most ``labelled`` documents, drawn by a hash of their id; a word counts once a document and once a context (the word before it), so that neither copies nor
one long document vote many times. Every document is scored over its whole text.

Defined results: null, empty and word-less texts get the curve's value at no evidence;
null labels are no labels; repeated rows are each scored; without labelled documents of
both kinds all scores are 0; further columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_arrow, map_arrow, raw

#: Documents at most that the model is fitted on.
LABELLED = 20_000
#: Toxic documents, and contexts in them, that a word needs, and how many words may pass for toxic by chance.
LEAST, CHANCE = 3, 0.01
#: Log-odds below which a word is left with the rest.
LEAST_ODDS = 3.0

#: Bytes of words are kept (letters lower-cased, digits, all beyond ASCII), others become spaces.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


#: Lengths of the word beginnings that count as features beside the word itself.
STEMS = range(4, 8)
#: Words whose scores a task remembers before it starts over.
REMEMBERED = 400_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


def features(word: bytes) -> list[str]:
    """The word and its beginnings, marked with a hyphen."""
    text = word.decode(errors="replace")
    return [text, *(text[:k] + "-" for k in STEMS if k < len(text))]


def segments(position: np.ndarray, score: np.ndarray, rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last, score)`` in one pass.

    ``position`` holds the words with a score of their own, ascending; every word between
    two of them scores ``rest`` <= 0. The list of candidate segments keeps, for each, the
    cumulative score to its left and right, and which earlier candidate is the nearest whose
    left sum is lower; a new one is merged with that candidate as long as its right sum is
    higher. Candidates that a link skips are never looked at again, so the scan is linear.
    """
    first, last, low, high, lower = [], [], [], [], []
    total, at = 0.0, 0
    for p, s in zip(position.tolist(), score.tolist()):
        total += rest * (p - at)
        at = p + 1
        before, total = total, total + s
        if s <= 0:
            continue
        start, j = p, len(first) - 1
        while j >= 0 and low[j] >= before:
            j = lower[j]
        while j >= 0 and high[j] < total:
            start, before, k = first[j], low[j], lower[j]
            for x in (first, last, low, high, lower):
                del x[j:]
            j = k
        first.append(start)
        last.append(p)
        low.append(before)
        high.append(total)
        lower.append(j)
    return [(a, b, y - x) for a, b, x, y in zip(first, last, low, high)]


def least_ratio(words: int) -> float:
    """The likelihood ratio that ``CHANCE`` of so many words reach, where none has to do with the label (chi square, one side)."""
    low, high = 0.0, 200.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if words * math.erfc(math.sqrt(mid / 2)) / 2 <= CHANCE else (mid, high)
    return high


@dataclass
class Model:
    """Word scores, the extreme-value law and the curve."""

    scores: dict[str, float] = field(default_factory=dict)
    remembered: dict[bytes, float] = field(default_factory=dict)
    rest: float = -0.01
    rate: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    shift: float = -50.0

    def word_score(self, word: bytes) -> float:
        """The highest score of the word's features, or 0 where none has one."""
        if len(self.remembered) > REMEMBERED:
            self.remembered.clear()
        out = self.remembered[word] = max(self.scores.get(f, 0.0) for f in features(word))
        return out

    def passages(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Significant segments with their bits above chance."""
        if not self.scores:
            return []
        get = self.remembered.get
        scores = [get(w) for w in words]
        if None in scores:
            scores = [self.word_score(w) if s is None else s for w, s in zip(words, scores)]
        own = [(i, s) for i, s in enumerate(scores) if s]
        if not own:
            return []
        position, score = zip(*own)
        chance = math.log(self.k * len(words))
        return [(a, b, bits) for a, b, s in segments(np.array(position), np.array(score), self.rest) if (bits := self.rate * s - chance) > 0]

    def evidence(self, words: list[bytes]) -> float:
        return math.log1p(sum(x[2] for x in self.passages(words)))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * evidence + self.shift))))


def uses(sample: DataFrame) -> DataFrame:
    """``(word, before, doc)`` of the sample's toxic documents, each once a document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text in zip(batch.column(1).to_pylist(), raw(batch, "text")):
            words = words_of(text)
            rows += {(f, v.decode(errors="replace"), doc) for v, w in set(zip([b"", *words], words)) for f in features(w)}
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*rows) if rows else ([], [], []))], names=["word", "before", "doc"])

    return map_arrow(sample.where("label > 0").select("text", "copy"), run, "word string, before string, doc string")


def documents_with(sample: DataFrame, known: list[str]) -> DataFrame:
    """``(word, n)``: how many of the other documents hold each known word; under "" the words of all, once a document."""
    wanted = set(known)

    def run(batches):
        count: dict[str, int] = {"": 0}
        for batch in batches:
            for text in raw(batch, "text"):
                own = {f for w in set(words_of(text)) for f in features(w)}
                count[""] += len(own)
                for w in own & wanted:
                    count[w] = count.get(w, 0) + 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(count, pa.string()), "n": pa.array(count.values(), pa.int64())})

    return sample.where("label = 0").select("text").mapInArrow(run, "word string, n long")


def fit(docs: DataFrame, labels: DataFrame, usable, labelled: int = LABELLED) -> Model:
    """Fit on documents of ``docs(doc_id, text)`` with ``labels(doc_id, toxic)`` where ``usable`` holds."""
    marks = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    drawn = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    # one copy of each text; at most `labelled` ids, so their table is small enough to broadcast
    sample = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("copy")).agg(F.min_by("text", "doc_id").alias("text"), F.min_by("label", "doc_id").alias("label")).persist()
    try:
        words = uses(sample).groupBy("word").agg(F.countDistinct("doc").alias("docs"), F.countDistinct("before").alias("contexts"))
        totals = words.agg(F.sum("docs"))
        # a word of copies has few contexts, one of a single long document few documents
        positive = words.select("word", F.least("docs", "contexts").alias("n")).where(F.col("n") >= LEAST).collect()
        known = {r.word: r.n for r in positive}
        other = {r.word: r.n for r in documents_with(sample, sorted(known)).groupBy("word").agg(F.sum("n").alias("n")).collect()}
        n1, n0 = totals.first()[0] or 0, other.pop("", 0)
        if not n1 or not n0:
            return Model()
        model = Model()
        y1 = np.array(list(known.values()), float)
        y0 = np.array([other.get(w, 0) for w in known], float)
        # prior: pooled frequency, worth two words in each class
        pooled = (y1 + y0) / (n1 + n0)
        prior = 2 * pooled
        odds = np.log((y1 + prior) / (n1 + 2)) - np.log((y0 + prior) / (n0 + 2))
        ratio = 2 * (y1 * np.log(y1 / (pooled * n1)) + y0 * np.log(np.maximum(y0, 1e-9) / (pooled * n0)))
        take = (odds >= LEAST_ODDS) & (ratio >= least_ratio(len(known)))
        model.scores = {w: float(s) for w, s, t in zip(known, odds, take) if t}
        rest1, rest0 = max(n1 - y1[take].sum(), 1), max(n0 - y0[take].sum(), 1)
        model.rest = min(-1e-4, math.log(rest1 / n1) - math.log(rest0 / n0))
        # lambda: the root of sum p0 e^(lambda s) = 1 above zero
        p0 = (y0[take] + prior[take]) / (n0 + 2)
        s = odds[take]
        f = lambda x: float((p0 * np.exp(np.minimum(x * s, 700))).sum() + (1 - p0.sum()) * math.exp(x * model.rest)) - 1
        low, high = 1e-3, 5.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) < 0 else (low, mid)
        model.rate = max(low, 0.05)
        model.k = 1e-12

        def highest(batch: pa.RecordBatch) -> pa.RecordBatch:
            best, size = [], []
            for text in raw(batch, "text"):
                words = words_of(text)
                best.append(max((x[2] + math.log(model.k * len(words)) for x in model.passages(words)), default=0.0))
                size.append(len(words))
            return pa.RecordBatch.from_pydict({"s": pa.array(best, pa.float64()), "n": pa.array(size, pa.int64())})

        # K: of the other documents, those above the 0.9 quantile of positive scores tell the tail
        null = np.array([(r.s, r.n) for r in map_arrow(sample.where("label = 0").select("text"), highest, "s double, n long").collect()], float).reshape(-1, 2)
        level = np.quantile(null[null[:, 0] > 0, 0], 0.9) if (null[:, 0] > 0).any() else 1.0
        tail = ((null[:, 0] >= level).sum() + 0.5) / (len(null) + 1)
        model.k = max(1e-9, -math.log1p(-min(tail, 0.99)) * math.exp(level) / max(null[:, 1].mean(), 1))

        def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.evidence(words_of(x)) for x in raw(batch, "text")]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1)], names=["x", "label"])

        seen = map_arrow(sample.select("text", "label"), weigh, "x double, label int").collect()
        model.slope, model.shift = logistic(np.array([r.x for r in seen]), np.array([float(r.label > 0) for r in seen]))
        return model
    finally:
        sample.unpersist()


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, targets drawn in by one pseudo-count a class."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.array([0.0, math.log((n1 + 1) / (n0 + 1))])
    m = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ a, -50, 50)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 1e-6 * np.eye(2), m.T @ (t - p) - 1e-6 * a)
        a += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0]), float(a[1])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted, n_passages, first_word, last_word`` of every row of ``docs(doc_id, text)``.

    ``first_word`` and ``last_word`` bound the strongest passage in words from 0 (null if none).
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in raw(batch, "text"):
            found = model.passages(words_of(text))
            best = max(found, key=lambda x: x[2], default=(None, None, 0))
            p = model.probability(math.log1p(sum(x[2] for x in found)))
            rows.append((p, int(p >= threshold), len(found), best[0], best[1]))
        columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "score", "predicted", "n_passages", "first_word", "last_word"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(picked, run, "doc_id long, score double, predicted int, n_passages long, first_word long, last_word long")


def keep_civil(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept."""
    return filter_arrow(docs, {"text": "string"}, lambda batch: [model.probability(model.evidence(words_of(x))) < threshold for x in raw(batch, "text")])
