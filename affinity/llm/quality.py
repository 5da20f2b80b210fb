"""Document quality by co-training two views.

The content view sees the text alone: pairs of neighbouring character classes, word
repetition and the layout of lines. The page view sees what is known about the document
without reading it: language, source and stated length. Each view is a logistic model.
Starting from the labelled documents, both are fitted in rounds: a view labels the
unlabelled documents that it is surest of, in the proportion of the classes among the labels,
and these go into the training of the *other* view; each round gives twice as many. Each
view's score is calibrated on labelled documents kept out of training, and the calibrated
log-odds of both are combined, with weights fitted there too, into the probability that a
document is of quality. Each half of the kept documents judges a round's model by a calibration on
the other half, and a round (the first is that without pseudo-labels) is preferred to an
earlier one only if it saves loss there.

The models are fitted on at most ``labelled`` labelled and ``unlabelled`` other documents,
drawn by a hash of the id; every document is scored over its whole text.

Defined results: null and empty texts have the features of no characters and are scored
by them; missing or null metadata counts as unknown; null labels are no labels; without
labelled documents of both kinds everything scores 1; repeated rows are each scored; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_arrow, map_arrow, raw

#: Documents at most that the models are fitted on; rounds, pseudo-labels a view gives in the first, and the log-odds they need.
LABELLED, UNLABELLED, ROUNDS, FIRST, SURE = 6000, 6000, 5, 50, 3.0
#: Loss on the kept documents, in nats over all of them, that a later round must save to be preferred.
GAIN = 0.2
#: Below this probability a document is rejected.
THRESHOLD = 0.5
META = {"lang": "string", "source": "string", "n_chars": "double"}
HASHED, MAGNITUDES = 24, 16

KINDS = 16
# character classes: letters, capitals, digits, space, line end, bytes beyond ASCII, and common marks each on its own
CLASS = np.full(256, 15, np.uint8)
for _kind, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", range(128, 256), b"!", b"#$", b"%&*", b"|", b".", b",;:", b"<>{}[]", b"/\\_=+~^`", b"@"), 0):
    CLASS[list(_bytes)] = _kind


def content_features(text: bytes | None) -> np.ndarray:
    """Shares of character-class pairs, on a log scale, and word repetition."""
    text = text or b""
    kinds = CLASS[np.frombuffer(text, np.uint8)]
    pairs = np.bincount(kinds[:-1].astype(np.int64) * KINDS + kinds[1:], minlength=KINDS * KINDS) if len(kinds) > 1 else np.zeros(KINDS * KINDS)
    words = text.split()
    n = max(len(words), 1)
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    size = np.array([len(x) for x in text.split(b"\n")], float)
    more = [distinct / n, again / n, np.log1p(n), distinct / np.sqrt(n), len(text) / n]
    layout = [np.log1p(len(size)), np.log1p(size.mean()), np.log1p(size.max()), np.log1p(size.std()), (size < 40).mean(), (size == 0).mean()]
    return np.concatenate([np.log1p(1000 * pairs / max(len(kinds), 1)), more, layout]).astype(np.float32)


def page_features(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """Metadata: names hashed, and the stated length, as it is and by its magnitude."""
    out = np.zeros(2 * HASHED + MAGNITUDES + 1)
    for at, name in ((0, lang), (HASHED, source)):
        if name is not None:
            out[at + zlib.crc32(name.encode()) % HASHED] = 1
    if n_chars is not None and n_chars == n_chars:
        size = np.log2(1 + max(n_chars, 0))
        out[2 * HASHED + min(int(size), MAGNITUDES - 1)] = 1
        out[-1] = size
    return out.astype(np.float32)


@dataclass
class Logistic:
    """A ridge logistic model over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 3.0) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1).astype(float)
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-5:
                break
        return cls(mean, scale, w)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        return np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)


@dataclass
class Model:
    """Both views, and the curve over their calibrated log-odds."""

    views: tuple[Logistic, Logistic] | None = None
    curves: tuple[Logistic, Logistic] | None = None
    both: Logistic | None = None

    def probability(self, content: np.ndarray, page: np.ndarray) -> np.ndarray:
        if self.views is None:
            return np.ones(len(content))
        odds = np.stack([c.margin(v.margin(x)[:, None]) for v, c, x in zip(self.views, self.curves, (content, page))], axis=1)
        return 1 / (1 + np.exp(-self.both.margin(odds)))


def calibrated(views: tuple[Logistic, Logistic], x: tuple[np.ndarray, np.ndarray], y: np.ndarray) -> Model:
    """The views with curves and weights fitted to rows that they were not trained on."""
    margins = [v.margin(f) for v, f in zip(views, x)]
    curves = tuple(Logistic.fit(m[:, None], y, 0.1) for m in margins)
    odds = np.stack([c.margin(m[:, None]) for c, m in zip(curves, margins)], axis=1)
    return Model(views, curves, Logistic.fit(odds, y, 0.1))


def co_train(content: np.ndarray, page: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Fit on rows whose label is 0, 1, or -1 for unlabelled. One labelled row in three is kept for calibration."""
    labelled = np.flatnonzero(label >= 0)
    kept, train = labelled[::3], np.setdiff1d(labelled, labelled[::3])
    if any(len(np.unique(label[x])) < 2 for x in (kept, train)):
        return Model()
    x = (content, page)
    y = label[kept].astype(float)
    halves = [(np.arange(len(kept)) % 2 == k) for k in (0, 1)]
    judged = all(len(np.unique(y[h])) == 2 for h in halves)

    def loss(views: tuple[Logistic, Logistic]) -> float:
        total = 0.0
        for fit_on, test_on in (halves, halves[::-1]):
            p = calibrated(views, tuple(f[kept[fit_on]] for f in x), y[fit_on]).probability(*(f[kept[test_on]] for f in x))
            total -= np.log(np.clip(np.where(y[test_on] > 0, p, 1 - p), 1e-6, 1)).sum()
        return total

    given = [{int(i): int(label[i]) for i in train} for _ in x]
    share, best = label[train].mean(), (np.inf, None)
    open_ = [set(np.flatnonzero(label < 0).tolist()) for _ in x]
    for k in range(rounds + 1):
        views = tuple(Logistic.fit(f[list(g)], np.array(list(g.values()), float)) for f, g in zip(x, given))
        now = loss(views) if judged else 0.0
        curves = calibrated(views, tuple(f[kept] for f in x), y).curves
        if now < best[0] - GAIN:
            best = (now, views)
        for v in (0, 1):
            rest = np.array(sorted(open_[1 - v]), int)
            if not len(rest):
                continue
            # sure by the curve of the kept documents: a view that tells little is never sure
            margin = curves[v].margin(views[v].margin(x[v][rest])[:, None])
            order = np.argsort(margin, kind="stable")
            many = FIRST << k
            bad, good = max(1, round(many * (1 - share))), max(1, round(many * share))
            sure = [(rest[i], 0) for i in order[:bad] if margin[i] < -SURE] + [(rest[i], 1) for i in order[::-1][:good] if margin[i] > SURE]
            for i, mark in sure:
                given[1 - v][int(i)] = mark
                open_[1 - v].discard(int(i))
    return calibrated(best[1], tuple(f[kept] for f in x), y)


def picked(docs: DataFrame) -> DataFrame:
    """The columns that the views read; metadata that a table lacks is null."""
    have = {c.lower() for c in docs.columns}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in META.items()])


def views_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = raw(batch, "text")
    meta = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in META]
    return np.stack([content_features(x) for x in texts]), np.stack([page_features(*r) for r in zip(*meta)])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> Model:
    """Fit on ``docs(doc_id, text[, lang, source, n_chars])`` with ``labels(doc_id, quality)``."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    draw = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    known = draw(ids.join(marks, "doc_id"), labelled)
    other = draw(ids.join(marks, "doc_id", "left_anti"), unlabelled).select("doc_id", F.lit(-1).alias("label"))
    # at most labelled + unlabelled ids
    sample = picked(docs).join(F.broadcast(known.select("doc_id", (F.col("label") > 0).cast("int").alias("label")).union(other)), "doc_id")

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = views_of(batch)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in b], pa.binary()), batch.column(batch.num_columns - 1)], names=["doc_id", "content", "page", "label"])

    # one row of each id, however often it is repeated: the driver gets as many rows as ids were drawn
    found = map_arrow(sample, features, "doc_id long, content binary, page binary, label int", rows=256)
    single = found.groupBy("doc_id").agg(F.min(F.struct("content", "page", "label")).alias("row")).select("doc_id", "row.*")
    rows = sorted(single.collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.content))
    if not rows:
        return Model()
    read = lambda name: np.stack([np.frombuffer(r[name], np.float32) for r in rows])
    return co_train(read("content"), read("page"), np.array([r.label for r in rows]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, kept`` for every row; ``score`` is the probability of quality."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.probability(*views_of(batch)).astype(float)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "score", "kept"])

    return map_arrow(picked(docs), run, "doc_id long, score double, kept boolean", rows=256)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns kept."""
    return filter_arrow(docs, {"text": "string", **META}, lambda batch: (model.probability(*views_of(batch)) >= threshold).tolist(), rows=256)
