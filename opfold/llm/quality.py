"""Text quality by a generalised additive model with pairwise interactions.

Features of a whole text are binned; shallow trees, boosted cyclically over the
features one after the other, write their leaf values into one look-up table
per feature. Then the pairs of features whose residuals profit most get tables
over two coarser binnings, boosted the same way. A score is the logistic of the
sum of table entries: vectorised additions by bin, explainable entry by entry.

Learning takes at most ``rows`` documents of each label (parameter); only their
feature vectors reach the driver. Null and empty texts have features, so they
score as what they are. Without labels of both kinds the score is the share of
label 1 (0 if there are none). Every row gives one row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from opfold.llm.common import LOWER_AND_SPACES, labelled_sample, scored

FOLDS, HELD, THRESHOLD = 5, 0, 0.3
ROWS, BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 10_000, 32, 8, 8, 150, 0.1
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS, SPACES, UPPER = b"0123456789", b" \t\n\v\f\r", bytes(range(65, 91))
REPEATED = re.compile(rb"([^\w\s\x80-\xff])\1+")
FEATURES = ("log_bytes", "log_words", "word_bytes", "letters", "digits", "marks", "upper", "unique", "commonest", "bare", "short", "long", "repeated_marks", "repeated_lines", "words_a_stop", "words_a_line", "mark_kinds")


def features(text: bytes | None) -> tuple[float, ...]:
    """The numbers named in FEATURES, of one whole text."""
    text = text or b""
    n = max(1, len(text))
    words = text.translate(LOWER_AND_SPACES).split()
    m = max(1, len(words))
    counts = Counter(words)
    letters = n - len(text.translate(None, LETTERS)) if text else 0
    digits = len(text) - len(text.translate(None, DIGITS))
    spaces = len(text) - len(text.translate(None, SPACES))
    marks = len(text) - letters - digits - spaces
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    bare = sum(c for w, c in counts.items() if not w.translate(None, DIGITS).strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    repeats = sum(len(x.group()) for x in REPEATED.finditer(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    stops = text.count(b".") + text.count(b"!") + text.count(b"?")
    return (
        np.log1p(len(text)), np.log1p(len(words)), float(sizes.mean()) if len(words) else 0.0, letters / n, digits / n, marks / n, (len(text) - len(text.translate(None, UPPER))) / n,
        len(counts) / m, max(counts.values(), default=0) / m, bare / m, float((sizes <= 3).mean()) if len(words) else 0.0, float((sizes >= 12).mean()) if len(words) else 0.0,
        repeats / n, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(m / (1 + stops)), np.log1p(m / max(1, len(lines))), float(len(set(text.translate(None, LETTERS + DIGITS + SPACES)))),
    )


def best_cuts(slope: np.ndarray, weight: np.ndarray, splits: int, ridge: float) -> np.ndarray:
    """A shallow tree over ordered bins: leaf values by bin, after up to ``splits`` greedy splits."""
    leaves = [(0, len(slope))]
    cs, cw = np.concatenate([[0], np.cumsum(slope)]), np.concatenate([[0], np.cumsum(weight)])
    for _ in range(splits):
        best = (1e-12, None, None)
        for k, (a, b) in enumerate(leaves):
            at = np.arange(a + 1, b)
            if not len(at):
                continue
            left, wl, right, wr = cs[at] - cs[a], cw[at] - cw[a], cs[b] - cs[at], cw[b] - cw[at]
            gain = left**2 / (wl + ridge) + right**2 / (wr + ridge) - (cs[b] - cs[a]) ** 2 / (cw[b] - cw[a] + ridge)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), k, int(at[i]))
        if best[1] is None:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(slope))
    for a, b in leaves:
        out[a:b] = (cs[b] - cs[a]) / (cw[b] - cw[a] + ridge)
    return out


def best_quadrants(slope: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """A tree of one cut on each of two features: its gain and its values over the grid of bins."""
    n, m = slope.shape
    s, w = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1))
    s[1:, 1:], w[1:, 1:] = slope.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    best = (-1.0, np.zeros((n, m)))
    for i in range(1, n):
        j = np.arange(1, m)
        parts = [(s[i, j], w[i, j]), (s[i, m] - s[i, j], w[i, m] - w[i, j]), (s[n, j] - s[i, j], w[n, j] - w[i, j]), (s[n, m] - s[i, m] - s[n, j] + s[i, j], w[n, m] - w[i, m] - w[n, j] + w[i, j])]
        gain = sum(a * a / (b + ridge) for a, b in parts)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            value = [a[k] / (b[k] + ridge) for a, b in parts]
            grid = np.empty((n, m))
            grid[:i, : k + 1], grid[:i, k + 1 :], grid[i:, : k + 1], grid[i:, k + 1 :] = value
            best = (float(gain[k]), grid)
    return best


class Model:
    """Bin edges and look-up tables."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, share: float, rounds: int = ROUNDS, rate: float = RATE):
        self.share, self.edges, self.tables, self.pairs = share, [], [], []
        if not len(y) or y.min() == y.max():
            return
        weight = weight / weight.mean()
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = self.bins(x)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.constant = float(np.log(np.average(y, weights=weight) / (1 - np.average(y, weights=weight))))
        total = np.full(len(y), self.constant)

        def residual() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)

        ridge = 1.0
        for _ in range(rounds):
            for f, table in enumerate(self.tables):
                g, h = residual()
                step = rate * best_cuts(np.bincount(bins[f], g, len(table)), np.bincount(bins[f], h, len(table)), 3, ridge)
                table += step
                total += step[bins[f]]
        coarse = [np.minimum(b * PAIR_BINS // (len(e) + 1), PAIR_BINS - 1) for b, e in zip(bins, self.edges, strict=True)]
        g, h = residual()

        def grids(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            cell = coarse[a] * PAIR_BINS + coarse[b]
            return np.bincount(cell, g, PAIR_BINS**2).reshape(PAIR_BINS, -1), np.bincount(cell, h, PAIR_BINS**2).reshape(PAIR_BINS, -1)

        ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -best_quadrants(*grids(*p, g, h), ridge)[0])[:PAIRS]
        self.pairs = [(a, b, np.zeros((PAIR_BINS, PAIR_BINS))) for a, b in ranked]
        for _ in range(rounds // 3):
            for a, b, table in self.pairs:
                g, h = residual()
                step = rate * best_quadrants(*grids(a, b, g, h), ridge)[1]
                table += step
                total += step[coarse[a], coarse[b]]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)]

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not self.tables:
            return np.full(len(texts), self.share)
        bins = self.bins(np.array([features(t) for t in texts]).reshape(len(texts), -1))
        total = self.constant + sum(t[b] for t, b in zip(self.tables, bins, strict=True))
        coarse = [np.minimum(b * PAIR_BINS // (len(e) + 1), PAIR_BINS - 1) for b, e in zip(bins, self.edges, strict=True)]
        for a, b, table in self.pairs:
            total = total + table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held: int = HELD, rows: int = ROWS) -> Model:
    sample, counts = labelled_sample(docs, labels, label, folds, held, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in pc.cast(batch.column(2), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(map(float, f)) for f in found], pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = sorted(sample.mapInArrow(run, "doc_id long, label int, x array<double>").toLocalIterator(), key=lambda r: r.doc_id)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    y = np.array([r.label for r in got], float)
    mean = y.mean() if len(y) else 0.0
    weight = np.where(y == 1, share / mean, (1 - share) / (1 - mean)) if 0 < mean < 1 else np.ones(len(y))
    return Model(np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), y, weight, share)


def scores_of(spark, model: Model):
    """A function of texts for the workers."""
    shared = spark.sparkContext.broadcast(model)
    return lambda texts: shared.value.scores(texts)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score (0 to 1) of every document."""
    return scored(docs, scores_of(docs.sparkSession, learn(docs, labels)))
