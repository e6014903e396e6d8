"""Gradient boosting of small symmetric trees, and calibration of its scores."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS, DEPTH, ROUNDS, RATE, LAMBDA = 16, 3, 60, 0.2, 1.0


@dataclass
class Boosted:
    """Trees of DEPTH questions (feature, cut) with a value per answer pattern,
    and a slope and offset that turn sums into probabilities."""

    base: float = 0.0
    trees: list = field(default_factory=list)
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for questions, values in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for f, cut in questions:
                leaf = leaf * 2 + (x[:, f] > cut)
            total += values[leaf]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.offset, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Boost on logistic loss; one class alone gives a constant."""
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1e-3
    model = Boosted(base=float(np.log(p / (1 - p))))
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        prob = 1 / (1 + np.exp(-total))
        g, h = y - prob, prob * (1 - prob)
        leaf, questions = np.zeros(len(y), np.int64), []
        for depth in range(DEPTH):
            best = (0.0, None)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                cell, shape = leaf * BINS + binned[f], (1 << depth, BINS)
                gs = np.bincount(cell, g, shape[0] * BINS).reshape(shape).cumsum(1)
                hs = np.bincount(cell, h, shape[0] * BINS).reshape(shape).cumsum(1)
                gain = (gs ** 2 / (hs + LAMBDA) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + LAMBDA)).sum(0)[:len(c)]
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), (f, k))
            if best[1] is None:
                break
            f, k = best[1]
            questions.append((f, float(cuts[f][k])))
            leaf = leaf * 2 + (binned[f] > k)
        n = 1 << len(questions)
        values = RATE * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + LAMBDA)
        model.trees.append((questions, values))
        total += values[leaf]
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling on rows that the trees haven't seen."""
    if not len(y) or y.min() == y.max():
        return
    raw, n1 = model.raw(x), y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        r = t - p
        haa, hab, hbb = (w * raw * raw).sum() + 1e-6, (w * raw).sum(), w.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * (r * raw).sum() - hab * r.sum()) / det, (haa * r.sum() - hab * (r * raw).sum()) / det
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    if a > 0:
        model.slope, model.offset = a, b


def least_score(scores: np.ndarray, y: np.ndarray, precision: float, fewest: int = 20) -> float:
    """The least threshold at which, and above which throughout, precision holds; above 1 if none or too few rows."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1) if len(y) else np.zeros(0)
    ok = np.flatnonzero((right >= precision) & (np.arange(1, len(y) + 1) >= fewest))
    return float(scores[order][ok[-1]]) if len(ok) else 1.1


def between(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """``least_score``, moved half way to the next lower score: what lies between was never refuted."""
    least = least_score(scores, y, precision)
    below = scores[scores < least]
    return (least + float(below.max())) / 2 if least <= 1 and len(below) else least
