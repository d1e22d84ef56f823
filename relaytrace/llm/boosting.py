"""Small gradient-boosted trees: fitted on a bounded sample in numpy, applied as
a SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Split:
    feature: int
    at: float
    low: Split | float
    high: Split | float


@dataclass
class Boosted:
    """Sum of trees (log odds); ``threshold`` is calibrated on held-out rows."""

    start: float
    trees: list[Split | float]
    threshold: float = float("inf")

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += _apply(t, x)
        return out

    def column(self, features: list[Column]) -> Column:
        total = F.lit(self.start)
        for t in self.trees:
            total = total + _expression(t, features)
        return total


def _apply(t: Split | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(t, Split):
        return np.full(len(x), t)
    return np.where(x[:, t.feature] <= t.at, _apply(t.low, x), _apply(t.high, x))


def _expression(t: Split | float, features: list[Column]) -> Column:
    if not isinstance(t, Split):
        return F.lit(float(t))
    return F.when(features[t.feature] <= F.lit(float(t.at)), _expression(t.low, features)).otherwise(_expression(t.high, features))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, rate: float, reg: float = 1.0) -> Split | float:
    leaf = rate * float(g.sum() / (h.sum() + reg))
    if depth == 0 or len(x) < 10:
        return leaf
    best, whole = (1e-6, None), g.sum() ** 2 / (h.sum() + reg)
    for f, at in enumerate(cuts):
        for c in at:
            low = x[:, f] <= c
            gl, hl = g[low].sum(), h[low].sum()
            gain = gl ** 2 / (hl + reg) + (g.sum() - gl) ** 2 / (h.sum() - hl + reg) - whole
            if gain > best[0] and 5 <= low.sum() <= len(x) - 5:
                best = (gain, (f, float(c)))
    if best[1] is None:
        return leaf
    f, c = best[1]
    low = x[:, f] <= c
    return Split(f, c, _grow(x[low], g[low], h[low], cuts, depth - 1, rate, reg), _grow(x[~low], g[~low], h[~low], cuts, depth - 1, rate, reg))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, precision: float = 0.97, least: int = 20) -> Boosted:
    """Boost on every other row, calibrate on the rest: the threshold is the
    lowest score above which held-out precision stays at ``precision`` over
    ``least`` rows or more (infinite if none is)."""
    fit_on = np.arange(len(x)) % 2 == 0
    xf, yf = x[fit_on], y[fit_on].astype(float)
    if len(xf) < 2 * least or yf.min() == yf.max():
        return Boosted(0.0, [])
    cuts = [np.unique(np.quantile(xf[:, f], np.linspace(0, 1, 17), method="lower"))[:-1] for f in range(x.shape[1])]
    p = yf.mean()
    model = Boosted(float(np.log(p / (1 - p))), [])
    raw = np.full(len(xf), model.start)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        t = _grow(xf, yf - prob, prob * (1 - prob), cuts, depth, rate)
        model.trees.append(t)
        raw += _apply(t, xf)
    s, held = model.score(x[~fit_on]), y[~fit_on]
    for c in np.unique(s)[::-1]:
        on = s >= c
        if held[on].mean() < precision and on.sum() >= least:
            break
        if on.sum() >= least and held[on].mean() >= precision:
            model.threshold = float(c)
    return model
