"""Small gradient-boosted trees whose model is a SQL expression.

Trees of depth two are fitted to a few hundred labelled rows on the driver, with the logistic loss;
they are applied by Spark as sums of CASE expressions.  Scores are calibrated on rows that the trees
haven't seen, by isotonic regression, and the threshold is the least score whose calibrated
probability reaches the wanted precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Node:
    """A leaf where ``feature`` is negative."""

    feature: int
    cut: float
    left: Node | None
    right: Node | None
    value: float


def _leaf(g: np.ndarray, h: np.ndarray, penalty: float) -> Node:
    return Node(-1, 0.0, None, None, float(g.sum() / (h.sum() + penalty)))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, penalty: float, least: int) -> Node:
    best, at = 1e-9, None
    whole = g.sum() ** 2 / (h.sum() + penalty)
    for f in range(x.shape[1] if depth else 0):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            if least <= left.sum() <= len(x) - least:
                gain = g[left].sum() ** 2 / (h[left].sum() + penalty) + g[~left].sum() ** 2 / (h[~left].sum() + penalty) - whole
                if gain > best:
                    best, at = gain, (f, float(cut), left)
    if at is None:
        return _leaf(g, h, penalty)
    f, cut, left = at
    return Node(f, cut, _grow(x[left], g[left], h[left], depth - 1, penalty, least), _grow(x[~left], g[~left], h[~left], depth - 1, penalty, least), 0.0)


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, _apply(node.left, x), _apply(node.right, x))


@dataclass(frozen=True)
class Boosted:
    trees: tuple[Node, ...]
    rate: float
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.rate * sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def sql(self, names: list[str], row: str) -> str:
        """The raw score as SQL over the fields ``names`` of the struct ``row``."""

        def of(n: Node) -> str:
            if n.feature < 0:
                return f"{n.value!r}D"
            return f"CASE WHEN {row}.{names[n.feature]} <= {n.cut!r}D THEN {of(n.left)} ELSE {of(n.right)} END"

        return f"{self.rate!r}D * (" + " + ".join(of(t) for t in self.trees) + ")"


def isotonic(score: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """(least score, probability) of each pool of adjacent violators, in order of score."""
    pools: list[list[float]] = []
    for s in np.unique(score):
        own = y[score == s]
        pools.append([float(s), float(own.sum()), float(len(own))])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, good, n = pools.pop()
            pools[-1][1] += good
            pools[-1][2] += n
    return [(s, good / n) for s, good, n in pools]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, rate: float = 0.3, depth: int = 2, precision: float = 0.95) -> Boosted:
    """Boosted trees on every row but each third, which calibrate the threshold."""
    held = np.arange(len(y)) % 3 == 2
    xt, yt, f, grown = x[~held], y[~held].astype(float), np.zeros(int((~held).sum())), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        tree = _grow(xt, yt - p, p * (1 - p), depth, 1.0, 3)
        grown.append(tree)
        f += rate * _apply(tree, xt)
    model = Boosted(tuple(grown), rate, 0.0)
    pools = isotonic(model.raw(x[held]), y[held].astype(float))
    return Boosted(model.trees, rate, next((s for s, p in pools if p >= precision), float("inf")))
