"""Small gradient-boosted trees with histogram splits. Histograms may be summed over tasks, so that all rows are fitted where they lie."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Boosted:
    """Trees of one depth as arrays (tree, node): feature and cut of inner nodes, value of leaves."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the rows of ``x``."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out


def bin_rows(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Number of cuts below each value; a row lies above cut j of a feature if its number is greater than j."""
    return np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]).astype(np.uint8)


def empty(trees: int, depth: int) -> Boosted:
    """Trees without splits, cuts as places in bins."""
    inner = 2**depth - 1
    return Boosted(np.zeros((trees, inner), np.int64), np.full((trees, inner), BINS, np.int64), np.zeros((trees, inner + 1)), 0.0)


def histograms(model: Boosted, t: int, level: int, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, many: np.ndarray, unit: float = 0.0) -> np.ndarray:
    """(3, nodes, features, BINS): sums of gradient, hessian and ``many`` over rows at the nodes of a level of tree ``t``.

    ``model`` holds places in bins. With ``unit`` each row's values are whole numbers of it, so sums don't depend on their order.
    """
    n, wide = bins.shape
    p = 1 / (1 + np.exp(-Boosted(model.feature[:t], model.cut[:t], model.leaf[:t], model.start).score(bins)))
    node = np.zeros(n, np.int64)
    for _ in range(level):
        node = 2 * node + 1 + (bins[np.arange(n), model.feature[t, node]] > model.cut[t, node])
    node -= 2**level - 1
    at = ((node[:, None] * wide + np.arange(wide)) * BINS + bins).ravel()
    values = [weight * (y - p), weight * p * (1 - p), many]
    if unit:
        values = [np.rint(v / unit) for v in values]
    size = 2**level * wide * BINS
    return np.stack([np.bincount(at, np.repeat(v, wide), size) for v in values]).reshape(3, 2**level, wide, BINS)


def split(sums: np.ndarray, cuts: list[np.ndarray], ridge: float, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the feature and place of the best cut (BINS: none) and the ratio of gradient to hessian on both sides."""
    g, h, many = sums.cumsum(3)
    rest = lambda a: a[..., -1:] - a[..., :-1]
    gain = g[..., :-1] ** 2 / (h[..., :-1] + ridge) + rest(g) ** 2 / (rest(h) + ridge) - g[..., -1:] ** 2 / (h[..., -1:] + ridge)
    there = np.arange(BINS - 1) < np.array([len(c) for c in cuts])[:, None]
    gain = np.where(there & (np.minimum(many[..., :-1], rest(many)) >= low), gain, -np.inf).reshape(len(g), -1)
    best = gain.max(1)
    at = (gain >= best[:, None] - 1e-9).argmax(1)
    feature, place = np.where(best > 1e-9, at // (BINS - 1), 0), np.where(best > 1e-9, at % (BINS - 1), BINS)
    left = np.minimum(place, BINS - 1)
    ratio = []
    for i, (f, k) in enumerate(zip(feature, left)):
        ratio.append([g[i, f, k] / (h[i, f, k] + ridge), (g[i, f, -1] - g[i, f, k]) / (h[i, f, -1] - h[i, f, k] + ridge)])
    return feature, place, np.array(ratio)


def grow(sums, cuts: dict, rows: dict, trees: int = 40, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: float = 0.01) -> dict[object, Boosted]:
    """Second-order trees, one model for each key of ``cuts``, all at the same time; cuts are places in bins.

    ``sums(models, t, level)`` gives ``histograms`` over all rows by key; each side of a split keeps the share ``least`` of ``rows``.
    Ties of gains: the first feature and cut.
    """
    models = {k: empty(trees, depth) for k in cuts}
    for t in range(trees):
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            for k, found in sums(models, t, level).items():
                feature, place, ratio = split(found, cuts[k], ridge, least * rows[k])
                models[k].feature[t, first : first + nodes], models[k].cut[t, first : first + nodes] = feature, place
                if level == depth - 1:
                    models[k].leaf[t] = rate * ratio.ravel()
    return models


def on_values(model: Boosted, cuts: list[np.ndarray]) -> Boosted:
    """The same trees with values for cuts instead of places in bins."""
    value = [[cuts[f][k] if k < BINS else np.inf for f, k in zip(fs, ks)] for fs, ks in zip(model.feature, model.cut)]
    return Boosted(model.feature, np.array(value, float).reshape(model.cut.shape), model.leaf, model.start)


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, **how) -> Boosted:
    """Logistic loss on rows at hand; both classes weigh alike, rows of a class as ``times`` says. ``how``: see ``grow``."""
    n, wide = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1], method="lower")) for f in range(wide)]
    bins = bin_rows(x, cuts)
    times = np.ones(n) if times is None else times
    weight = times * np.where(y == 1, n / (2.0 * max(1e-9, times[y == 1].sum())), n / (2.0 * max(1e-9, times[y == 0].sum())))
    sums = lambda models, t, level: {0: histograms(models[0], t, level, bins, y, weight, np.ones(n))}
    return on_values(grow(sums, {0: cuts}, {0: n}, **how)[0], cuts)


def calibrate(score: np.ndarray, y: np.ndarray, sure: float, astray: float, weight: np.ndarray | None = None) -> float:
    """The least score whose calibrated share of ones is ``sure`` or more and that at most ``astray`` of the zeros reach; infinite without one.

    Shares are calibrated by pooling neighbours in score order until they rise. A row counts as ``weight`` says.
    """
    weight = np.ones(len(score)) if weight is None else weight
    values, at = np.unique(score, return_inverse=True)
    pools = []
    for ones, many, v in zip(np.bincount(at, weight * (y == 1)), np.bincount(at, weight), values):
        pools.append([float(ones), float(many), float(v)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            ones, many, _ = pools.pop()
            pools[-1][0] += ones
            pools[-1][1] += many
    zeros, score = weight[y == 0], score[y == 0]
    for ones, many, low in pools:
        if ones >= sure * many and zeros[score >= low].sum() <= astray * zeros.sum():
            return low
    return float("inf")
