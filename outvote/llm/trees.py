"""Gradient-boosted trees over a bounded sample, kept as flat node arrays.

Logistic loss, histogram splits, monotonic constraints. A tree is a full binary one of fixed depth:
node k has children 2k+1 and 2k+2, so a forest is three arrays (feature, threshold, value), and
scoring walks all rows down one level at a time.
"""

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray  # trees x inner nodes; -1: no split, go left
    threshold: np.ndarray  # left if value <= threshold
    value: np.ndarray  # trees x leaves
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while inner and at[0:1].size and at[0] < inner:
                f = feature[at]
                right = (f >= 0) & (x[rows, np.maximum(f, 0)] > threshold[at])
                at = 2 * at + 1 + right
            out += value[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x, y, trees=40, depth=3, rate=0.3, bins=32, penalty=1.0, least=5, signs=None) -> Forest:
    """``signs`` has -1, 0 or 1 a feature: the score may not rise, has no rule, may not fall with it.

    A constrained split is taken only if the children's values are in order, and both subtrees are
    kept on their side of the middle, so the whole model is monotone. Without both labels the
    forest is empty and scores the only label (1 without any).
    """
    n, m = x.shape
    signs = np.zeros(m, int) if signs is None else np.asarray(signs)
    inner, leaves = 2**depth - 1, 2**depth
    mean = y.mean() if n else 1.0
    start = float(np.log(np.clip(mean, 1e-3, 1 - 1e-3) / np.clip(1 - mean, 1e-3, 1 - 1e-3)))
    made = Forest(np.full((0, inner), -1), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    if not n or y.min() == y.max():
        return made
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    coded = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(n, start)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.full(inner, -1), np.zeros(inner)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        at = np.zeros(n, np.int64)
        for node in range(inner):
            low[2 * node + 1 : 2 * node + 3], high[2 * node + 1 : 2 * node + 3] = low[node], high[node]
            mine = np.flatnonzero(at == node)
            best = _best_split(coded[mine], g[mine], h[mine], cuts, signs, penalty, least, low[node], high[node])
            right = np.zeros(len(mine), bool)
            if best:
                j, b, left_value, right_value = best
                feature[node], threshold[node] = j, cuts[j][b]
                right = coded[mine, j] > b
                if signs[j]:
                    middle = (left_value + right_value) / 2
                    a, c = (2 * node + 1, 2 * node + 2) if signs[j] > 0 else (2 * node + 2, 2 * node + 1)
                    high[a], low[c] = min(high[a], middle), max(low[c], middle)
            at[mine] = 2 * node + 1 + right
        leaf = at - inner
        value = np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + penalty)
        value = rate * np.clip(value, low[inner:], high[inner:])
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), start)


def _best_split(coded, g, h, cuts, signs, penalty, least, low, high):
    best, gain_best = None, 1e-6
    total_g, total_h, n = g.sum(), h.sum(), len(g)
    for j, cut in enumerate(cuts):
        if not len(cut) or n < 2 * least:
            continue
        size = len(cut) + 1
        lg, lh = np.cumsum(np.bincount(coded[:, j], g, size))[:-1], np.cumsum(np.bincount(coded[:, j], h, size))[:-1]
        ln = np.cumsum(np.bincount(coded[:, j], minlength=size))[:-1]
        rg, rh = total_g - lg, total_h - lh
        left, right = np.clip(lg / (lh + penalty), low, high), np.clip(rg / (rh + penalty), low, high)
        gain = lg * left - (lh + penalty) * left**2 / 2 + rg * right - (rh + penalty) * right**2 / 2 - total_g**2 / (total_h + penalty) / 2
        gain[(ln < least) | (n - ln < least) | (signs[j] * (right - left) < 0)] = -np.inf
        b = int(np.argmax(gain))
        if gain[b] > gain_best:
            gain_best, best = gain[b], (j, b, left[b], right[b])
    return best
