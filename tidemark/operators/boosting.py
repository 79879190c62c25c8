"""Boosted trees of one series' training rows, in numpy, grown leaf by leaf on histograms, and their exact Shapley values.  Nothing here knows Spark."""

from __future__ import annotations

import math

import numpy as np

#: Columns of a tree's nodes; a leaf's feature is -1.  Rows go left where x <= threshold.
NODE = ("tree", "node", "feature", "threshold", "left", "right", "value", "cover", "gain")
BINS = 255


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _log_odds(y) -> float:
    p = min(max(float(np.mean(y)), 1e-15), 1 - 1e-15)
    return math.log(p / (1 - p))


def _edges(column):
    """Upper ends of the bins but the last: between neighbouring values, at quantiles where there are too many."""
    values = np.unique(column)
    if len(values) > BINS:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="lower"))
    return (values[:-1] + values[1:]) / 2


def _best(hist, least: int):
    """(gain, feature, bin) of the best split of a leaf; hist: (3, features, bins) of rows, slopes and curvatures."""
    left = hist.cumsum(2)
    whole = left[:, :, -1:]
    right = whole - left
    ok = (left[0] >= least) & (right[0] >= least) & (left[2] > 1e-3) & (right[2] > 1e-3)
    if not ok.any():
        return 0.0, -1, -1
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, left[1] ** 2 / left[2] + right[1] ** 2 / right[2] - whole[1] ** 2 / whole[2], -np.inf)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def _grow(codes, rows, slope, curve, used, leaves: int, least: int):
    """One tree over the given rows and features, the leaf of the largest gain split first: lists (feature, bin, left, right, rows, gain)
    and the slope and curvature sums of each node."""
    flat = codes[:, used].astype(np.int64) + np.arange(len(used)) * (BINS + 1)
    shape, size = (len(used), BINS + 1), len(used) * (BINS + 1)

    def histogram(r):
        cells = flat[r].ravel()
        weigh = lambda v: np.bincount(cells, np.repeat(v[r], len(used)), size).reshape(shape)
        return np.stack([np.bincount(cells, minlength=size).reshape(shape).astype(float), weigh(slope), weigh(curve)])

    nodes, sums = [[-1, 0, -1, -1, len(rows), 0.0]], [(slope[rows].sum(), curve[rows].sum())]
    first = histogram(rows)
    open_ = {0: (rows, first, _best(first, least))}
    for _ in range(leaves - 1):
        at = max(open_, key=lambda k: open_[k][2][0])
        r, hist, (gain, f, b) = open_.pop(at)
        if f < 0 or gain <= 1e-12:
            break
        low = codes[r, used[f]] <= b
        parts = [r[low], r[~low]]
        small = 0 if len(parts[0]) <= len(parts[1]) else 1
        hists = [None, None]
        hists[small] = histogram(parts[small])
        hists[1 - small] = hist - hists[small]
        nodes[at][:4], nodes[at][5] = [int(used[f]), b, len(nodes), len(nodes) + 1], gain
        for part, h in zip(parts, hists, strict=True):
            open_[len(nodes)] = (part, h, _best(h, least))
            nodes.append([-1, 0, -1, -1, len(part), 0.0])
            sums.append((slope[part].sum(), curve[part].sum()))
    return nodes, sums


def _leaf_of(x, feature, threshold, left, right):
    """The leaf that each row of x falls into."""
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return at
        n = at[inner]
        at[inner] = np.where(x[inner, feature[n]] <= threshold[n], left[n], right[n])


def boost(x, y, rounds: int = 400, rate: float = 0.05, leaves: int = 31, least: int = 100, rows: float = 0.8, columns: float = 0.8, seed: int = 42) -> dict:
    """Trees of the log loss as arrays by NODE; tree -1 is the log-odds that they start from.  Each round sees a share of
    the rows and columns, drawn by the seed.  A series of one class, or too short to split, keeps its start alone."""
    start = _log_odds(y)
    out = {k: [v] for k, v in zip(NODE, (-1, 0, -1, 0.0, -1, -1, start, float(len(y)), 0.0), strict=True)}
    edges = [_edges(x[:, j]) for j in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8)
    draw = np.random.default_rng(seed)
    take, wide = max(1, int(round(rows * len(y)))), max(1, int(round(columns * x.shape[1])))
    f, one_class = np.full(len(y), start), y.min() == y.max()
    for t in range(0 if one_class else rounds):
        p = sigmoid(f)
        bag = np.sort(draw.choice(len(y), take, replace=False))
        used = np.sort(draw.choice(x.shape[1], wide, replace=False))
        nodes, sums = _grow(codes, bag, p - y, p * (1 - p), used, leaves, least)
        if len(nodes) == 1:
            continue
        feature, bins, left, right, cover, gain = (np.array(v) for v in zip(*nodes, strict=True))
        value = np.array([0.0 if k >= 0 else -rate * s / max(c, 1e-12) for k, (s, c) in zip(feature, sums, strict=True)])
        f += value[_leaf_of(codes, feature, bins, left, right)]
        cut = [float(edges[k][b]) if k >= 0 else 0.0 for k, b in zip(feature, bins, strict=True)]
        for k, v in zip(NODE, ([t] * len(nodes), range(len(nodes)), feature, cut, left, right, value, cover.astype(float), gain), strict=True):
            out[k].extend(v)
    return {k: np.array(v) for k, v in out.items()}


def trees(nodes: dict) -> tuple[float, list[dict]]:
    """The start, and each tree's arrays in node order."""
    order = np.lexsort((nodes["node"], nodes["tree"]))
    table = {k: np.asarray(nodes[k])[order] for k in NODE}
    ends = np.flatnonzero(np.diff(table["tree"], append=np.iinfo(np.int32).max))
    cut = [{k: v[a:b] for k, v in table.items()} for a, b in zip([0, *(ends[:-1] + 1)], ends + 1, strict=True)]
    return float(cut[0]["value"][0]), cut[1:]


def log_odds(nodes: dict, x):
    """The trees' sum for each row of x."""
    start, found = trees(nodes)
    out = np.full(len(x), start)
    for t in found:
        out += t["value"][_leaf_of(x, t["feature"], t["threshold"], t["left"], t["right"])]
    return out


def _paths(tree: dict):
    """(value, {feature: (share of cover, lower, upper)}) of each leaf: a row is sent along a feature's splits if lower < x <= upper."""
    found, todo = [], [(0, {})]
    while todo:
        at, path = todo.pop()
        f = int(tree["feature"][at])
        if f < 0:
            found.append((float(tree["value"][at]), path))
            continue
        share, low, high = path.get(f, (1.0, -math.inf, math.inf))
        cut, whole = float(tree["threshold"][at]), tree["cover"][at]
        for child, lower, upper in ((int(tree["left"][at]), low, min(high, cut)), (int(tree["right"][at]), max(low, cut), high)):
            todo.append((child, {**path, f: (share * float(tree["cover"][child] / whole), lower, upper)}))
    return found


def shapley(tree: dict, x):
    """Exact Shapley values of a tree for all rows of x, (rows, features), and its mean output: a feature outside the
    known set sends a row both ways by cover.

    A leaf's value is a product over the features on its path, so what a feature adds is a sum over the sizes of known sets,
    whose weights are the coefficients of the other features' product (z + o t)."""
    phi, mean = np.zeros(x.shape), 0.0
    for value, path in _paths(tree):
        d = len(path)
        mean += value * math.prod(z for z, _, _ in path.values())
        on = {f: ((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, (_, low, high) in path.items()}
        weights = [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]
        for f in path:
            poly = np.zeros((d, len(x)))
            poly[0] = 1.0
            for j, other in enumerate(g for g in path if g != f):
                z = path[other][0]
                poly[1 : j + 2] = poly[1 : j + 2] * z + poly[: j + 1] * on[other]
                poly[0] *= z
            phi[:, f] += value * (on[f] - path[f][0]) * (np.array(weights) @ poly)
    return phi, mean
