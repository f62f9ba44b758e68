"""Regression trees on a table of cells, grown a level at a time from sums that the tasks make.

A cell stands for all rows whose features fall into the same bins: their number,
the mean of their labels and the sum of squares around it. Rows of one cell go
the same way in every tree that splits at the bins' bounds, so for squared error
a tree of the cells is the tree of the rows, however many rows there are.

Splits are chosen as MLlib's regression trees choose them: the largest drop of
the variance, the first of equals, no child without a row; a node ends when it
can't gain, is pure or lies at the full depth, and two leaves of one prediction
become one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_PURE = float(np.finfo(float).eps)
#: Trees whose draws of a row share one word.
WORD = 62


@dataclass
class Cells:
    """Some of the cells: bins (a row each), training rows, mean, squares, the same of validation, and the prediction so far."""
    bins: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    squares: np.ndarray
    judged_n: np.ndarray
    judged_mean: np.ndarray
    judged_squares: np.ndarray
    margin: np.ndarray


@dataclass
class Rows:
    """Some of the training rows: bins (a row each), label, trees that draw the row (bits of 62 trees a word) and the prediction so far."""
    bins: np.ndarray
    label: np.ndarray
    drawn: np.ndarray
    margin: np.ndarray


@dataclass
class Tree:
    """Nodes as lists; a leaf has the left child -1. ``bin``: cells up to it go to the left."""
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    stats: list[tuple[float, float, float]] = field(default_factory=list)      # rows, sum, sum of squares

    def add(self, stats) -> int:
        self.feature.append(0)
        self.bin.append(0)
        self.left.append(-1)
        self.right.append(-1)
        self.gain.append(-1.0)
        self.stats.append(tuple(float(s) for s in stats))
        return len(self.left) - 1

    def prediction(self, node: int) -> float:
        n, s, _ = self.stats[node]
        return s / n if n else 0.0

    def impurity(self, node: int) -> float:
        return float(variance(np.array(self.stats[node])))

    def routes(self) -> tuple[np.ndarray, ...]:
        """What a task needs to send cells down the tree."""
        return (np.array(self.feature), np.array(self.bin), np.array(self.left), np.array(self.right),
                np.array([self.prediction(k) for k in range(len(self.left))]))


def variance(stats: np.ndarray) -> np.ndarray:
    n, s, q = stats[..., 0], stats[..., 1], stats[..., 2]
    some = np.maximum(n, 1.0)
    return np.where(n > 0, (q - s * s / some) / some, 0.0)


def reached(bins: np.ndarray, routes: tuple) -> np.ndarray:
    """The node in which each cell ends."""
    feature, at_most, left, right, _ = routes
    node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while True:
        inner = left[node] >= 0
        if not inner.any():
            return node
        to_left = bins[rows, feature[node]] <= at_most[node]
        node = np.where(inner, np.where(to_left, left[node], right[node]), node)


def margins(cells: Cells | Rows, block: list[tuple], step: float) -> np.ndarray:
    margin = cells.margin
    for routes in block:
        margin = margin + step * routes[4][reached(cells.bins, routes)]
    return margin


def sums(cells: Cells, block: list[tuple], step: float, routes: tuple | None, open_nodes: list[int], most_bins: int) -> np.ndarray:
    """[feature, open node, bin, (rows, sum, sum of squares)] of the residuals of these cells."""
    residual = cells.mean - margins(cells, block, step)
    place = np.zeros(len(cells.n), dtype=np.int64)
    if routes is not None:
        places = np.full(len(routes[0]), -1, dtype=np.int64)
        places[open_nodes] = np.arange(len(open_nodes))
        place = places[reached(cells.bins, routes)]
    here = (place >= 0) & (cells.n > 0)
    place, n, residual = place[here], cells.n[here], residual[here]
    values = (n, n * residual, cells.squares[here] + n * residual * residual)
    size = len(open_nodes) * most_bins
    out = np.empty((cells.bins.shape[1], len(open_nodes), most_bins, 3))
    for f in range(cells.bins.shape[1]):
        at = place * most_bins + cells.bins[here, f]
        for k, v in enumerate(values):
            out[f, :, :, k] = np.bincount(at, weights=v, minlength=size).reshape(len(open_nodes), most_bins)
    return out


def drawn_sums(rows: Rows, at_tree: int, before: list[tuple], step: float, routes: tuple | None, open_nodes: list[int], most_bins: int) -> np.ndarray:
    """[feature, open node, bin, (rows, sum, sum of squares)] of what the tree is fitted to, of the rows that it draws.

    The first tree is fitted to the labels, the others to the gradient of the squared error, twice the residuals.
    """
    here = np.flatnonzero((rows.drawn[:, at_tree // WORD] >> (at_tree % WORD)) & 1)
    bins, label = rows.bins[here], rows.label[here]
    if at_tree:
        label = 2.0 * (label - margins(Rows(bins, label, rows.drawn[:0], rows.margin[here]), before, step))
    place = np.zeros(len(here), dtype=np.int64)
    if routes is not None:
        places = np.full(len(routes[0]), -1, dtype=np.int64)
        places[open_nodes] = np.arange(len(open_nodes))
        place = places[reached(bins, routes)]
        bins, label, place = bins[place >= 0], label[place >= 0], place[place >= 0]
    squares = label * label
    size = len(open_nodes) * most_bins
    out = np.empty((bins.shape[1], len(open_nodes), most_bins, 3))
    for f in range(bins.shape[1]):
        at = place * most_bins + bins[:, f]
        for k, v in enumerate((None, label, squares)):
            out[f, :, :, k] = np.bincount(at, weights=v, minlength=size).reshape(len(open_nodes), most_bins)
    return out


def judged(cells: Cells, block: list[tuple], step: float) -> np.ndarray:
    """Validation rows, and the sum of their squared errors after each tree of the block."""
    out, margin = [float(cells.judged_n.sum())], cells.margin
    for routes in block:
        margin = margin + step * routes[4][reached(cells.bins, routes)]
        out.append(float((cells.judged_squares + cells.judged_n * (cells.judged_mean - margin) ** 2).sum()))
    return np.array(out)


def best_split(node_sums: np.ndarray, n_splits: np.ndarray, impurity: float | None = None) -> tuple[float, int, int, np.ndarray, np.ndarray] | None:
    """(gain, feature, bin, left sums, right sums) of the best split of one node: [feature, bin, 3].

    With the node's ``impurity`` given, splits of two features into the same rows differ only as their own sums round.
    """
    if node_sums.shape[1] < 2:
        return None
    upto = np.cumsum(node_sums, axis=1)
    left = upto[:, :-1]
    right = upto[:, -1:] - left
    n = upto[:, -1:, 0]
    some = np.maximum(n, 1.0)
    gain = (variance(upto[:, -1:]) if impurity is None else impurity) - left[..., 0] / some * variance(left) - right[..., 0] / some * variance(right)
    allowed = (left[..., 0] >= 1) & (right[..., 0] >= 1) & (np.arange(left.shape[1])[None, :] < n_splits[:, None])
    gain = np.where(allowed, gain, -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[f, b] <= 0:
        return None
    return float(gain[f, b]), int(f), int(b), left[f, b], right[f, b]


def grow(make_sums, n_splits: np.ndarray, depth: int, pick=None) -> Tree:
    """A tree; ``make_sums(routes, open nodes)`` adds up the tasks' ``sums`` for one level.

    ``pick()`` draws the features among which the next node may choose, in the order in which they are tried,
    and compares all by the node's impurity as its parent's split left it, as MLlib does; without it all features are tried.
    """
    tree, open_nodes = Tree(), [0]
    for level in range(max(depth, 1)):
        found = make_sums(tree.routes() if level else None, open_nodes)
        if level == 0:
            tree.add(found[0, 0].sum(axis=0))
        if depth == 0:
            break
        following = []
        for i, node in enumerate(open_nodes):
            features = np.arange(len(n_splits)) if pick is None else np.array(pick())
            split = best_split(found[features, i], n_splits[features], None if pick is None else tree.impurity(node))
            if split is None:
                continue
            tree.gain[node], tree.feature[node], tree.bin[node] = split[0], int(features[split[1]]), split[2]
            tree.left[node], tree.right[node] = tree.add(split[3]), tree.add(split[4])
            following += [c for c in (tree.left[node], tree.right[node]) if abs(tree.impurity(c)) >= _PURE]
        open_nodes = following[::-1]       # MLlib draws for the last child first
        if not open_nodes:
            break
    for node in reversed(range(len(tree.left))):       # children come after their parents
        a, b = tree.left[node], tree.right[node]
        if a >= 0 and tree.left[a] < 0 and tree.left[b] < 0 and tree.prediction(a) == tree.prediction(b):
            tree.left[node] = tree.right[node] = -1
            tree.gain[node] = -1.0
    return tree


def cut_points(pieces: list[tuple[float, float, int]], rows: int, most_bins: int) -> list[float]:
    """Bounds between bins of about equal numbers of rows, by MLlib's rule, from (first value, last value, rows) in order."""
    n_splits = min(most_bins, rows) - 1
    between = [(pieces[k - 1][1] + pieces[k][0]) / 2.0 for k in range(1, len(pieces))]
    if len(between) <= n_splits:
        return between
    stride = rows / (n_splits + 1)
    out, upto, target = [], pieces[0][2], stride
    for k in range(1, len(pieces)):
        before, upto = upto, upto + pieces[k][2]
        if abs(before - target) < abs(upto - target):
            out.append(between[k - 1])
            target += stride
    return out


def preorder(tree: Tree, cuts: list[list[float]]) -> list[tuple]:
    """The nodes as MLlib writes them: id, prediction, impurity, impurityStats, rawCount, gain, leftChild, rightChild, split."""
    rows: list = []

    def put(node: int) -> int:
        at = len(rows)
        rows.append(None)
        leaf = tree.left[node] < 0
        left, right = (-1, -1) if leaf else (put(tree.left[node]), put(tree.right[node]))
        split = (-1, [], -1) if leaf else (tree.feature[node], [float(cuts[tree.feature[node]][tree.bin[node]])], -1)
        rows[at] = (at, tree.prediction(node), tree.impurity(node), list(tree.stats[node]), int(round(tree.stats[node][0])),
                    -1.0 if leaf else tree.gain[node], left, right, split)
        return at

    put(0)
    return rows
