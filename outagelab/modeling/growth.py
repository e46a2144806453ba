"""Classification trees grown by numpy, many at once, over rows cut into at most ``BINS`` bins per feature.

A grove is a list of trees in shared arrays. Trees grow level by level; a level works on all open nodes at once. Rows stay
grouped by node. Where nodes are large, the counts of a feature are a table of (node, bin, class); where they are small, a
sort of packed (node, bin, class, count) numbers, so that no work is done for empty bins. Both find the same splits.
Subtrees whose rows fit ``BLOCK`` grow on a copy of these rows, which stays in the processor's cache.

The rules are those of MLlib's forests: rows drawn with replacement (Poisson counts), a new draw of features at every node, Gini
impurity on weighted counts, a minimum of drawn rows per child, and leaves of one parent that predict the same class made one.
Draws follow from the tree's key and the node's place in the tree alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

BINS = 32           # MLlib's default
MAX_DEPTH = 30      # MLlib's limit
MOST = 15           # draws of a row by a tree: beyond a chance of 1e-14
BLOCK = 1 << 16     # rows of a subtree that grows on a copy of its own
TABLE = 4           # a table is used for nodes of at least TABLE * BINS rows on average
EXACT = float(1 << 40)  # votes are multiples of 1 / EXACT, so their sums are exact in every order


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread (SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Rows:
    """Binned features (a row of ``x`` per feature), labels and weights."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    classes: int

    def ordered(self) -> Rows:
        """The same rows in an order that depends on their values alone."""
        h = mixed(self.y.astype(np.uint64)) ^ mixed(self.w.view(np.uint64))
        for f in self.x:
            h = mixed(h + f)
        at = np.argsort(h, kind="stable")
        return Rows(np.ascontiguousarray(self.x[:, at]), self.y[at], self.w[at], self.classes)

    def class_weights(self) -> np.ndarray | None:
        """Weight of each class, if it is the same for all its rows."""
        out = np.ones(self.classes)
        for k in range(self.classes):
            own = self.w[self.y == k]
            if own.size:
                if own.min() != own.max():
                    return None
                out[k] = own[0]
        return out


@dataclass(frozen=True)
class Grove:
    """Trees in shared arrays; the first ``trees`` nodes are the roots, a right child follows its left one.

    ``feature`` is -1 in leaves; ``votes`` has a row per node, shares of the classes, which only those of leaves are read of.
    """

    trees: int
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    votes: np.ndarray

    def score(self, x: np.ndarray, out: np.ndarray) -> None:
        """Add the votes of all trees for binned rows to ``out``."""
        flat, n = x.reshape(-1), x.shape[1]
        for root in range(self.trees):
            at = np.full(n, root, np.int32)
            rows = np.arange(n, dtype=np.int64)
            here = at
            while rows.size:
                f = self.feature[here]
                inner = f >= 0
                if not inner.all():
                    rows, here, f = rows[inner], here[inner], f[inner]
                here = self.left[here] + (flat[f * np.int64(n) + rows] > self.bin[here])
                at[rows] = here
            out += self.votes[at]

    def packed(self) -> bytes:
        n = np.array([self.trees, self.feature.size, self.votes.shape[1]], np.int64)
        leaves = self.votes[self.feature < 0]
        return b"".join(a.tobytes() for a in (n, self.left, self.feature, self.bin, leaves))

    @classmethod
    def unpacked(cls, data: bytes) -> Grove:
        trees, nodes, classes = np.frombuffer(data, np.int64, 3)
        left = np.frombuffer(data, np.int32, nodes, 24)
        feature = np.frombuffer(data, np.int16, nodes, 24 + 4 * nodes)
        bins = np.frombuffer(data, np.uint8, nodes, 24 + 6 * nodes)
        votes = np.zeros((nodes, classes))
        votes[feature < 0] = np.frombuffer(data, np.float64, -1, 24 + 7 * nodes).reshape(-1, classes)
        return cls(int(trees), feature, bins, left, votes)


class _Nodes:
    """Nodes made so far: lists of arrays that are joined at the end."""

    def __init__(self, stats: np.ndarray):
        self.count = len(stats)
        self.stats = [stats]
        self.split: list[tuple] = []     # (node, feature, bin, left child, gain)

    def add(self, node, feature, bins, gain, left, right) -> np.ndarray:
        """Split nodes; the ids of their left children."""
        ids = self.count + 2 * np.arange(len(node), dtype=np.int64)
        self.stats.append(np.stack([left, right], 1).reshape(-1, left.shape[1]))
        self.split.append((node, feature, bins, ids, gain))
        self.count += 2 * len(node)
        return ids


def _total(stats: np.ndarray) -> np.ndarray:
    """Sum over the classes: few, so adding columns is faster than ``sum``."""
    return sum((stats[..., c] for c in range(1, stats.shape[-1])), stats[..., 0])


def _gini(stats: np.ndarray, total: np.ndarray) -> np.ndarray:
    out, total = np.ones_like(total), np.where(total > 0, total, 1.0)
    for c in range(stats.shape[-1]):
        share = stats[..., c] / total
        share *= share
        out -= share
    return out


def _gain(stats: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Fall of the impurity by splits with ``stats`` on the left of nodes with ``own``; rounded as by MLlib, so ties fall alike."""
    total, left = _total(own), _total(stats)
    rest = own - stats
    right = _total(rest)
    return _gini(own, total) - left / total * _gini(stats, left) - right / total * _gini(rest, right)


def _features(keys: np.ndarray, places: np.ndarray, width: int, size: int) -> np.ndarray:
    """``size`` different features for each node, by its tree's key and its place."""
    if size == width:
        return np.broadcast_to(np.arange(width), (len(keys), width))
    # Many nodes with many features: in slices of bounded memory.
    step = max(1, (1 << 20) // width)
    turns = np.arange(width, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    node = mixed(keys + mixed(places))
    out = np.empty((len(keys), size), np.int64)
    for i in range(0, len(keys), step):
        out[i:i + step] = np.argpartition(mixed(node[i:i + step, None] + turns), size - 1, axis=1)[:, :size]
    return np.sort(out, axis=1)


@dataclass
class _Level:
    """Open nodes and their rows, grouped by node."""

    node: np.ndarray      # id
    key: np.ndarray       # of the tree
    place: np.ndarray     # in the tree: 1 is the root, 2p and 2p + 1 the children of p
    sizes: np.ndarray     # rows
    drawn: np.ndarray     # drawn rows by class
    stats: np.ndarray     # their weights by class
    row: np.ndarray
    tag: np.ndarray       # class * 16 + how often the row is drawn


class _Growth:
    def __init__(self, rows: Rows, weights: np.ndarray | None, least: int, subset: int, nodes: _Nodes):
        self.rows, self.weights, self.least, self.subset, self.nodes = rows, weights, least, subset, nodes
        self.label_bits = max(1, int(rows.classes - 1).bit_length())

    def grow(self, at: _Level, depth: int) -> None:
        while len(at.node) and depth > 0:
            if len(at.node) > 1 and len(at.row) > 2 * BLOCK:
                self._apart(at, depth)
                return
            at = self._split(at)
            depth -= 1

    def _apart(self, at: _Level, depth: int) -> None:
        """Groups of neighbouring nodes, each with its own copy of its rows."""
        ends = np.cumsum(at.sizes)
        a = 0
        while a < len(at.node):
            lo = ends[a] - at.sizes[a]
            b = max(a + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
            hi = ends[b - 1]
            part = slice(lo, hi)
            own, where = np.unique(at.row[part], return_inverse=True)
            rows = Rows(np.ascontiguousarray(self.rows.x[:, own]), self.rows.y[own], self.rows.w[own], self.rows.classes)
            cut = _Level(at.node[a:b], at.key[a:b], at.place[a:b], at.sizes[a:b], at.drawn[a:b], at.stats[a:b],
                         where.astype(np.int32), at.tag[part])
            inside = _Growth(rows, self.weights, self.least, self.subset, self.nodes)
            cut = inside._split(cut)      # a node larger than the block is split before its rows are copied again
            inside.grow(cut, depth - 1)
            a = b

    def _weights(self, at):
        return (at.tag & 15) * self.rows.w[at.row]

    def _best_of_table(self, at, row_node):
        """For one feature's bins: score, bin, and drawn rows and weights by class on the left of every node's best split."""
        nodes, k = len(at.node), self.rows.classes
        base, count = row_node * np.int64(BINS * k) + (at.tag >> 4), (at.tag & 15).astype(np.float64)
        weight = None if self.weights is not None else self._weights(at)
        every = np.arange(nodes)

        def best(bins):
            cell = base + bins * np.int64(k)
            drawn = np.bincount(cell, count, nodes * BINS * k).reshape(nodes, BINS, k)[:, :-1].cumsum(1)
            if weight is None:
                stats = drawn * self.weights
            else:
                stats = np.bincount(cell, weight, nodes * BINS * k).reshape(nodes, BINS, k)[:, :-1].cumsum(1)
            few = _total(drawn)
            bad = (few < self.least) | (_total(at.drawn)[:, None] - few < self.least)
            score = _gain(stats, at.stats[:, None])
            score[bad] = -1.0
            top = score.argmax(1)
            return score[every, top], top, drawn[every, top], stats[every, top]
        return best

    def _best_of_sorted(self, at, row_node):
        """The same from sorted numbers."""
        k, bits, shift = self.rows.classes, self.label_bits, self.label_bits + 4
        kind = np.uint32 if len(at.node) * BINS << shift < 1 << 32 else np.uint64
        base = (row_node.astype(kind) << kind(shift + BINS.bit_length() - 1)) | at.tag
        weight = None if self.weights is not None else self._weights(at)
        before = np.cumsum(at.drawn, 0) - at.drawn, np.cumsum(at.stats, 0) - at.stats
        total = _total(at.drawn)

        def best(bins):
            packed = base | (bins.astype(kind) << kind(shift))
            if weight is None:
                packed.sort()
            else:
                order = np.argsort(packed, kind="stable")
                packed = packed[order]
            place = packed >> kind(shift)
            ends = np.append(np.flatnonzero(place[1:] != place[:-1]), len(place) - 1)
            label = (packed >> kind(4)) & kind((1 << bits) - 1)
            place = place[ends].astype(np.int64)
            node = place // BINS

            def upto(values, before):
                sums = np.empty((len(ends), k))
                for c in range(k - 1):
                    sums[:, c] = np.cumsum(values * (label == c))[ends]
                sums[:, k - 1] = np.cumsum(values)[ends] - _total(sums[:, :k - 1])
                return sums - before[node]
            drawn = upto((packed & kind(15)).astype(np.int64), before[0])
            stats = drawn * self.weights if weight is None else upto(weight[order], before[1])
            few = _total(drawn)
            bad = (few < self.least) | (total[node] - few < self.least)
            score = _gain(stats, at.stats[node])
            score[bad] = -1.0
            first = np.append(0, np.flatnonzero(node[1:] != node[:-1]) + 1)
            top = np.maximum.reduceat(score, first)
            hits = np.flatnonzero(score == top[node])
            hits = hits[np.append(True, node[hits[1:]] != node[hits[:-1]])]
            return top, place[hits] % BINS, drawn[hits], stats[hits]
        return best

    def _split(self, at: _Level) -> _Level:
        """Split every open node by its best feature, if any split has a gain; the open children."""
        x, n = self.rows.x.reshape(-1), self.rows.x.shape[1]
        nodes = len(at.node)
        row_node = np.repeat(np.arange(nodes, dtype=np.int32), at.sizes)
        chosen = _features(at.key, at.place, len(self.rows.x), self.subset)
        best = (self._best_of_table if len(at.row) >= TABLE * BINS * nodes else self._best_of_sorted)(at, row_node)
        score = np.zeros(nodes)
        feature, cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
        drawn, stats = np.zeros_like(at.drawn), np.zeros_like(at.stats)
        for s in range(chosen.shape[1]):
            f = chosen[:, s]
            bins = x.take(np.repeat(f * n, at.sizes) + at.row)
            found, where, d, w = best(bins)
            better = np.flatnonzero(found > score)
            score[better], feature[better], cut[better] = found[better], f[better], where[better]
            drawn[better], stats[better] = d[better], w[better]
        kept = np.flatnonzero(feature >= 0)
        rest = at.drawn - drawn
        others = at.stats - stats if self.weights is None else rest * self.weights
        left = self.nodes.add(at.node[kept], feature[kept], cut[kept], (score * _total(at.stats))[kept], stats[kept], others[kept])

        # Rows of left children first, then those of right ones: both stay grouped.
        goes = x.take(np.repeat(np.maximum(feature, 0) * n, at.sizes) + at.row) > np.repeat(cut.astype(np.uint8), at.sizes)
        sides = []
        for side, d, w in ((0, drawn[kept], stats[kept]), (1, rest[kept], others[kept])):
            going = (d.sum(1) >= 2 * self.least) & ((d > 0).sum(1) > 1)
            open_ = np.zeros(nodes, bool)
            open_[kept[going]] = True
            taken = np.flatnonzero(open_[row_node] & (goes == bool(side)))
            sides.append((left[going] + side, at.key[kept[going]], at.place[kept[going]] * np.uint64(2) + np.uint64(side),
                          np.bincount(row_node[taken], minlength=nodes)[kept[going]], d[going], w[going],
                          at.row[taken], at.tag[taken]))
        return _Level(*[np.concatenate(pair) for pair in zip(*sides)])


def tree_key(seed: int, number: int) -> int:
    return int(mixed(mixed(np.array([seed & (1 << 64) - 1], np.uint64)) + np.uint64(number))[0])


def grow(rows: Rows, keys: Sequence[int], max_depth: int, least: int, subset: int, bootstrap: bool = True) -> tuple[Grove, np.ndarray]:
    """A grove of a tree for each key over ``rows`` (in their order) and the sum of the trees' importances of the features."""
    n, k = rows.x.shape[1], rows.classes
    weights = rows.class_weights()
    if weights is None:
        # Multiples of a small unit: their sums are exact in every order.
        unit = 2.0 ** (np.floor(np.log2(rows.w.max())) - 30)
        rows = Rows(rows.x, rows.y, np.round(rows.w / unit) * unit, k)
    picked, counts, drawn, stats = [], [], np.zeros((len(keys), k)), np.zeros((len(keys), k))
    for t, key in enumerate(keys):
        count = np.minimum(np.random.Generator(np.random.PCG64(key)).poisson(1.0, n), MOST) if bootstrap else np.ones(n, np.int64)
        own = np.flatnonzero(count)
        picked.append(own)
        counts.append(count[own])
        drawn[t] = np.bincount(rows.y, count, k)
        stats[t] = drawn[t] * weights if weights is not None else np.bincount(rows.y, count * rows.w, k)
    nodes = _Nodes(stats)
    going = (drawn.sum(1) >= 2 * least) & ((drawn > 0).sum(1) > 1)
    at = np.flatnonzero(going)
    row = np.concatenate([picked[t] for t in at]) if len(at) else np.zeros(0, np.int64)
    count = np.concatenate([counts[t] for t in at]) if len(at) else np.zeros(0, np.int64)
    tag = rows.y[row].astype(np.uint16) << 4 | count.astype(np.uint16)
    level = _Level(at, np.array(keys, np.uint64)[at], np.ones(len(at), np.uint64), np.array([len(picked[t]) for t in at], np.int64),
                   drawn[at], stats[at], row.astype(np.int32), tag)
    _Growth(rows, weights, least, subset, nodes).grow(level, max_depth)
    return _finished(nodes, len(keys), len(rows.x))


def _finished(nodes: _Nodes, trees: int, width: int) -> tuple[Grove, np.ndarray]:
    stats = np.concatenate(nodes.stats)
    feature, bins = np.full(nodes.count, -1, np.int16), np.zeros(nodes.count, np.uint8)
    left, gain, tree = np.zeros(nodes.count, np.int64), np.zeros(nodes.count), np.zeros(nodes.count, np.int64)
    tree[:trees] = np.arange(trees)
    for node, f, b, ids, g in nodes.split:      # parents come before their children
        feature[node], bins[node], left[node], gain[node] = f, b, ids, g
        tree[ids] = tree[ids + 1] = tree[node]
    guess = stats.argmax(1)
    for node, _, _, ids, _ in reversed(nodes.split):
        same = (feature[ids] < 0) & (feature[ids + 1] < 0) & (guess[ids] == guess[ids + 1])
        feature[node[same]] = -1
    inner = np.flatnonzero(feature >= 0)
    each = np.bincount(tree[inner] * width + feature[inner], gain[inner], trees * width).astype(float).reshape(trees, width)
    total = each.sum(1, keepdims=True)
    importances = np.divide(each, total, out=np.zeros_like(each), where=total > 0).sum(0)
    alive = np.zeros(nodes.count, bool)
    alive[:trees] = True
    alive[left[inner]] = alive[left[inner] + 1] = True
    number = np.cumsum(alive) - 1
    left = np.where(feature >= 0, number[left], 0)[alive].astype(np.int32)
    share = stats[alive] / np.maximum(stats[alive].sum(1, keepdims=True), 1e-300)
    votes = np.round(share * EXACT) / EXACT
    votes[:, -1] = 1.0 - votes[:, :-1].sum(1)
    return Grove(trees, feature[alive], bins[alive], left, votes), importances
