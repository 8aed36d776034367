"""The steps of the BFR loop over small chunks, on the driver.

A chunk has a bounded size, and the loop goes through chunks one after the other, as each needs the states that the one before
left.  Where a chunk is so small that jobs over it cost more than its work, the driver reads many chunks at a time, keeps the
states, the sets and the retained points between them, and gives each chunk's members back as rows.  It does the same as the steps over
tables, in NumPy: all of a chunk's points are assigned, clustered by density with all retained points, and merged.

Retained points are noise, so each has few neighbours among them; their pairs are kept, and only the new points are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cairn.functions.kernels import pairs_within
from cairn.operators.assign import OUTLIER, mahalanobis
from cairn.operators.merge import fitting


class States:
    """Count, sum, sum of squares and central moment per key and dimension, one row per key."""

    def __init__(self, dims: int):
        self.n, (self.s, self.q, self.m2) = np.zeros((0, dims), np.int64), (np.zeros((0, dims)) for _ in range(3))

    @classmethod
    def of(cls, x: np.ndarray, group: np.ndarray, groups: int) -> States:
        """States of the rows of ``x`` by group number; a group without rows has zeros."""
        out = cls(x.shape[1])
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(groups + 1))
        parts = [x[order[a:b]] for a, b in zip(ends, ends[1:])]
        out.n = np.array([[len(p)] * x.shape[1] for p in parts], np.int64).reshape(groups, x.shape[1])
        out.s = np.array([p.sum(axis=0) for p in parts]).reshape(groups, x.shape[1])
        out.q = np.array([(p * p).sum(axis=0) for p in parts]).reshape(groups, x.shape[1])
        out.m2 = np.array([((p - p.sum(axis=0) / max(len(p), 1)) ** 2).sum(axis=0) for p in parts]).reshape(groups, x.shape[1])
        return out

    def cells(self) -> tuple[np.ndarray, ...]:
        return self.n, self.s, self.q, self.m2

    @classmethod
    def made(cls, n, s, q, m2) -> States:
        out = cls(s.shape[1])
        out.n, out.s, out.q, out.m2 = n, s, q, m2
        return out

    def take(self, rows) -> States:
        return States.made(*[c[rows] for c in self.cells()])

    def plus(self, other: States) -> States:
        """Row by row, as `states.merge` adds them."""
        n = self.n + other.n
        with np.errstate(invalid="ignore", divide="ignore"):
            mine, theirs = self.s / self.n, other.s / other.n
            low = np.fmin(mine, theirs)
            a, b = np.where(self.n > 0, mine - low, 0.0), np.where(other.n > 0, theirs - low, 0.0)
            between = self.n * a * a + other.n * b * b - (self.n * a + other.n * b) ** 2 / n
        return States.made(n, self.s + other.s, self.q + other.q, self.m2 + other.m2 + np.fmax(between, 0.0))

    def joined(self, other: States) -> States:
        return States.made(*[np.concatenate(c) for c in zip(self.cells(), other.cells())])


def _components(u: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """Smallest node of every node's component."""
    name = np.arange(size)
    while True:
        low = np.minimum(name[u], name[v])
        after = name.copy()
        np.minimum.at(after, name[u], low)
        np.minimum.at(after, name[v], low)
        after = after[after]
        if (after == name).all():
            return name
        name = after


class Held:
    """State of the loop between chunks: clusters, sets by their keys in list order, retained points."""

    def __init__(self, ids: list, discard: States, dims: int, settings):
        self.ids, self.discard, self.dims, self.settings = ids, discard, dims, settings
        self.sets, self.keys, self.step, self.pooled = States(dims), [], 0, False
        self.x, self.rank, self.at = np.zeros((0, dims)), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs = np.zeros((2, 0), np.int64)  # of retained points within eps of each other, each once
        self.clear()

    def clear(self) -> None:
        """Forget what earlier chunks gave: rows with clusters, rows with set keys, renamings of sets."""
        self.near: list[tuple[np.ndarray, np.ndarray]] = []
        self.born: list[tuple[np.ndarray, np.ndarray]] = []
        self.names: list[tuple[tuple, tuple]] = []

    def bytes(self) -> int:
        return self.x.nbytes + self.pairs.nbytes + 4 * self.sets.s.nbytes

    def chunk(self, x: np.ndarray, rank: np.ndarray, at: np.ndarray) -> bool:
        """Take a chunk's points in; ``rank`` is their ids' place in the order of all, ``at`` their row.

        False, and nothing done, where outliers share an id: what joins by id make of them is left to the step over tables.
        """
        which = self._assigned(x)
        inside = which != OUTLIER
        if len(np.unique(rank[~inside])) < len(x) - inside.sum():
            return False
        self.near.append((at[inside], which[inside]))
        self.discard = self.discard.plus(States.of(x[inside], which[inside], len(self.ids)))
        self._pool(x[~inside], rank[~inside], at[~inside])
        return True

    def _assigned(self, x: np.ndarray) -> np.ndarray:
        best, which = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        d = self.discard
        centroid, variance = d.s / d.n, d.m2 / d.n
        for i in range(len(self.ids)):
            far = mahalanobis(x, centroid[i], variance[i])
            closer = far < best
            best[closer], which[closer] = far[closer], i
        limit = np.sqrt(self.settings.deviations**2 * self.dims)
        return np.where(best >= limit, OUTLIER, which)

    def _pool(self, x: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
        new = np.argsort(rank)
        x, rank, at = x[new], rank[new], at[new]
        if not len(x) + len(self.x):
            return
        eps, first = self.settings.eps, len(x)
        self.pooled = True
        among = pairs_within(x, x, eps)
        across = pairs_within(x, self.x, eps)
        pairs = np.concatenate([among[:, among[0] < among[1]], across + [[0], [first]], self.pairs + first], axis=1)
        x, rank, at = np.concatenate([x, self.x]), np.concatenate([rank, self.rank]), np.concatenate([at, self.at])
        label = self._labels(pairs, len(x))
        left, row = np.flatnonzero(label < 0), np.flatnonzero(label >= 0)
        order = left[np.argsort(rank[left])]
        self.x, self.rank, self.at = x[order], rank[order], at[order]
        place = np.full(len(x), -1)
        place[order] = np.arange(len(order))
        kept = place[pairs]
        self.pairs = kept[:, (kept >= 0).all(axis=0)]
        found, group = np.unique(label[row], return_inverse=True)
        start = len(self.keys)
        self.born.append((at[row], np.stack([np.full(len(row), self.step), group], axis=1)))
        self.keys += [(self.step, r) for r in range(len(found))]
        self.sets = self.sets.joined(States.of(x[row], group, len(found)))
        self.step += 1
        self._merge(start)

    def _labels(self, pairs: np.ndarray, size: int) -> np.ndarray:
        """The first core point of each point's group, -1 for noise; points are in the order that names groups."""
        core = 1 + np.bincount(pairs.ravel(), minlength=size) >= self.settings.min_points
        u, v = pairs
        both = core[u] & core[v]
        name = _components(u[both], v[both], size)
        label = np.where(core, name, size)
        for a, b in ((u, v), (v, u)):
            edge = core[a] & ~core[b]
            np.minimum.at(label, b[edge], name[a[edge]])
        return np.where(label == size, -1, label)

    def _merge(self, start: int) -> None:
        """Merge sets pass by pass; those before ``start`` are known to fit none of each other."""
        came = {k: k for k in self.keys[start:]}
        fits: set[tuple[int, int]] = set()
        gone = np.zeros(len(self.keys), bool)
        while True:
            for i in range(start, len(self.keys)):
                n, c, v = self._described()
                other = np.flatnonzero(fitting(n[i], c[i], v[i], n[:i], c[:i], v[:i], self.settings.alpha) & ~gone[:i])
                fits |= {(int(j), i) for j in other}
            used, pairs = set(), []
            for lo, hi in sorted(fits):
                if lo not in used and hi not in used:
                    used |= {lo, hi}
                    pairs.append((lo, hi))
            if not pairs:
                break
            fits = {p for p in fits if used.isdisjoint(p)}
            start = len(self.keys)
            lo, hi = map(list, zip(*pairs))
            self.sets = self.sets.joined(self.sets.take(lo).plus(self.sets.take(hi)))
            fresh = [(self.step, r) for r in range(len(pairs))]
            moved = {self.keys[i]: fresh[r] for r, p in enumerate(pairs) for i in p}
            came = {old: moved.get(new, new) for old, new in came.items()} | {old: new for old, new in moved.items() if old not in came}
            self.keys += fresh
            gone = np.concatenate([gone, np.zeros(len(fresh), bool)])
            gone[lo + hi] = True
            self.step += 1
        self.names += list(came.items())
        self.sets, self.keys = self.sets.take(~gone), [k for k, g in zip(self.keys, gone) if not g]

    def _described(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Size, centroid and mean variance of every set, as `merge.described` has them."""
        s = self.sets
        if getattr(self, "_of", None) is not s:
            n = s.n[:, 0].astype(float)
            spread = np.cumsum(s.m2, axis=1)[:, -1] / n / s.m2.shape[1] if len(n) else np.zeros(0)
            self._of, self._known = s, (n, s.s / n[:, None], spread)
        return self._known


def ranks(ids: pa.Array) -> np.ndarray:
    """Place of each id in the order in which Spark sorts them, the same for equal ones."""
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return np.unique(ids.to_numpy(), return_inverse=True)[1]
    keys = [_sortable(v) for v in ids.to_pylist()]
    place = {k: i for i, k in enumerate(sorted(set(keys)))}
    return np.array([place[k] for k in keys], np.int64)


def _sortable(v):
    """A value that Python orders as Spark does: nulls first, texts by their bytes, structs field by field, not-a-number last."""
    if isinstance(v, dict):
        return (1, *[_sortable(x) for x in v.values()])
    if v is None:
        return (0,)
    return (1, v.encode() if isinstance(v, str) else v) if v == v else (2,)
