"""Arrow functions on batches of vectors.

Each call sees one Arrow batch of rows that Spark made.  Squared distances are
summed dimension by dimension, in the order the array expressions use.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

NEAREST = StructType([StructField("pick", IntegerType()), StructField("d", DoubleType())])
OFFERS = ArrayType(StructType([
    StructField("side", IntegerType()), StructField("i", IntegerType()),
    StructField("j", IntegerType()), StructField("cost", DoubleType())]))
OFFERS_ARROW = pa.list_(pa.struct([("side", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("cost", pa.float64())]))
INDEXES = ArrayType(IntegerType())
BLOCK = 256  # rows of a tile that are compared at a time
COLUMNS, PAIRS = 1 << 12, 1 << 16  # rows that a block of rows is compared with at a time, and pairs whose distances are summed in order


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length as a two-dimensional array."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def sq_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        diff = a[:, k, None] - b[None, :, k]
        out += diff * diff
    return out


def rough_sq_distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one matrix product, and by how much one may differ from `sq_distances` (infinite if unknown).

    Far cheaper than the sums in order, so searches ask those only for what lies within the difference.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        out = a @ b.T
        out *= -2
        out += aa[:, None]
        out += bb
        off = (4 * a.shape[1] + 16) * np.finfo(float).eps * (aa.max(initial=0) + bb.max(initial=0))
    return out, float(off) if off < 1e280 else float("inf")


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``a`` to the same rows of ``b``, with the digits of `sq_distances`."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        diff = a[:, k] - b[:, k]
        out += diff * diff
    return out


def largest_sq_distance(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """The largest squared distance between two tiles, or ``least`` if that is more, compared by blocks of rows."""
    for s in range(0, len(x), BLOCK):
        p = x[s:s + BLOCK]
        rough, off = rough_sq_distances(p, y)
        if off == float("inf"):
            least = max(least, float(sq_distances(p, y).max(initial=0)))
            continue
        top = rough.max(initial=0)
        if top + off <= least:
            continue
        i, j = np.nonzero(rough >= max(top - off, least) - off)
        for t in range(0, len(i), PAIRS):
            least = max(least, float(_in_order(p[i[t:t + PAIRS]], y[j[t:t + PAIRS]]).max()))
    return least


def cheapest_of(x: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ward cost and row of the cheapest partner, among all rows but itself, of each row in ``at``; the first on ties."""
    cost, which = np.full(len(at), np.inf), np.full(len(at), -1)
    for s in range(0, len(at), BLOCK):
        rows, best, pick = at[s:s + BLOCK], cost[s:s + BLOCK], which[s:s + BLOCK]
        p, m = x[rows], n[rows]
        for t in range(0, len(x), COLUMNS):
            y, w = x[t:t + COLUMNS], n[t:t + COLUMNS]
            weight = m[:, None] * w / (m[:, None] + w)
            rough, off = rough_sq_distances(p, y)
            if off == float("inf"):
                rough, off = sq_distances(p, y), 0.0
            rough *= weight
            own = (rows >= t) & (rows < t + len(y))
            rough[np.flatnonzero(own), rows[own] - t] = np.inf
            low, off = rough.min(axis=1), off * m  # a weight is below either size
            near = (rough <= (np.minimum(low + off, best) + off)[:, None]) & np.isfinite(rough)
            i, j = np.nonzero(near)
            for u in range(0, len(i), PAIRS):
                a, b = i[u:u + PAIRS], j[u:u + PAIRS]
                exact = _in_order(p[a], y[b]) * weight[a, b]
                order = np.lexsort((b, exact, a))
                first = order[np.flatnonzero(np.diff(a[order], prepend=-1))]
                first = first[exact[first] < best[a[first]]]
                best[a[first]], pick[a[first]] = exact[first], b[first] + t
    return cost, which


@arrow_udf(NEAREST)
def nearest_seed(x: pa.Array, seeds: pa.Array) -> pa.Array:
    """Index of the nearest vector of each row's own list, first on ties, and its distance."""
    points = matrix(x)
    counts = np.diff(seeds.offsets.to_numpy())
    own = np.repeat(points, counts, axis=0)
    d2 = ((matrix(seeds.flatten()) - own) ** 2).sum(axis=1)
    starts = np.cumsum(counts) - counts
    best = np.minimum.reduceat(d2, starts)
    row = np.repeat(np.arange(len(points)), counts)
    first = np.full(len(points), len(d2))
    hits = np.flatnonzero(d2 == best[row])
    np.minimum.at(first, row[hits], hits)
    picks = pa.array((first - starts).astype(np.int32))
    return pa.StructArray.from_arrays([picks, pa.array(np.sqrt(best))], ["pick", "d"])


def _tiles(a: pa.Array, b: pa.Array):
    for x, y in zip(a, b):
        yield matrix(x.values), matrix(y.values)


@arrow_udf(BinaryType())
def raw(tile: pa.Array) -> pa.Array:
    """The numbers of a tile's vectors, row by row, as bytes."""
    return pa.array([matrix(t.values).tobytes() for t in tile], pa.binary())


@arrow_udf(DoubleType())
def closest(a: pa.Array, b: pa.Array) -> pa.Array:
    """Smallest squared distance between two tiles of vectors."""
    return pa.array([float(sq_distances(x, y).min()) for x, y in _tiles(a, b)])


@arrow_udf(OFFERS)
def cheapest_partner(a: pa.Array, na: pa.Array, b: pa.Array, nb: pa.Array, same: pa.Array) -> pa.Array:
    """Ward cost of the cheapest partner of every row of either tile, within the other tile.

    ``na`` and ``nb`` hold cluster sizes, ``same`` tells that both tiles are one.
    ``side`` 0 rows belong to the first tile.  Equal costs: the lower row first,
    as tiles are sorted by id.
    """
    out = []
    for (x, y), p, q, one in zip(_tiles(a, b), na, nb, same):
        n, m = np.array(p.as_py(), float)[:, None], np.array(q.as_py(), float)[None, :]
        cost = sq_distances(x, y) * (n * m / (n + m))
        rows = []
        if one.as_py():
            np.fill_diagonal(cost, np.inf)
        else:
            rows += [(1, int(j), int(i), float(cost[i, j])) for j, i in enumerate(cost.argmin(axis=0))]
        rows += [(0, int(i), int(j), float(cost[i, j])) for i, j in enumerate(cost.argmin(axis=1))]
        out.append([dict(zip(("side", "i", "j", "cost"), r)) for r in rows if np.isfinite(r[3])])
    return pa.array(out, OFFERS_ARROW)


@arrow_udf(OFFERS)
def all_merges(tile: pa.Array, sizes: pa.Array) -> pa.Array:
    """Ward's merges of one tile down to a single cluster, cheapest first.

    The merged cluster takes the place of the earlier row.
    """
    out = []
    for t, size in zip(tile, sizes):
        x, n = matrix(t.values).copy(), np.array(size.as_py(), float)
        cost = sq_distances(x, x) * (n[:, None] * n / (n[:, None] + n))
        np.fill_diagonal(cost, np.inf)
        least = cost.min(axis=1)  # of each row, so that a merge looks at one row and not at the table
        rows = []
        for _ in range(len(x) - 1):
            i = int(least.argmin())
            i, j = sorted((i, int(cost[i].argmin())))
            rows.append({"side": 0, "i": i, "j": j, "cost": float(cost[i, j])})
            stale = (cost[:, i] == least) | (cost[:, j] == least)
            x[i] = (n[i] * x[i] + n[j] * x[j]) / (n[i] + n[j])
            n[i] += n[j]
            cost[j, :] = cost[:, j] = np.inf
            fresh = sq_distances(x[i : i + 1], x)[0] * (n[i] * n / (n[i] + n))
            alive = np.isfinite(cost[i])
            cost[i, alive] = cost[alive, i] = fresh[alive]
            least = np.minimum(least, cost[:, i])
            stale[[i, j]] = True
            least[stale] = cost[stale].min(axis=1)
        out.append(rows)
    return pa.array(out, OFFERS_ARROW)


def _close(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which vectors of the first tile are within eps of which of the second."""
    out = np.zeros((len(x), len(y)), bool)
    for s in range(0, len(x), BLOCK):
        p = x[s:s + BLOCK]
        rough, off = rough_sq_distances(p, y)
        if off == float("inf"):
            out[s:s + BLOCK] = np.sqrt(sq_distances(p, y)) <= eps
            continue
        off += 4 * np.finfo(float).eps * eps * eps  # the root and the square are rounded too
        out[s:s + BLOCK] = rough <= eps * eps - off
        i, j = np.nonzero(np.abs(rough - eps * eps) <= off)
        for t in range(0, len(i), PAIRS):
            a, b = i[t:t + PAIRS], j[t:t + PAIRS]
            out[s + a, b] = np.sqrt(_in_order(p[a], y[b])) <= eps
    return out


def pairs_within(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Rows of the one and the other that are within eps of each other, two rows of numbers."""
    found = [np.zeros((2, 0), np.int64)]
    for s in range(0, len(x), BLOCK):
        for t in range(0, len(y), COLUMNS):
            found.append(np.array(np.nonzero(_close(x[s:s + BLOCK], y[t:t + COLUMNS], eps))) + [[s], [t]])
    return np.concatenate(found, axis=1)


def hits_within(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """For every vector of the first tile, how many of the second are within eps."""
    return np.concatenate([_close(x[s:s + BLOCK], y, eps).sum(axis=1) for s in range(0, len(x), BLOCK)])


def first_within(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """For every vector of the first tile, the first row of the second within eps, or -1."""
    close = [_close(x[s:s + BLOCK], y, eps) for s in range(0, len(x), BLOCK)]
    return np.concatenate([np.where(c.any(axis=1), c.argmax(axis=1), -1) for c in close])


def linking_pairs(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray, eps: float) -> list[tuple[int, int]]:
    """Pairs of names, as few as connect all names of two tiles that have vectors within eps of each other.

    ``p`` and ``q`` hold the names of the rows as numbers, each tile's own.
    """
    up: dict = {}

    def top(v):
        while (w := up.setdefault(v, v)) != v:
            v = w
        return v

    rows = []
    for s in range(0, len(x), BLOCK):
        i, j = np.nonzero(_close(x[s:s + BLOCK], y, eps))
        for a, b in np.unique(np.stack([p[s + i], q[j]], axis=1), axis=0).tolist():
            u, v = top((0, a)), top((1, b))
            if u != v:
                up[v] = u
                rows.append((a, b))
    return rows


@arrow_udf(INDEXES)
def neighbours_inside(tile: pa.Array, eps: pa.Array) -> pa.Array:
    """For every vector of a tile, how many of the tile are within eps, itself included."""
    out = []
    for x, e in zip(tile, eps):
        points = matrix(x.values)
        out.append(_close(points, points, e.as_py()).sum(axis=1).astype(np.int32))
    return pa.array(out, pa.list_(pa.int32()))


@arrow_udf(INDEXES)
def groups_inside(tile: pa.Array, eps: pa.Array) -> pa.Array:
    """For every vector of a tile, the first vector it is linked to by steps of at most eps."""
    out = []
    for x, e in zip(tile, eps):
        points = matrix(x.values)
        close = _close(points, points, e.as_py())
        name, before = np.arange(len(points)), None
        while before is None or (name != before).any():
            before = name
            name = np.concatenate([np.where(close[s:s + BLOCK], before, len(points)).min(axis=1) for s in range(0, len(points), BLOCK)])
        out.append(name.astype(np.int32))
    return pa.array(out, pa.list_(pa.int32()))
