"""Clustering of vectors around centroids in exact integers, with bounds that look back along the centroids' history.

Every round keeps, for each vector, an upper bound on the distance to its own centroid, a lower bound to
each other one, and the round each was measured in.  A bound measured in round ``s`` is loosened by the norm of the
centroid's total displacement since ``s``, which the history of centroids gives, and not by the sum of
its drifts in between, which is never smaller.  Where the bounds leave a question open, exact
distances decide.

Bounds are doubles with a margin for rounding; distances, sums and means are exact integers of any size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut
from cairn.session import forget

CLUSTERS, ROUNDS, SCALE, DIMS = 8, 10, 1024, 64
#: What rounding may add to or take from a bound, relative to its terms.
MARGIN = 1e-12
#: Sums are added up in parts of so many bits.
LIMB = 32

_RESULT = "{key} {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) of finite doubles: 64-bit integers where all distances among such fit, Python's else."""
    values = np.asarray(values, dtype=np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not scaled.size or scaled.shape[-1] * (2 * np.abs(scaled).max()) ** 2 < 2.0**62:
        return scaled.astype(np.int64)
    # a product beyond the doubles is of a value that is whole already
    exact = [int(s) if math.isfinite(s) else int(v) * scale for s, v in zip(scaled.ravel().tolist(), values.ravel().tolist())]
    return np.array(exact, dtype=object).reshape(values.shape)


def _fits(*arrays: np.ndarray) -> bool:
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return arrays[0].shape[-1] * (2 * most) ** 2 < 2**62


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to one centre, or to a centre per row."""
    if points.dtype == object or centre.dtype == object or not _fits(points, centre):
        points, centre = points.astype(object), centre.astype(object)
    apart = points - centre
    return (apart * apart).sum(axis=-1)


def _roots(squares: np.ndarray) -> np.ndarray:
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))

    def root(n) -> float:
        try:
            return math.sqrt(n)
        except OverflowError:
            return math.inf  # no bound, so exact distances decide

    return np.array([root(n) for n in squares.ravel()], dtype=np.float64).reshape(squares.shape)


class Bounds:
    """What is known of a batch of vectors: own centroid, bounds and the rounds they were measured in."""

    def __init__(self, own, upper, upper_at, lower, lower_at):
        self.own, self.upper, self.upper_at, self.lower, self.lower_at = own, upper, upper_at, lower, lower_at

    @classmethod
    def measured(cls, points: np.ndarray, centres: np.ndarray, at: int = 0) -> Bounds:
        """All distances at once, for vectors that nothing is known of."""
        squares = np.stack([squared(points, c) for c in centres], axis=1)
        own = np.argmin(squares, axis=1)
        roots, n = _roots(squares), len(points)
        return cls(own, roots[np.arange(n), own], np.full(n, at), roots, np.full(roots.shape, at))

    def advance(self, points: np.ndarray, history: list[np.ndarray]) -> int:
        """Move to the last centroids of ``history``; the number of exact distances that it took."""
        now, centres, n = len(history) - 1, history[-1], len(points)
        if not n:
            return 0
        moved = np.stack([_roots(squared(old, centres)) for old in history])
        rows, names = np.arange(n), np.arange(len(centres))
        with np.errstate(invalid="ignore"):
            low_drift = moved[self.lower_at, names]
            low = self.lower - low_drift - MARGIN * (self.lower + low_drift)
            low[rows, self.own] = np.inf
            high = (self.upper + moved[self.upper_at, self.own]) * (1 + MARGIN)
        nearest_other = low.min(axis=1)
        first = np.flatnonzero(~(high < nearest_other))
        if not len(first):
            return 0
        own_squares = squared(points[first], centres[self.own[first]])
        self.upper[first], self.upper_at[first] = _roots(own_squares), now
        high[first] = self.upper[first] * (1 + MARGIN)
        still = ~(high[first] < nearest_other[first])
        rest, done = first[still], len(first)
        best, winner = own_squares[still].astype(object), self.own[rest].copy()
        before = self.own[rest].copy()
        for j in names:
            at = np.flatnonzero((before != j) & ~(high[rest] < low[rest, j]))
            if not len(at):
                continue
            found = squared(points[rest[at]], centres[j])
            done += len(at)
            self.lower[rest[at], j], self.lower_at[rest[at], j] = _roots(found), now
            found = found.astype(object)
            won = (found < best[at]) | ((found == best[at]) & (j < winner[at]))
            best[at[won]], winner[at[won]] = found[won], j
        changed = np.flatnonzero(winner != before)
        r = rest[changed]
        self.lower[r, before[changed]], self.lower_at[r, before[changed]] = self.upper[r], now
        self.own[r] = winner[changed]
        self.upper[r] = _roots(best[changed])
        return done


def _matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=True)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), type=kind))


def _assign(history: list[np.ndarray], scale: int):
    """Batches of (key, vector[, bounds]) with the bounds moved to the last centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            points, known = whole(_matrix(b["vector"], np.float64), scale), "own" in b.schema.names
            if known:
                s = Bounds(
                    b["own"].to_numpy().astype(np.int64), b["upper"].to_numpy().copy(), b["upper_at"].to_numpy().astype(np.int64),
                    _matrix(b["lower"], np.float64), _matrix(b["lower_at"], np.int64))
                done = s.advance(points, history)
            else:
                s = Bounds.measured(points, history[0])
                done = points.shape[0] * len(history[0])
            scans = np.zeros(len(points), dtype=np.int64)
            scans[0] = done
            yield pa.RecordBatch.from_arrays(
                [b["key"], b["vector"], pa.array(s.own, pa.int32()), pa.array(s.upper), pa.array(s.upper_at, pa.int32()),
                 _lists(s.lower, pa.float64()), _lists(s.lower_at, pa.int32()), pa.array(scans)],
                names=["key", "vector", "own", "upper", "upper_at", "lower", "lower_at", "measured"])

    return run


def _sums(k: int, dims: int, scale: int):
    """One task's sums per cluster and component, in parts of ``LIMB`` bits; component -1 holds the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, mask = np.zeros((k, dims), dtype=object), np.zeros(k, dtype=np.int64), (1 << LIMB) - 1
        for b in batches:
            points, own = whole(_matrix(b["vector"], np.float64), scale) if b.num_rows else None, b["own"].to_numpy()
            for j in np.unique(own):
                total[j] += points[own == j].sum(axis=0).astype(object)
                count[j] += int((own == j).sum())
        rows = [(j, -1, 0, int(count[j])) for j in range(k) if count[j]]
        for j in np.flatnonzero(count):
            for d in range(dims):
                left, part, sign = abs(int(total[j, d])), 0, -1 if total[j, d] < 0 else 1
                while left:
                    rows.append((int(j), d, part, sign * (left & mask)))
                    left, part = left >> LIMB, part + 1
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["own", "dim", "part", "value"])

    return run


def _means(state: DataFrame, centres: np.ndarray, scale: int) -> np.ndarray:
    """Centroids of the clusters in ``state``; those of empty clusters stay.  The driver gets clusters x components rows."""
    k, dims = centres.shape
    parts = state.select("vector", "own").mapInArrow(_sums(k, dims, scale), "own int, dim int, part int, value bigint")
    rows = parts.groupBy("own", "dim", "part").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    count, out = {r["own"]: int(r["value"]) for r in rows if r["dim"] < 0}, centres.astype(object)
    total: dict[tuple[int, int], int] = {}
    for r in rows:
        if r["dim"] >= 0:
            at = (r["own"], r["dim"])
            total[at] = total.get(at, 0) + (int(r["value"]) << (LIMB * r["part"]))
    for j, n in count.items():
        out[j] = [total.get((j, d), 0) // n for d in range(dims)]
    return _narrow(out)


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64) if _fits(values) else values


def _distances(centres: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own = b["own"].to_numpy()
            found = squared(whole(_matrix(b["vector"], np.float64), scale), centres[own])
            fitting = [int(x) if x < 2**63 else None for x in found.tolist()]
            yield pa.RecordBatch.from_arrays([b["key"], b["own"], pa.array(fitting, pa.int64())], names=["key", "cluster", "distance"])

    return run


def fingerprint(centre) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centre).encode()).hexdigest()


def cluster_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
    scale: int = SCALE, dims: int = DIMS, seed: int = 3, log: list[int] | None = None,
) -> DataFrame:
    """One row per vector of ``dims`` components, none of them null or non-finite: its cluster and squared distance.

    Components become floor(scale * x).  The first centroids are the ``k`` vectors (all, if fewer) whose ``seed:key`` has
    the smallest SHA-256; rows of one key follow by vector, and a null key counts as the empty word.  Ties in distance go
    to the smaller number.  Other columns of ``df`` do not matter, whatever their names; repeated rows count as often
    as they stand; without a usable vector the result is empty.  A distance beyond 64 bits comes out as null, and so
    do the sums it is in.  ``log`` gets the number of exact distances of each assignment.

    Each assignment is written once and the one before it removed; the driver and the tasks hold the history of
    centroids (rounds x k x dims numbers), nothing that grows with the table.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType
    x = F.col(f"`{vector}`")
    usable = x.isNotNull() & (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = df.select(F.col(f"`{key}`").alias("key"), x.cast("array<double>").alias("vector")).filter(F.coalesce(usable, F.lit(False)))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    first = [r["vector"] for r in kept.orderBy(order, "key", "vector").limit(k).collect()]
    result = _RESULT.format(key=f"`{key}`", kind=kind.simpleString())
    if not first:
        return spark.createDataFrame([], result)
    history = [_narrow(whole(np.array(first), scale))]
    shape = f"key {kind.simpleString()}, vector array<double>, own int, upper double, upper_at int, lower array<double>, lower_at array<int>, measured bigint"
    state = None
    for at in range(rounds + 1):
        before, state = state, cut((kept if state is None else state.drop("measured")).mapInArrow(_assign(list(history), scale), shape))
        forget(before)
        if log is not None:
            log.append(state.agg(F.sum("measured")).first()[0])
        if at < rounds:
            history.append(_means(state, history[-1], scale))
    found = cut(state.select("key", "vector", "own").mapInArrow(_distances(history[-1], scale), f"key {kind.simpleString()}, cluster int, distance bigint"))
    forget(state)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), total).alias("sum")).collect()
    own = {r["cluster"]: None if r["sum"] is None or r["sum"] >= 2**63 else int(r["sum"]) for r in sums}
    over = None if any(v is None for v in own.values()) or sum(own.values()) >= 2**63 else sum(own.values())
    told = [(j, v, over, fingerprint(history[-1][j])) for j, v in own.items()]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    joined = found.join(told, "cluster")
    return joined.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: int = 3) -> str:
    """The same for DuckDB, a few common tables per round."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INTEGER) AS c, v AS m
            FROM kept ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (
            SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, c{r})""")
        steps.append(f"""a{r} AS MATERIALIZED (
            SELECT vec_id, v, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS n FROM d{r}) AS ranked WHERE n = 1)""")
        if r < rounds:
            steps.append(f"""s{r} AS MATERIALIZED (
                SELECT c, i, CAST(floor_mean AS BIGINT) AS f FROM (
                    SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
                    FROM (SELECT c, unnest(v) AS x, unnest(range({dims})) AS i FROM a{r}) AS cells GROUP BY c, i) AS means)""")
            steps.append(f"""c{r + 1} AS MATERIALIZED (
                SELECT o.c, coalesce(n.m, o.m) AS m FROM c{r} AS o LEFT JOIN (SELECT c, list(f ORDER BY i) AS m FROM s{r} GROUP BY c) AS n ON o.c = n.c)""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, a.c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} AS a JOIN c{rounds} AS o ON a.c = o.c"""


ORACLE_SQL = _sql()
