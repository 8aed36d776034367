"""Centroid clustering against plain integers."""

import hashlib

import numpy as np
import pytest

from cairn.llm import ns_clusters as ns

SCHEMA = "vec_id long, embedding array<float>, key int, Vector string, own string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], schema)


def brute(rows, k=8, rounds=10, scale=1024, dims=64, seed=3):
    """{(id, cluster, distance, cluster sum, sum, digest)} with counts."""
    kept = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(np.floor(scale * x)) if abs(x) < 1e30 else int(x) * scale for x in v]) for i, v in kept]
    order = sorted(range(len(whole)), key=lambda r: (hashlib.sha256(f"{seed}:{'' if kept[r][0] is None else kept[r][0]}".encode()).hexdigest(), kept[r][0] or 0, kept[r][1]))
    centres = [whole[r][1] for r in order[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        own = [min((gap(v, c), j) for j, c in enumerate(centres))[::-1] for _, v in whole]
        if turn < rounds:
            for j in range(len(centres)):
                mine = [v for (_, v), (o, _) in zip(whole, own) if o == j]
                if mine:
                    centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    fit = lambda n: n if n is not None and n < 2**63 else None
    each = {}
    for o, d in own:
        each[o] = None if o in each and each[o] is None or fit(d) is None else each.get(o, 0) + d
    over = None if any(fit(v) is None for v in each.values()) else sum(each.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), o, str(fit(d)), str(fit(each[o])), str(fit(over)), sha[o]) for (i, _), (o, d) in zip(whole, own))


def rows_of(df):
    names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r["vec_id"]), r["cluster"], str(r["distance"]), str(r["cluster_inertia"]), str(r["inertia"]), r["centroid_sha256"]) for r in df.select("vec_id", *names).collect())


def blobs(n=300, dims=64, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    x = (centres[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, dims))) / 8
    x[: n // 3] = x[0]  # a third of all rows are copies
    return [(i, v.tolist()) for i, v in enumerate(x)]


ODD = [(None, [0.1] * 64), (7, [0.2] * 64), (7, [0.2] * 64), (500, None), (501, []), (502, [0.5] * 63), (503, [float("nan")] + [0.1] * 63), (504, [None] + [0.1] * 63), (505, [float("-inf")] + [0.1] * 63)]


def test_equals_plain_integers_and_measures_less(spark):
    rows, log = blobs() + ODD, []
    got = ns.cluster_vectors(frame(spark, rows), log=log)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows_of(got) == brute(rows)
    n = len(rows) - 6
    assert log[0] == 8 * n and log[-1] < 2 * n and sum(log) < 0.6 * 11 * 8 * n


@pytest.mark.parametrize("least", [3e38, 1e12, 1e6])
def test_huge_components(spark, least):
    rows = blobs(40)
    rows += [(1000, [least] + [0.0] * 63), (1001, [-least] * 64), (1002, [least] * 64)]
    assert rows_of(ns.cluster_vectors(frame(spark, rows), rounds=4)) == brute(rows, rounds=4)


def test_ties_few_rows_and_none(spark):
    ties = [(i, [float(i % 3)] + [0.0] * 63) for i in range(30)]  # many distances alike, centroids that coincide
    assert rows_of(ns.cluster_vectors(frame(spark, ties))) == brute(ties)
    few = ties[:3] + ODD[3:]
    assert rows_of(ns.cluster_vectors(frame(spark, few))) == brute(few)
    for none in ([], ODD[3:]):
        empty = ns.cluster_vectors(frame(spark, none))
        assert empty.count() == 0 and empty.schema["distance"].dataType.simpleString() == "bigint"


def test_other_settings(spark):
    rows = [(i, v[:5]) for i, v in blobs(80)]
    got = ns.cluster_vectors(frame(spark, rows, SCHEMA.replace("float", "double")), k=3, rounds=3, scale=100, dims=5, seed=9)
    brute_rows = [(i, v) for i, v in rows]
    want = brute_double(brute_rows)
    assert rows_of(got) == want


def brute_double(rows):
    saved = np.float32
    np.float32 = np.float64
    try:
        return brute(rows, k=3, rounds=3, scale=100, dims=5, seed=9)
    finally:
        np.float32 = saved


def test_bounds_hold_along_the_history():
    rng = np.random.default_rng(2)
    points = rng.integers(-1000, 1000, (500, 16))
    history = [points[:6].copy()]
    s = ns.Bounds.measured(points, history[0])
    for _ in range(12):
        history.append(history[-1] + rng.integers(-60, 60, history[0].shape))
        s.advance(points, history)
        exact = np.stack([ns.squared(points, c) for c in history[-1]], axis=1)
        assert (s.own == exact.argmin(axis=1)).all()
        moved = np.stack([np.sqrt(ns.squared(old, history[-1])) for old in history])
        low = s.lower - moved[s.lower_at, np.arange(6)]
        low[np.arange(500), s.own] = 0
        assert (low <= np.sqrt(exact) + 1e-6).all()
