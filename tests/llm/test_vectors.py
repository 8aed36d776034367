"""Top-k search and near-duplicate vectors against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import near_vector, top_k
from tests.llm import plain


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, embedding array<float>, label int, mark int, Block string")


def vectors(n=400, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 2:n // 2 + 60] = x[0] + rng.standard_normal((60, dims)) * 0.05  # one dense group
    x[-30:] = x[1]  # copies
    return [(i, [float(np.float32(c)) for c in v], int(rng.integers(0, 3)) if i < n // 2 else 0) for i, v in enumerate(x)]


ODD = [(1000, None, 0), (1001, [], 0), (1002, [float("nan")] * 12, 0), (1003, [None] + [0.5] * 11, 0), (1004, [float("inf")] + [0.0] * 11, 1), (1005, [0.0] * 12, 0), (1006, [0.1] * 12, None),
       (1007, [0.5, 0.5], 0), (1050, [0.5, 0.5], 0), (1009, [3e30] * 12, 0), (1010, [1e-30] * 12, 0)]


def brute_top(rows, every, k):
    usable = [(i, np.floor(256 * np.array(v, float)).astype(object)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    usable = [(i, np.array([int(x) for x in v], dtype=object)) for i, v in usable]
    out = set()
    for q, v in usable:
        if q % every == 0:
            best = sorted((-int(sum(a * b for a, b in zip(v, w))), i) for i, w in usable if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "CANDIDATES", block)
    monkeypatch.setattr(top_k, "QUERIES", 7)
    rows = [*vectors(), *(r for r in ODD if r[0] != 1009), (20, vectors()[20][1], 0)]
    got = top_k.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    want = brute_top(rows, 20, 5)
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want)


def test_top_k_joined_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BROADCAST", 0)
    rows = vectors(160)[:120]
    assert {tuple(r) for r in top_k.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, k=3).collect()} == brute_top(rows, 20, 3)


def test_top_k_of_large_numbers_and_few_rows(spark):
    rows = [(0, [3e6, -2e6], 0), (50, [3e6, 1e6], 0), (2, [-3e6, 5.0], 0)]
    assert {tuple(r) for r in top_k.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()} == brute_top(rows, 50, 5)
    assert top_k.top_k(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert top_k.top_k(frame(spark, rows[:1]), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_with_ties():
    rng = random.Random(3)
    for _ in range(30):
        n, d = rng.randint(1, 60), rng.randint(1, 5)
        v = np.array([[rng.randint(-3, 3) for _ in range(d)] for _ in range(n)])
        q = np.array([[rng.randint(-3, 3) for _ in range(d)] for _ in range(4)])
        ids, own = np.arange(n), np.array([0, 1, 5, 99])
        got = top_k.no_random_access(v, ids, q, own, 3)
        for j in range(4):
            mine = {(i, s) for a, i, s in got if a == j}
            scores = sorted(((-int(v[i] @ q[j]), i) for i in range(n) if i != own[j]))
            kth = scores[min(3, len(scores)) - 1][0] if scores else 0
            assert {(i, -s) for s, i in scores if s <= kth} <= mine or not scores


@pytest.mark.parametrize("leaf, tile", [(512, 1024), (20, 16)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, leaf, tile):
    monkeypatch.setattr(near_vector, "LEAF", leaf)
    monkeypatch.setattr(near_vector, "TILE", tile)
    rows = [*vectors(), *ODD, (3, vectors()[1][1], 0)]
    got = near_vector.near_vectors(frame(spark, rows)).collect()
    links, least = plain.vector_links(*zip(*rows))
    want = sorted(zip([r[0] for r in rows], links, least))
    found = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    assert len(found) == len(want) and [f[0] for f in found] == [w[0] for w in want]
    assert all(f[1] <= w[1] for f, w in zip(found, want))
    assert sum(f[1] for f in found) >= 0.97 * sum(w[1] for w in want)
    assert np.mean([f[2] == w[2] for f, w in zip(found, want)]) > 0.97
    if leaf == 512:
        assert found == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_near_vectors_of_nothing(spark):
    assert near_vector.near_vectors(frame(spark, [])).count() == 0
