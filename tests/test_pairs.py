"""Pair searches, components, density and Ward against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import dbscan as brute_dbscan
from brute import distances
from brute import ward as brute_ward
from cairn.functions import kernels
from cairn.operators import balls, density, quality, ward
from cairn.operators.graph import components


def frame(spark, x, cluster=None):
    rows = [(i, [float(v) for v in p], int(cluster[i]) if cluster is not None else 0) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "point_id long, features array<double>, cluster_id int").repartition(8)


def clumps(rng, n, d):
    centres = rng.normal(size=(4, d)) * 4
    x = centres[rng.integers(0, 4, n)] + rng.normal(size=(n, d)) * 0.5
    x[: n // 3] = x[0]  # a third of all points is one point
    return x


@pytest.mark.parametrize("d,leaf_rows", [(2, 8), (5, 4), (3, 256)])
def test_diameter(spark, d, leaf_rows):
    x = clumps(np.random.default_rng(d), 300, d)
    cluster = np.arange(300) % 3
    got = {r.cluster_id: r.diameter for r in quality.diameter(frame(spark, x, cluster), leaf_rows=leaf_rows).collect()}
    for c in range(3):
        assert got[c] == pytest.approx(distances(x[cluster == c]).max(), abs=1e-12)


def test_diameter_sends_points_to_few_tiles(spark, monkeypatch):
    """Points that lie so evenly that no bound drops a pair: tiles grow with the cluster, so pairs of them do not."""
    tiles = []
    found_pairs = quality.tile_pairs
    monkeypatch.setattr(quality, "tile_pairs", lambda found: (tiles.append(found.pairs.count()), found_pairs(found))[1])
    monkeypatch.setattr(quality, "TILES", 4)
    for n in (400, 1600):
        x = np.random.default_rng(n).normal(size=(n, 48))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        got = quality.diameter(frame(spark, x), leaf_rows=16).first()
        assert got.diameter == pytest.approx(distances(x).max(), abs=1e-12) and got.n == n
    assert tiles[1] < 2 * tiles[0]  # 16 times as many if tiles stayed as they were


def test_diameter_holds_no_pairs_of_vectors(spark, monkeypatch):
    """Tiles meet by blocks sent to the tasks, here of a few tiles; a pair of tiles never carries its vectors."""
    shapes, found_pairs = [], quality.tile_pairs
    monkeypatch.setattr(quality, "tile_pairs", lambda found: (out := found_pairs(found), shapes.append(out.columns))[0])
    monkeypatch.setattr(balls, "HELD_BYTES", 8 * 5 * 60)
    x, cluster = np.random.default_rng(8).normal(size=(200, 5)), np.arange(200) % 2
    got = {r.cluster_id: r.diameter for r in quality.diameter(frame(spark, x, cluster), leaf_rows=12).collect()}
    for c in range(2):
        assert got[c] == pytest.approx(distances(x[cluster == c]).max(), abs=1e-12)
    assert shapes == [["grp", "best"]]


def test_dbscan_compares_tiles_by_blocks(spark, monkeypatch):
    """Neighbours, links and border points from several blocks, also of tight balls larger than a tile."""
    blocks, found = [], density.meet
    monkeypatch.setattr(density, "meet", lambda own, others, pairs, *a: (blocks.append(pairs.select("block_b").distinct().count()), found(own, others, pairs, *a))[1])
    monkeypatch.setattr(balls, "HELD_BYTES", 8 * 2 * 40)
    x = clumps(np.random.default_rng(2), 240, 2)
    expected, _ = brute_dbscan(x, 0.3)
    got = {r.point_id: r.label for r in density.dbscan(frame(spark, x), 0.3, leaf_rows=8).collect()}
    assert [got[i] for i in range(len(x))] == expected and len(blocks) == 3 and max(blocks) > 2


def test_products_of_matrices_give_the_same_digits():
    """Searches by matrix products answer as sums in order do, also where points lie far out, on a grid or beyond squares."""
    rng = np.random.default_rng(6)
    for d, scale, shift in ((2, 1, 0), (24, 1, 0), (3, 1e-3, 1e4), (3, 1e160, 0)):
        x, y = (np.round(rng.normal(size=(n, d)), 1) * scale + shift for n in (300, 200))
        with np.errstate(over="ignore", invalid="ignore"):
            exact = kernels.sq_distances(x, y)
            assert kernels.largest_sq_distance(x, y) == exact.max()
            for eps in (0.0, 0.4, np.sqrt(np.median(exact))):
                assert (kernels._close(x, y, eps) == (np.sqrt(exact) <= eps)).all()
            n, at = rng.integers(1, 9, 300).astype(float), np.arange(0, 300, 3)
            costs = kernels.sq_distances(x, x) * (n[:, None] * n / (n[:, None] + n))
            np.fill_diagonal(costs, np.inf)
            cost, which = kernels.cheapest_of(x, n, at)
        assert (cost == costs[at].min(axis=1)).all()
        assert scale > 1e100 or (which == costs[at].argmin(axis=1)).all()


def test_diameter_of_one_point_is_zero_and_dense_without_end(spark):
    row = quality.diameter(frame(spark, np.array([[1.0, 2.0]]))).first()
    assert row.diameter == 0 and row.density_d == float("inf")


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(chain + hub + [(5, 5)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1050)}}


@pytest.mark.parametrize("seed,d,eps,leaf_rows", [(1, 2, 0.35, 8), (2, 2, 0.2, 4), (3, 3, 0.5, 16), (4, 6, 1.2, 8), (5, 2, 0.3, 256)])
def test_dbscan(spark, seed, d, eps, leaf_rows):
    x = clumps(np.random.default_rng(seed), 240, d)
    expected, core = brute_dbscan(x, eps)
    got = {r.point_id: r.label for r in density.dbscan(frame(spark, x), eps, leaf_rows=leaf_rows).collect()}
    assert [got[i] for i in range(len(x))] == expected
    cores = {r.point_id: r.core for r in density.core_points(frame(spark, x), eps, leaf_rows=leaf_rows).collect()}
    assert [cores[i] for i in range(len(x))] == list(core)


@pytest.mark.parametrize("d,eps", [(2, 0.3), (8, 1.5)])
def test_dbscan_beyond_the_sample(spark, monkeypatch, d, eps):
    monkeypatch.setattr(density, "SAMPLE", 24)  # so that balls of the sample's tree have to split further
    x = clumps(np.random.default_rng(9), 240, d)
    expected, core = brute_dbscan(x, eps)
    got = {r.point_id: r.label for r in density.dbscan(frame(spark, x), eps, leaf_rows=6).collect()}
    assert [got[i] for i in range(len(x))] == expected


def test_compared_pairs_of_points(spark):
    x = clumps(np.random.default_rng(3), 400, 2)
    found = density.neighbourhood(frame(spark, x), 0.2, 16)
    n = {r.ball: r.n for r in found.balls.collect()}
    compared = sum(n[r.a] * n[r.b] if r.a != r.b else n[r.a] ** 2 / 2 for r in found.pairs.collect() if max(n[r.a], n[r.b]) <= 16)
    assert sum(n.values()) == 400 and compared < 0.1 * 400 * 400 / 2


def test_dbscan_border_point_between_two_groups_and_exact_eps(spark):
    left = [[-3.0 - 0.01 * i, 0.0] for i in range(5)]
    right = [[3.0 + 0.01 * i, 0.0] for i in range(5)]
    x = np.array(right + left + [[0.0, 0.0], [0.0, 50.0]])
    got = {r.point_id: r.label for r in density.dbscan(frame(spark, x), 3.0, leaf_rows=2).collect()}
    assert [got[i] for i in range(12)] == [0] * 5 + [5] * 5 + [0, None]


def partition(rows):
    out = {}
    for r in rows:
        out.setdefault(r.cluster_id, set()).add(r.point_id)
    return {frozenset(v) for v in out.values()}


def test_ward_searches_only_where_partners_went(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(150, 3))
    log = []
    pts = frame(spark, x)
    cuts = ward.labels(pts, ward.history(pts, leaf_rows=10, log=log), [4]).collect()
    assert partition(cuts) == brute_ward(x, 4)
    searched, alive = zip(*log)
    assert searched[0] == alive[0] == 150 and all(a < 0.9 * b for a, b in log[1:])
    assert list(searched) == sorted(searched, reverse=True) and searched[-1] < 50


@pytest.mark.parametrize("leaf_rows", [6, 256])
def test_ward(spark, leaf_rows):
    x = np.random.default_rng(7).normal(size=(40, 3))
    x[5] = x[6]
    pts = frame(spark, x)
    cuts = ward.labels(pts, ward.history(pts, leaf_rows=leaf_rows), [1, 2, 5, 9]).collect()
    for k in (1, 2, 5, 9):
        assert partition([r for r in cuts if r.k == k]) == brute_ward(x, k)


def test_ward_makes_few_pairs_and_rounds(spark, monkeypatch):
    """Points that lie so evenly that no bound drops a pair."""
    met = []
    found_pairs = ward._dealt
    monkeypatch.setattr(ward, "_dealt", lambda *a: (found := found_pairs(*a), met.append(found.count()))[0])
    x = np.random.default_rng(5).normal(size=(60, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    log, pts = [], frame(spark, x)
    cuts = ward.labels(pts, ward.history(pts, leaf_rows=4, log=log), [5]).collect()
    assert partition(cuts) == brute_ward(x, 5)
    assert log and met and max(met) <= 36 and log[-1][1] > 15


@pytest.mark.parametrize("at_once", [1, 1 << 22])
def test_ward_searches_kept_clusters_without_tables(spark, monkeypatch, at_once):
    """Clusters that the driver can keep: no round goes over tables, which took some ten jobs each; ties as there."""
    met = []
    found_partners = ward._best_partners
    monkeypatch.setattr(ward, "_best_partners", lambda *a: met.append(1) or found_partners(*a))
    monkeypatch.setattr(ward, "TILE", 8)
    monkeypatch.setattr(ward, "AT_ONCE", at_once)
    rng = np.random.default_rng(17)
    even, grid = rng.normal(size=(70, 6)), np.unique(rng.integers(0, 4, size=(30, 2)), axis=0).astype(float)
    pts, tied = frame(spark, even), frame(spark, grid)
    cuts = ward.labels(pts, ward.history(pts, leaf_rows=4), [4]).collect()
    assert partition(cuts) == brute_ward(even, 4)
    held = sorted(map(tuple, ward.history(tied, leaf_rows=4).collect()))
    assert not met
    if at_once > 1:
        monkeypatch.setattr(ward, "HELD_ROWS", 0)
        assert held == sorted(map(tuple, ward.history(tied, leaf_rows=4).collect())) and met


def test_dbscan_meets_few_pairs_of_balls(spark, monkeypatch):
    """Points that lie so evenly that no bound drops a pair: balls grow with the points, so pairs of them do not."""
    pairs = []
    found_balls = density.neighbourhood
    monkeypatch.setattr(density, "neighbourhood", lambda *a: (found := found_balls(*a), pairs.append(found.pairs.count()))[0])
    monkeypatch.setattr(density, "PARTS", 4)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in (60, 240):
        x = np.random.default_rng(n).normal(size=(n, 24))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        core = brute_dbscan(x, 0.9)[1]
        got = {r.point_id: r.core for r in density.core_points(frame(spark, x), 0.9, leaf_rows=4).collect()}
        assert [got[i] for i in range(n)] == list(core)
    assert pairs[1] < 3 * pairs[0]  # 16 times as many if balls stayed as they were
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


def test_sweep_summary_and_zscores(spark):
    rows = [(k, c, 1.0 * k + c, 2.0 * k * (c + 1)) for k in (2, 3) for c in range(k)]
    per = spark.createDataFrame(rows, "k int, cluster_id int, density_r double, density_d double").withColumn("n", F.lit(2))
    s = {r.k: r for r in quality.sweep_summary(per).collect()}
    assert s[3].var_density_r == pytest.approx(np.var([3, 4, 5], ddof=1))
    z = {(r.metric, r.k): r.z for r in quality.zscores(quality.sweep_summary(per)).collect()}
    assert z["avg_density_r", 2] == pytest.approx(-1) and z["avg_density_r", 3] == pytest.approx(1)
    endless = per.withColumn("density_d", F.when(F.col("cluster_id") == 0, float("inf")).otherwise(F.col("density_d")))
    r = quality.sweep_summary(endless).first()
    assert r.avg_density_d == float("inf") and np.isnan(r.var_density_d)


def test_components_leave_one_step(spark):
    import os

    from cairn.operators.graph import components
    from cairn.session import new_path

    folder = os.path.dirname(new_path(spark, "x"))
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    named = components(chain)
    assert {r.component for r in named.collect()} == {0} and named.count() == 41
    assert len(set(os.listdir(folder)) - before) == 1


def test_few_edges_are_joined_in_two_steps_and_many_in_rounds(spark, monkeypatch):
    from cairn.operators import graph

    order = np.random.default_rng(4).permutation(3000).tolist()
    rows = [(a, b) for i, (a, b) in enumerate(zip(order, order[1:])) if i != 1000] + [(7, 7), (None, 3), (order[0], order[1])]
    edges = spark.createDataFrame(rows, "u long, v long").repartition(16)
    steps, plain, together = [], graph.cut, "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(together, False)  # as where partitions are many and large
    monkeypatch.setattr(graph, "cut", lambda df: (steps.append(df), plain(df))[1])
    few = sorted(map(tuple, components(edges).collect()))
    assert len(steps) == 2
    monkeypatch.setattr(graph, "HELD", 40)
    assert sorted(map(tuple, components(edges).collect())) == few
    spark.conf.unset(together)
    assert len(steps) - 2 > 2  # the rounds that few edges took as well
    assert dict(few) == {n: min(part) for part in (order[:1001], order[1001:]) for n in part}
