"""Assignment, merging, chunked clustering and sweeps against brute force and by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import dbscan as brute_dbscan
from brute import merge_pass
from cairn.operators import density, merge, quality, ward
from cairn.operators import states as st
from cairn.operators.assign import assign, distance_matrix, nearest
from cairn.plans import sweep
from cairn.plans.bfr import Settings, bfr


def frame(spark, x, start=0):
    rows = [(start + i, [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "point_id long, features array<double>")


def state(spark, groups):
    rows = [(k, int(d), len(x), float(x[:, d].sum()), float((x[:, d] ** 2).sum())) for k, x in groups.items() for d in range(x.shape[1])]
    key = "set_key string" if isinstance(next(iter(groups)), str) else "cluster_id int"
    return spark.createDataFrame(rows, f"{key}, dim int, n long, s double, q double")


def test_states_add_up_and_overlap_is_refused(spark):
    x = np.random.default_rng(0).normal(size=(30, 4))
    a, b = frame(spark, x[:12]).withColumn("cluster_id", F.lit(1)), frame(spark, x[12:], 12).withColumn("cluster_id", F.lit(1))
    both, members = st.merge_checked(st.summarize(a), st.summarize(b), a.select("point_id"), b.select("point_id"))
    assert members.count() == 30
    for r in st.finish(both).collect():
        assert (r.n, r.centroid, r.variance) == (30, pytest.approx(x[:, r.dim].mean()), pytest.approx(x[:, r.dim].var()))
    with pytest.raises(ValueError, match="overlap"):
        st.merge_checked(st.summarize(a), st.summarize(a), a.select("point_id"), a.select("point_id"))


def test_assignment_edges(spark):
    # cluster 0: unit spread around 0; cluster 1: one point, no spread
    s = state(spark, {0: np.array([[-1.0, -1.0], [1.0, 1.0]]), 1: np.array([[9.0, 9.0]])})
    pts = frame(spark, [[0.0, 0.0], [2.0, 2.0], [9.0, 9.0], [9.0, 9.5], [1.999, 1.999]])
    got = {r.point_id: (r.cluster_id, r.distance) for r in assign(pts, s, 2.0, 2).collect()}
    assert got[0] == (0, 0.0)
    assert got[1][0] == -1  # exactly at the limit 2 * sqrt(2)
    assert got[2] == (1, 0.0)  # equal to the single point
    assert got[3][0] == -1 and got[3][1] == pytest.approx(np.sqrt(9**2 + 9.5**2))  # cluster 1 is endlessly far
    assert got[4][0] == 0


def test_tie_takes_the_lowest_cluster_and_blocks_do_not_matter(spark):
    s = state(spark, {i: np.array([[float(c) - 1, 0.0], [float(c) + 1, 1.0]]) for i, c in enumerate([0, 4, 4, 9])})
    pts = frame(spark, [[2.0, 0.5], [4.0, 0.5], [20.0, 0.5]])
    for cells in (1, 4, 1000):
        got = {r.point_id: r.cluster_id for r in nearest(pts, s, block_cells=cells).collect()}
        assert got == {0: 0, 1: 1, 2: 3}
        assert distance_matrix(pts, s, block_cells=cells).count() == 12


def test_negative_variance_by_rounding_adds_nothing(spark):
    s = spark.createDataFrame([(0, 0, 3, 0.3, 0.03 - 1e-17), (0, 1, 3, 0.0, 3.0)], "cluster_id int, dim int, n long, s double, q double")
    assert st.finish(s).filter("variance < 0").count() == 1
    got = assign(frame(spark, [[5.0, 1.0]]), s, 2.0, 2).first()
    assert (got.cluster_id, got.distance) == (0, 1.0)


@pytest.mark.parametrize("seed,alpha,leaf_rows", [(1, 1.1, 4), (2, 1.5, 256), (3, 3.0, 3)])
def test_merge_sets(spark, seed, alpha, leaf_rows):
    rng = np.random.default_rng(seed)
    groups = {f"{i:03d}": rng.normal(size=2) * 2 + rng.normal(size=(rng.integers(2, 7), 2)) * rng.uniform(0.1, 1.5) for i in range(14)}
    groups["014"] = groups["015"] = np.array([[3.0, 3.0], [3.0, 3.0]])  # no spread: never merge with each other
    expected = merge_pass([(len(x), x.sum(axis=0), (x**2).sum(axis=0), [k]) for k, x in groups.items()], alpha)
    keyed, first = merge.listed(state(spark, groups))
    left, names, _ = merge.merge_sets(keyed, alpha, leaf_rows=leaf_rows)
    name = {r.set_key: r.name for r in first.collect()}
    got = {}
    for r in names.collect():
        got.setdefault(r.new_key, []).append(name[r.old_key])
    order = [sorted(got[k]) for k in sorted(got)]
    assert order == [sorted(m) for *_, m in expected]
    sizes = {r.set_key: r.n for r in left.groupBy("set_key").agg(F.max("n").alias("n")).collect()}
    assert [sizes[k] for k in sorted(sizes)] == [n for n, *_ in expected]


def test_fold_finds_all_targets_first(spark):
    clusters = state(spark, {0: np.array([[0.0, 0.0]]), 1: np.array([[10.0, 0.0]])})
    sets = state(spark, {"a": np.array([[4.9, 0.0]] * 50), "b": np.array([[5.1, 0.0]] * 2), "c": np.array([[5.0, 0.0]])})
    goals = {r.set_key: r.cluster_id for r in merge.fold_targets(sets, clusters).collect()}
    assert goals == {"a": 0, "b": 1, "c": 0}
    n = {r.cluster_id: r.n for r in merge.fold(sets, clusters, merge.fold_targets(sets, clusters)).filter("dim = 0").collect()}
    assert n == {0: 52, 1: 3}


def brute_bfr(seed_groups, rest, chunks, deviations, alpha, eps):
    """The same algorithm on arrays; members are point numbers."""
    def summary(idx, x):
        return [len(idx), x.sum(axis=0), (x**2).sum(axis=0), list(idx)]

    ds = [summary(i, x) for i, x in seed_groups]
    cs, kept = [], []
    for chunk in chunks:
        x = rest[chunk]
        far = []
        dist = np.array([np.sqrt((((x - s / n) / np.sqrt(q / n - (s / n) ** 2)) ** 2).sum(axis=1)) for n, s, q, _ in ds])
        pick = dist.argmin(axis=0)
        for c in range(len(ds)):
            hit = (pick == c) & (dist.min(axis=0) < deviations * np.sqrt(x.shape[1]))
            n, s, q, m = ds[c]
            ds[c] = [n + hit.sum(), s + x[hit].sum(axis=0), q + (x[hit] ** 2).sum(axis=0), m + list(chunk[hit])]
        far = list(chunk[dist.min(axis=0) >= deviations * np.sqrt(x.shape[1])])
        pool = np.array(far + kept, dtype=int)
        if len(pool):
            label, _ = brute_dbscan(rest[pool], eps)
            for first in sorted({v for v in label if v is not None}):
                idx = pool[[i for i, v in enumerate(label) if v == first]]
                cs.append(tuple(summary(idx, rest[idx])))
            kept = [p for p, v in zip(pool, label) if v is None]
            kept.sort()
        cs = merge_pass(cs, alpha)
    return ds, cs, kept


@pytest.mark.parametrize("leaf_rows", [16, 256])
def test_bfr(spark, leaf_rows):
    rng = np.random.default_rng(11)
    centres = np.array([[0.0, 0.0], [8.0, 0.0], [0.0, 8.0]])
    seed = np.concatenate([c + rng.normal(size=(15, 2)) for c in centres])
    dense = np.concatenate([np.array([4.0, 4.0]) + rng.normal(size=(40, 2)) * 0.3, np.array([12.0, 12.0]) + rng.normal(size=(30, 2)) * 0.3])
    rest = np.concatenate([centres[rng.integers(0, 3, 90)] + rng.normal(size=(90, 2)), dense, rng.uniform(-20, 20, size=(20, 2))])
    rest = rest[rng.permutation(len(rest))]
    settings = Settings(clusters=3, deviations=1.8, alpha=1.1, eps=0.5, max_bytes=24 * 70, leaf_rows=leaf_rows)
    n = 1 + len(rest) // 70
    chunks = [np.flatnonzero(np.arange(len(rest)) % n == c) for c in range(n)]
    labels = frame(spark, seed, 1000).withColumn("cluster_id", ((F.col("point_id") - 1000) / 15).cast("int"))
    ds, cs, kept = brute_bfr([(range(1000 + 15 * i, 1015 + 15 * i), seed[15 * i : 15 * i + 15]) for i in range(3)], rest, chunks, 1.8, 1.1, 0.5)

    r = bfr(frame(spark, seed, 1000), frame(spark, rest), settings, seed_labels=labels, hashed=F.col("point_id"))
    members = r.membership.collect()
    assert len(members) == len({m.point_id for m in members}) == len(seed) + len(rest)
    by_set = {}
    for m in members:
        by_set.setdefault((m.set_kind, m.set_id), set()).add(m.point_id)
    assert {p for (k, _), v in by_set.items() if k == "retained" for p in v} == set(kept)
    assert {frozenset(v) for (k, _), v in by_set.items() if k == "discard"} == {frozenset(map(int, d[3])) for d in ds}
    assert len(cs) > 1
    assert {frozenset(v) for (k, _), v in by_set.items() if k == "compression"} == {frozenset(map(int, c[3])) for c in cs}
    for row in r.discard.collect():
        n_, s_, q_, _ = ds[row.cluster_id]
        assert (row.n, row.s, row.q) == (n_, pytest.approx(s_[row.dim]), pytest.approx(q_[row.dim]))
    total = r.clusters.filter("dim = 0").agg(F.sum("n")).first()[0]
    assert total == len(seed) + len(rest) - len(kept) == r.assignment.count()


def test_sweep_resumes(spark, tmp_path):
    assert sweep.grid(spark, sweep.STANDARD_GRID).count() == 50
    rng = np.random.default_rng(5)
    seed, rest = rng.normal(size=(12, 2)), rng.normal(size=(20, 2)) * 2
    tracks = spark.createDataFrame([(str(i), "[1]") for i in range(20)], "track_id string, `track-genres_all` string")
    genres = spark.createDataFrame([("1", "0", "Rock")], "genre_id string, parent string, title string")
    path, base = str(tmp_path / "sweep"), Settings(clusters=2, eps=0.5)
    seed, rest = frame(spark, seed, 100), frame(spark, rest)
    first = sweep.run(seed, rest, tracks, genres, {"deviations": [2.0]}, path, base)
    assert first.agg(F.sum("points")).first()[0] == 32
    todo = sweep.pending(sweep.grid(spark, {"deviations": [2.0, 1.0]}), first)
    assert [r.deviations for r in todo.collect()] == [1.0]
    both = sweep.run(seed, rest, tracks, genres, {"deviations": [2.0, 1.0]}, path, base)
    assert {r["count"] for r in spark.read.parquet(f"{path}/counts").collect()} and spark.read.parquet(f"{path}/counts").columns[:3] == ["cluster_id", "genre_title", "count"]
    assert sorted(r.deviations for r in both.select("deviations").distinct().collect()) == [1.0, 2.0]
    assert {r.points for r in both.groupBy("deviations").agg(F.sum("points").alias("points")).collect()} == {32}
    assert spark.read.parquet(f"{path}/portions").count() >= 2


def test_sweep_shares_a_clustering_between_folds(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    seed = frame(spark, rng.normal(size=(12, 2)), 100)
    rest = frame(spark, np.concatenate([rng.normal(size=(10, 2)), np.array([9.0, 9.0]) + rng.normal(size=(12, 2)) * 0.1]))
    tracks = spark.createDataFrame([(str(i), "[1]") for i in range(22)], "track_id string, `track-genres_all` string")
    genres = spark.createDataFrame([("1", "0", "Rock")], "genre_id string, parent string, title string")
    runs = []
    monkeypatch.setattr(sweep, "bfr", lambda *a: runs.append(1) or bfr(*a))
    path, base = str(tmp_path / "sweep"), Settings(clusters=2, eps=0.5)
    sweep.run(seed, rest, tracks, genres, {"alpha": [1.1], "fold": [False, True]}, path, base)
    assert len(runs) == 1
    counted = {str(r.fold) == "true": r.n for r in spark.read.parquet(f"{path}/counts").filter("cluster_id IS NOT NULL").groupBy("fold").agg(F.sum("count").alias("n")).collect()}
    alone = {f: bfr(seed, rest, Settings(clusters=2, eps=0.5, alpha=1.1, fold=f)).assignment.filter("point_id < 22").count() for f in (False, True)}
    assert counted[True] - counted[False] == alone[True] - alone[False] > 0


def test_keys_of_any_length_stay_apart(spark):
    groups = {f"{10 ** 21 + i}": np.array([[float(i), 0.0], [float(i), 1.0]]) for i in range(6)}
    groups["-5"] = np.array([[99.0, 0.0], [99.0, 1.0]])
    keyed, first = merge.listed(state(spark, groups))
    assert first.select("set_key").distinct().count() == first.select("name").distinct().count() == 7
    assert [r.name for r in first.orderBy("set_key").collect()] == sorted(groups)
    late = merge.ranked(keyed.select("set_key").distinct(), 1_000_000, "set_key", "to")
    assert late.filter(F.col("to") <= F.col("set_key")).isEmpty()


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_bad_features_raise(spark, bad):
    rows = [(i, [float(i), 1.0]) for i in range(10)] + [(10, [bad, 1.0])]
    points = spark.createDataFrame(rows, "point_id long, features array<double>")
    for use in (lambda: ward.ward(points, 2, leaf_rows=4), lambda: density.dbscan(points, 1.0), lambda: bfr(points.filter("point_id < 5"), points.filter("point_id >= 5"), Settings(clusters=2))):
        with pytest.raises(ValueError, match="non-finite"):
            use()
    with pytest.raises(ValueError, match="non-finite"):
        density.dbscan(spark.createDataFrame([(1, None)], "point_id long, features array<double>"), 1.0)
    with pytest.raises(ValueError, match="entries"):
        density.dbscan(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "point_id long, features array<double>"), 1.0)


def test_radius_does_not_shuffle_points_by_cluster(spark):
    points = spark.createDataFrame([(i, [float(i), 0.0], i % 2) for i in range(100)], "point_id long, features array<double>, cluster_id int")
    r = {x.cluster_id: x.radius for x in quality.radius(points).collect()}
    assert r == {0: pytest.approx(49.0), 1: pytest.approx(49.0)}
    assert "hashpartitioning(cluster_id" not in quality.radius(points)._jdf.queryExecution().executedPlan().toString().split("Join")[-1].replace("salt", "")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        far = quality.radius(points)
        assert {x.cluster_id: x.radius for x in far.collect()} == r
        plan = far._jdf.queryExecution().executedPlan().toString()
        assert all("salt" in line for line in plan.splitlines() if "Exchange hashpartitioning(cluster_id" in line and "partial" not in line and line.count("cluster_id") > 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_round_settles_a_prefix_of_the_list(spark, monkeypatch):
    # 24 sets that could all merge with each other: 12 pairs in a pass
    groups = {f"{i:02d}": np.array([[0.0, 0.0], [1.0, 1.0]]) for i in range(24)}
    keyed, _ = merge.listed(state(spark, groups))
    sets = st.as_vectors(keyed, ["s", "q"], merge.KEY)
    rounds, original = [], merge._partners
    monkeypatch.setattr(merge, "_partners", lambda *a: rounds.append(1) or original(*a))
    pairs = merge.matching(sets, 1.1, leaf_rows=8).orderBy("lo").collect()
    order = [r.set_key for r in keyed.select("set_key").distinct().orderBy("set_key").collect()]
    assert [(r.lo, r.hi) for r in pairs] == list(zip(order[::2], order[1::2]))
    assert len(rounds) <= 3


def test_fixture_points_have_outliers_groups_and_merges(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    kinds = {r.set_kind: r.n for r in entry.bfr_leftover(spark, sf).groupBy("set_kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["compression"] > 20 and kinds["retained"] > 20
    merged = entry.cs_merge(spark, sf)
    sets, left = merged.count(), merged.select("first_name").distinct().count()
    assert 1 < left < sets


@pytest.mark.parametrize("offset", [0.0, 1e8, -3e8])
def test_variances_far_from_zero(spark, offset):
    x = np.random.default_rng(4).normal(size=(400, 3)) * [1.0, 1e-2, 30.0] + offset
    x[:, 2] = x[0, 2]  # no spread at all
    whole = frame(spark, x).withColumn("cluster_id", F.lit(1))
    got = {r.dim: r for r in st.finish(st.summarize(whole)).collect()}
    for d in range(3):
        assert got[d].variance == pytest.approx(x[:, d].var(), rel=1e-6, abs=1e-12)
        assert (got[d].n, got[d].s, got[d].q) == (400, pytest.approx(x[:, d].sum()), pytest.approx((x[:, d] ** 2).sum()))
    parts = [st.summarize(whole.filter(F.col("point_id").between(a, b))) for a, b in ((0, 0), (1, 3), (4, 150), (151, 399))]
    orders = [st.merge(*parts), st.merge(*parts[::-1]), st.merge(st.merge(parts[2], parts[0]), st.merge(parts[3], parts[1]))]
    for merged in orders:
        for r in st.finish(merged).collect():
            # a mean is known to its last digits only; beside a spread of 1 that is no matter up to 1e8
            digits = 4 * np.finfo(float).eps * abs(offset) / max(x[:, r.dim].std(), 1e-300)
            rel = 1e-9 if r.dim == 0 and abs(offset) <= 1e8 else max(1e-9, digits)
            assert r.n == 400 and r.variance == pytest.approx(got[r.dim].variance, rel=rel, abs=1e-12)


def test_cells_of_nulls_only_merge_to_nulls(spark):
    points = spark.createDataFrame([(1, [None, 2.0], 0), (2, [None, 4.0], 0)], "point_id long, features array<double>, cluster_id int")
    merged = {r.dim: r for r in st.finish(st.merge(st.summarize(points), st.summarize(points.limit(0)))).collect()}
    assert (merged[0].n, merged[0].s, merged[0].m2, merged[0].variance) == (0, None, None, None)
    assert (merged[1].n, merged[1].variance) == (2, 1.0)


def test_merging_does_not_depend_on_where_zero_is(spark):
    rng = np.random.default_rng(11)
    groups = {f"{i:02d}": rng.normal(size=2) * 2 + rng.normal(size=(5, 2)) for i in range(20)}
    passes = []
    for offset in (0.0, 1e8):
        rows = [(i, k, [float(v) for v in p + offset]) for k, x in groups.items() for i, p in enumerate(x)]
        states = st.summarize(spark.createDataFrame(rows, "point_id int, set_key string, features array<double>"), merge.KEY)
        sets = st.as_vectors(states, ["s", "q", "m2"], merge.KEY)
        first = {r.set_key: tuple(r.best) for r in merge.first_pairs(sets, 1.2, 6).collect()}
        assert first == {r.set_key: tuple(r.best) for r in merge.first_pairs(sets, 1.2).collect()}  # tiles of any size
        keyed, names = merge.listed(states)
        word = {r.set_key: r.name for r in names.collect()}
        pairs = merge.matching(st.as_vectors(keyed, ["s", "q", "m2"], merge.KEY), 1.2, 8).collect()
        passes.append((first, sorted((word[r.lo], word[r.hi]) for r in pairs)))
    assert passes[0] == passes[1] and passes[0][1]


def test_small_chunks_take_no_jobs_of_their_own(spark, monkeypatch):
    """Chunks smaller than the jobs over them: the driver makes their steps, with the results of steps over tables."""
    from cairn.plans import bfr as plan

    rng = np.random.default_rng(21)
    seed = np.concatenate([rng.normal(c, 0.3, size=(12, 2)) for c in (0.0, 8.0)])
    spots = rng.uniform(-4, 12, size=(6, 2))
    rest = frame(spark, np.concatenate(
        [rng.normal(c, 0.4, size=(20, 2)) for c in (0.0, 8.0)] + [rng.normal(s, 0.15, size=(9, 2)) for s in spots] + [rng.uniform(-9, 18, size=(30, 2))]))
    labels = frame(spark, seed, 1000).withColumn("cluster_id", (F.col("point_id") >= 1012).cast("int"))
    settings = Settings(clusters=2, deviations=1.5, alpha=1.3, eps=0.4, max_bytes=24 * 60, leaf_rows=16)
    searched, original = [], plan.dbscan
    monkeypatch.setattr(plan, "dbscan", lambda *a: searched.append(1) or original(*a))

    def told():
        r = bfr(frame(spark, seed, 1000), rest, settings, seed_labels=labels, hashed=F.col("point_id") * 7919)
        sets = {}
        for m in r.membership.collect():
            sets.setdefault((m.set_kind, m.set_id), []).append(m.point_id)
        kinds = sorted((kind, name if kind == "discard" else "", sorted(ids)) for (kind, name), ids in sets.items())
        states = {(c.cluster_id, c.dim): (c.n, c.s, c.q, c.m2) for c in r.clusters.collect()}
        return kinds, sorted(map(tuple, r.assignment.collect())), sorted(p.point_id for p in r.retained.collect()), states

    held = told()
    assert not searched and held[2] and sum(kind == "compression" for kind, _, _ in held[0]) >= 2
    monkeypatch.setattr(plan, "HELD_BYTES", 200)  # the driver gives the loop over after the first chunk
    tables = told()
    assert len(searched) == 2 and held[:3] == tables[:3] and held[3].keys() == tables[3].keys()
    assert all(held[3][k] == pytest.approx(tables[3][k], rel=1e-9, abs=1e-9) for k in held[3])


def test_outliers_that_share_an_id_are_left_to_the_tables():
    from cairn.plans.held import Held, States

    x = np.random.default_rng(2).normal(size=(10, 2))
    held = Held([0], States.of(x, np.zeros(10, int), 1), 2, Settings(deviations=1.0, eps=0.1))
    far, rank = np.array([[50.0, 50.0], [60.0, 60.0], [0.0, 0.0]]), np.array([4, 4, 4])
    assert not held.chunk(far, rank, np.arange(3)) and not held.near and not len(held.x) and held.discard.n[0, 0] == 10
    assert held.chunk(far[[0, 2]], rank[:2], np.arange(2)) and len(held.x) == 1
