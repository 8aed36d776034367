"""Rating prediction against dense vectors, and item blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import item_blocks, ratings


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id int, item_id int, rating int").repartition(8)


def dense_predictions(train, test, users, block):
    """The prediction formula on zero-filled, centred item vectors."""
    r = {(u, i): x for u, i, x in train}
    items = sorted({i for _, i, _ in train})
    mu = np.mean([x for *_, x in train])
    item_mean = {i: np.mean([x for _, j, x in train if j == i]) for i in items}
    user_mean = {u: np.mean([x for v, _, x in train if v == u]) for u in {u for u, *_ in train}}
    vec = {i: np.array([r.get((u, i), 0) - item_mean[i] for u in users]) for i in items}
    out = {}
    for u, i, _ in test:
        if i not in item_mean or u not in user_mean:
            continue
        near = [j for j in items if (u, j) in r and block(j) == block(i)]
        if not near:
            continue
        norms = {j: np.linalg.norm(vec[i]) * np.linalg.norm(vec[j]) for j in near}
        sims = {j: vec[i] @ vec[j] / norms[j] for j in near if norms[j] > 0}
        base = user_mean[u] + item_mean[i] - mu
        dev = {j: r[u, j] - (user_mean[u] + item_mean[j] - mu) for j in sims}
        total = sum(sims.values())
        out[u, i] = base + sum(sims[j] * dev[j] for j in sims) / total if sims and total else None
    return out


@pytest.mark.parametrize("limit", [0, 3, 6, 1000])
def test_predict_light_and_heavy(spark, limit):
    rng = np.random.default_rng(3)
    pairs = [(u, i) for u in range(1, 13) for i in range(1, 25) if rng.random() < (0.95 if u == 1 else 0.4)]
    rows = [(u, i, int(rng.integers(1, 6))) for u, i in pairs]
    test = [x for n, x in enumerate(rows) if n % 6 == 0] + [(1, 99, 3), (77, 2, 4)]  # item, then user, not trained on
    train = [x for n, x in enumerate(rows) if n % 6]
    everyone = sorted({u for u, *_ in rows} | {77})
    t, s = frame(spark, train), frame(spark, test)
    blocks = t.select("item_id").distinct().withColumn("cluster_id", F.col("item_id") % 3)
    mu, n, users = ratings.totals(t, t.unionByName(s))
    assert (n, users) == (len(train), len(everyone))
    got = {(r.user_id, r.item_id): r.predicted_rating for r in ratings.predict(s, t, blocks, mu, users, limit).collect()}
    expected = dense_predictions(train, test, everyone, lambda i: i % 3)
    assert set(got) == set(expected)
    for k, v in expected.items():
        assert got[k] == (pytest.approx(v, abs=1e-9) if v is not None else None)


def test_users_of_popular_items_are_not_heavy(spark):
    """Many users of few items: no group goes through all ratings of its items once per user."""
    rng = np.random.default_rng(5)
    rows = [(u, i, int(rng.integers(1, 6))) for u in range(60) for i in range(12) if rng.random() < 0.9]
    rows += [(99, i, 1 + i % 5) for i in range(200, 240)]  # alone with its items: heavy, its pairs are more
    test, train = rows[::7], [x for n, x in enumerate(rows) if n % 7]
    t, s = frame(spark, train), frame(spark, test)
    blocks = t.select("item_id").distinct().withColumn("cluster_id", F.lit(0))
    mu, _, users = ratings.totals(t, t.unionByName(s))
    placed = ratings._placed(t, t, blocks, mu, users)
    assert {r.user_id for r in ratings._tag_heavy(placed, 5).filter("heavy").select("user_id").distinct().collect()} == {99}
    got = {(r.user_id, r.item_id): r.predicted_rating for r in ratings.predict(s, t, blocks, mu, users, 5).collect()}
    expected = dense_predictions(train, test, sorted({u for u, *_ in rows}), lambda i: 0)
    assert set(got) == set(expected)
    for k, v in expected.items():
        assert got[k] == (pytest.approx(v, abs=1e-8) if v is not None else None)


@pytest.mark.parametrize("limit", [0, 1000])
def test_pair_without_rated_neighbour_lowers_only_the_reference_rmse(spark, limit):
    train = frame(spark, [(1, 1, 5), (2, 1, 3), (2, 3, 1), (3, 3, 4), (1, 2, 2), (3, 1, 2)])
    test = frame(spark, [(1, 3, 4), (3, 2, 4), (1, 9, 1)])
    blocks = train.select("item_id").distinct().withColumn("cluster_id", F.col("item_id") % 2)
    mu, _, users = ratings.totals(train, train.unionByName(test))
    asked = test.withColumnRenamed("rating", "true_rating")
    p = ratings.predict(asked, train, blocks, mu, users, limit)
    assert [(r.user_id, r.item_id) for r in p.collect()] == [(1, 3)]  # item 2 is alone in its block
    r = ratings.rmse(p, asked, train).first()
    assert (r.predicted, r.known) == (1, 2) and r.rmse_reference == pytest.approx(r.rmse / np.sqrt(2))
    c = ratings.coverage(test, train).first()
    assert (c.test_pairs, c.untested, c.untested_share) == (3, 1, pytest.approx(1 / 3))


def test_constant_item_has_no_similarity(spark):
    # both users rate item 1 the same: its centred vector is zero
    train = frame(spark, [(1, 1, 3), (2, 1, 3), (1, 2, 4)])
    test = frame(spark, [(2, 2, 5)]).withColumnRenamed("rating", "true_rating")
    blocks = spark.createDataFrame([(1, 0), (2, 0)], "item_id int, cluster_id int")
    for limit in (0, 1000):
        mu, _, users = ratings.totals(train, train)
        p = ratings.predict(test, train, blocks, mu, users, limit).collect()
        assert len(p) == 1 and p[0].predicted_rating is None


def planted(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(24):
        group = i % 3
        for u in range(30):
            if u % 3 == group or rng.random() < 0.05:
                rows.append((u, i, int(rng.integers(4, 6)) if u % 3 == group else 1))
    return frame(spark, rows)


def test_item_blocks_find_planted_groups(spark):
    got = item_blocks.item_blocks(planted(spark), k=3, min_divisible=1.0).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.cluster_id, set()).add(r.item_id % 3)
    assert len(got) == 24 and sorted(map(sorted, groups.values())) == [[0], [1], [2]]


def brute_blocks(rows, k, least, seed, rounds):
    """The same bisecting k-means on dense vectors."""
    users, items = sorted({u for u, _, _ in rows}), sorted({i for _, i, _ in rows})
    x = np.zeros((len(items), len(users)))
    for u, i, r in rows:
        x[items.index(i), users.index(u)] = r
    nudge = np.array([(u * 7919 + seed * 104729) % 1000 / 1000 * 1e-2 for u in users])
    node, stuck, enough = np.ones(len(items), int), set(), max(1.0, least if least >= 1 else least * len(items))
    while True:
        sizes = {n: int((node == n).sum()) for n in np.unique(node).tolist()}
        chosen = sorted((n for n, c in sizes.items() if c >= enough and c > 1 and n not in stuck), key=lambda n: (-sizes[n], n))[: k - len(sizes)]
        if not chosen:
            return {i: sorted(sizes).index(n) for i, n in zip(items, node.tolist())}
        first = max(sizes) + 1
        for at, n in enumerate(chosen):
            mine, side = np.flatnonzero(node == n), None
            mean = x[mine].mean(axis=0)
            centres = [mean * (1 - nudge), mean * (1 + nudge)]
            for _ in range(rounds):
                cost = np.array([c @ c - 2 * x[mine] @ c for c in centres])
                now = (cost[1] < cost[0]).astype(int)
                if side is not None and (now == side).all():
                    break
                side = now
                centres = [x[mine][side == s].mean(axis=0) if (side == s).any() else np.full(len(users), np.nan) for s in (0, 1)]
                if not (side == 0).any() or not (side == 1).any():
                    break
            node[mine] = first + 2 * at + side
            if len(set(side.tolist())) == 1:
                stuck |= {first + 2 * at, first + 2 * at + 1}


@pytest.mark.parametrize("k,least", [(5, 0.2), (5, 1.0), (4, 3.0)])
def test_item_blocks_equal_dense_vectors(spark, k, least):
    t = planted(spark)
    rows = [(r.user_id, r.item_id, r.rating) for r in t.collect()]
    got = {r.item_id: r.cluster_id for r in item_blocks.item_blocks(t, k=k, min_divisible=least).collect()}
    assert got == brute_blocks(rows, k, least, 1, item_blocks.ROUNDS)


def test_a_pair_is_rated_once(spark):
    train = frame(spark, [(1, 1, 3), (1, 1, 4), (2, 1, 3)])
    blocks = spark.createDataFrame([(1, 0)], "item_id int, cluster_id int")
    with pytest.raises(ValueError, match="once|times"):
        ratings.predict(frame(spark, [(2, 1, 3)]), train, blocks, 3.0, 2, 10)


def test_entries_hold_every_rating(spark):
    t = planted(spark)
    back = item_blocks.entries(t)
    assert back.count() == t.count() and back.exceptAll(t.select("item_id", "user_id", F.col("rating").cast("double"))).isEmpty()
