"""Density clustering (DBSCAN) with Euclidean distance, exact.

Points are covered by two kinds of balls.  A tight ball has a diameter of at most
eps: all its points are neighbours, so from ``min_points`` points on they are core
points of one group without any counting, however many they are.  A loose ball
is wider but holds at most ``leaf_rows`` points, which one task compares.

Balls come from a tree over a bounded sample first, which every point descends at once, and
from splitting further where that leaves them too large.  Each point keeps its distances to a few far-apart pivots, each
ball their limits: two balls have nothing to do with each other if any pivot tells them
apart.  What is left is compared tile by tile, which answers with at most one link per point.

Only points still short of neighbours ask other balls; a ball wholly within or
wholly beyond eps answers as a whole, and the rest is compared point by point,
with the points of a crowded ball dealt out evenly over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.kernels import closest, first_within, groups_inside, hits_within, linking_pairs, matrix, neighbours_inside, sq_distances
from cairn.functions.vectors import distance
from cairn.operators.balls import BATCH_BYTES, FAN, LEAF, PIVOTS, SLACK, Cover, cover, grown, leaf, meet, numbered, numbered_pairs, stored, tile_pairs, widened
from cairn.operators.checks import require_numbers
from cairn.operators.graph import components
from cairn.session import cut, small_batches

MIN_POINTS = 5  # fixed value: a core point's neighbours within eps, itself included
SPREAD = 4096  # points of one ball compared by one task
PARTS = 16  # share of all points that a ball may hold beyond ``leaf_rows``
SAMPLE = 1 << 13  # points that the first balls and the pivots are taken from


def _tight(r: Column, eps: float) -> Column:
    return 2 * r <= eps


def _tree(sample: np.ndarray, rows: np.ndarray, most: int, rng) -> tuple | None:
    """(seeds, children) of a node over ``rows`` of the sample; null for a leaf of at most ``most`` rows or one place."""
    if len(rows) <= most or (sample[rows] == sample[rows[0]]).all():
        return None
    places = np.unique(sample[rows], axis=0)
    seeds = places[rng.choice(len(places), size=min(FAN, len(places), -(-len(rows) // most) + 1), replace=False)]
    near = sq_distances(sample[rows], seeds).argmin(axis=1)
    return seeds, [_tree(sample, rows[near == k], most, rng) for k in range(len(seeds))]


def _far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` points of the sample, each the farthest from those before it."""
    picked = [int(sq_distances(sample[:1], sample)[0].argmax())]
    least = sq_distances(sample[picked], sample)[0]
    while len(picked) < n:
        picked.append(int(least.argmax()))
        least = np.minimum(least, sq_distances(sample[picked[-1:]], sample)[0])
    return sample[picked]


def first_balls(points: DataFrame, leaf_rows: int) -> DataFrame:
    """``grp, id, x, t, ball, d, parent`` of every point: a leaf of the sample's tree and distances to the pivots.

    The tree's leaves are at most as many as the sample has points, so their pairs are of bounded number too.
    """
    kind = points.schema["point_id"].dataType.simpleString()
    work = points.select(F.lit(0).alias("grp"), F.col("point_id").alias("id"), F.col("features").alias("x"))
    shape = f"grp int, id {kind}, x array<double>, t array<double>, ball string, d double, parent string"
    number = work.count()
    drawn = work.select("x", F.xxhash64("id").alias("h")).orderBy("h", "x").limit(SAMPLE).toArrow()["x"].combine_chunks()
    sample = matrix(drawn)
    if not len(sample):
        return points.sparkSession.createDataFrame([], shape)
    most = max(4, int(0.5 * leaf_rows * len(sample) / max(number, 1)))
    tree = _tree(sample, np.arange(len(sample)), most, np.random.default_rng(1))
    pivots = _far_apart(sample, PIVOTS)

    def descend(node, x: np.ndarray, rows: np.ndarray, path: str, out: list, d: np.ndarray) -> None:
        if node is None or not len(rows):
            for r in rows.tolist():
                out[r] = path
            return
        seeds, children = node
        apart = sq_distances(x[rows], seeds)
        near = apart.argmin(axis=1)
        d[rows] = np.sqrt(apart[np.arange(len(rows)), near])
        for k, child in enumerate(children):
            descend(child, x, rows[near == k], path + chr(97 + k), out, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b["x"])
            paths, d = [""] * len(x), np.full(len(x), np.inf)
            descend(tree, x, np.arange(len(x)), "", paths, d)
            t = np.sqrt(sq_distances(x, pivots))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * PIVOTS), pa.array(t.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b["grp"], b["id"], b["x"], rows, pa.array(paths), pa.array(d), pa.array([""] * len(x))], names=["grp", "id", "x", "t", "ball", "d", "parent"])

    return cut(work.mapInArrow(run, shape))


def neighbourhood(points: DataFrame, eps: float, leaf_rows: int) -> Cover:
    """Tight and loose balls, and the pairs of them that come within eps."""
    reach = eps * (1 + SLACK)

    def told_apart(one: str, other: str) -> Column:
        gaps = F.zip_with(f"lo_{one}", f"hi_{other}", lambda low, high: low * (1 - SLACK) - high * (1 + SLACK))
        return F.exists(gaps, lambda g: g > reach)

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.filter((F.col("gap") - F.col("r_a") - F.col("r_b") <= reach) & ~told_apart("a", "b") & ~told_apart("b", "a"))

    work = first_balls(points, leaf_rows)
    roots = points.sparkSession.createDataFrame([(0, "", "")], "grp int, a string, b string")
    return cover(work, lambda n, r: _tight(r, eps) | (n <= leaf_rows), near, roots)


def _leaf_rows(points: DataFrame, leaf_rows: int) -> tuple[int, int]:
    """Points of a loose ball at most, and pairs of such balls that a task gets at a time."""
    size = points.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("dims")).first()
    rows = grown(leaf_rows, size.n, size.dims or 1, PARTS)
    return rows, max(1, BATCH_BYTES // (16 * rows * max(size.dims or 1, 1)))


def _sized(found: Cover) -> DataFrame:
    """``a, b, n_a, n_b``: both directions of every pair of two different balls, with their points."""
    two = found.pairs.filter(F.col("a") != F.col("b")).select("a", "b")
    for s in "ab":
        two = two.join(found.balls.select(F.col("ball").alias(s), F.col("n").alias(f"n_{s}")), s)
    return cut(two.unionByName(two.select(*[F.col(f"{c}{y}").alias(f"{c}{x}") for c in ("", "n_") for x, y in ("ab", "ba")])))


@dataclass
class _Balls:
    """Balls under numbers, for comparing their points tile by tile (`balls.meet`)."""

    named: DataFrame
    dims: int

    def tiles(self, points: DataFrame, entry: Column, *parts: str) -> DataFrame:
        """Points by ball, and ball and part, in rows sorted by ``entry``, whose field ``x`` is the vector."""
        packed = points.groupBy(F.lit(0).alias("grp"), "ball", *parts).agg(F.sort_array(F.collect_list(entry)).alias("p"))
        fields = [f.name for f in packed.schema["p"].dataType.elementType.fields if f.name != "x"]
        return stored(packed.select("grp", "ball", F.col("p.x").alias("xs"), *[F.col(f"p.{f}").alias(f) for f in fields]), self.named)

    def met(self, own: DataFrame, others: DataFrame, pairs: DataFrame, answer, shape: str) -> DataFrame:
        return meet(own, others, numbered_pairs(pairs.select(F.lit(0).alias("grp"), "a", "b"), self.named), self.dims, answer, shape)


def _numbered(found: Cover) -> _Balls:
    first = found.points.select(F.size("x").alias("dims")).first()
    dims = first.dims if first else 1
    return _Balls(numbered(found.balls, dims), dims)


def _reached(asking: DataFrame, pairs: DataFrame, shape: DataFrame, others: DataFrame, eps: float) -> DataFrame:
    """Points within eps of each asking point, counted by party: ``id, party, hits``.

    ``asking`` holds ``id, x, ball``; ``others`` the ``id, x, ball, party`` of the
    points that may be hit, where a ball's points of one party count together.
    """
    parties = others.groupBy("ball", "party").agg(F.count("*").alias("size")).join(shape, "ball").select(
        F.col("ball").alias("b"), "party", "size", "pivot", widened(F.col("r")).alias("r"),
        F.ceil(F.col("size") / SPREAD).alias("salts"))
    near = (
        asking.join(pairs, F.col("ball") == F.col("a")).join(parties, "b")
        .withColumn("far", distance("x", "pivot"))
        .filter(F.col("far") - F.col("r") <= eps * (1 + SLACK))
    )
    whole = F.col("far") * (1 + SLACK) + F.col("r") <= eps
    dealt = others.select(F.col("ball").alias("b"), "party", F.col("x").alias("y"), F.col("id").alias("other")).join(
        parties.select("b", "party", "salts"), ["b", "party"]).select(
        "b", "party", "y", F.pmod(F.xxhash64("other"), "salts").alias("salt"))
    compared = (
        near.filter(~whole)
        .select("id", "x", "b", "party", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        .join(dealt, ["b", "party", "salt"])
        .filter(distance("x", "y") <= eps)
        .groupBy("id", "party").agg(F.count("*").alias("hits"))
    )
    answers = near.filter(whole).select("id", "party", F.col("size").alias("hits")).unionByName(compared)
    return answers.groupBy("id", "party").agg(F.sum("hits").alias("hits"))


def _per_tile(points: DataFrame, answer, named: bool = False) -> DataFrame:
    """Apply a tile function to the points of every loose ball: ``ball, id, v``, the answer or the point that it numbers."""
    packed = points.groupBy("ball").agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias("p"))
    told = packed.select("ball", F.col("p.id").alias("id"), answer(F.col("p.x")).alias("v"))
    if named:
        told = told.withColumn("v", F.transform("v", lambda i: F.get("id", i)))
    return told.select("ball", F.explode(F.arrays_zip("id", "v")).alias("o")).select("ball", "o.id", "o.v")


def _kind(points: DataFrame) -> str:
    return points.schema["id"].dataType.simpleString()


def _core(found: Cover, balls: _Balls, sized: DataFrame, eps: float, min_points: int, leaf_rows: int) -> DataFrame:
    """``id, x, ball, tight, core`` of every point."""
    shape = found.balls.select("ball", "n", "pivot", "r")
    pts = cut(found.points.join(
        shape.select("ball", "n", _tight(widened(F.col("r")), eps).alias("tight")), "ball"
    ).select("id", "x", "ball", "n", "tight"))
    inside = _per_tile(pts.filter(~F.col("tight")), lambda xs: neighbours_inside(xs, F.lit(eps)))
    counted = cut(pts.join(inside.select("id", "v"), "id", "left").select(
        "id", "x", "ball", "tight", "n", F.when(F.col("tight"), F.col("n")).otherwise(F.col("v")).alias("own")))
    short = counted.filter(F.col("own") < min_points)
    few = counted.filter(F.col("n") <= leaf_rows)
    kind = _kind(counted)

    def counts(own: dict, others: list[dict]) -> dict:
        hits = sum(hits_within(own["x"], other["x"], eps) for other in others)
        return {"id": own["id"].values, "hits": pa.array(hits)}

    hits = balls.met(
        balls.tiles(short, F.struct("id", "x")), balls.tiles(few, F.struct("x")), sized.filter(F.col("n_b") <= leaf_rows), counts, f"id {kind}, hits long")
    crowds = sized.filter(F.col("n_b") > leaf_rows).select("a", "b")
    if not crowds.isEmpty():
        many = counted.filter(F.col("n") > leaf_rows).select("id", "x", "ball", F.lit("").alias("party"))
        hits = hits.unionByName(_reached(short, crowds, shape.drop("n"), many, eps).select("id", "hits"))
    total = F.col("own") + F.coalesce("hits", F.lit(0))
    return counted.join(hits.groupBy("id").agg(F.sum("hits").alias("hits")), "id", "left").select(
        "id", "x", "ball", "tight", "n", (total >= min_points).alias("core"))


def core_points(points: DataFrame, eps: float, min_points: int = MIN_POINTS, leaf_rows: int = LEAF) -> DataFrame:
    """Distance join with itself, reduced to the question DBSCAN asks of it.

    For every point: are at least ``min_points`` points, itself included, within
    eps?
    """
    leaf_rows, most = _leaf_rows(points, leaf_rows)
    found = neighbourhood(points, eps, leaf_rows)
    with small_batches(points.sparkSession, most):
        return cut(_core(found, _numbered(found), _sized(found), eps, min_points, leaf_rows).select(F.col("id").alias("point_id"), "core"))


def _parties(cores: DataFrame, eps: float) -> DataFrame:
    """Give every core point its party: core points of one ball linked within the ball."""
    loose = cores.filter(~F.col("tight"))
    inside = _per_tile(loose, lambda xs: groups_inside(xs, F.lit(eps)), named=True).select(
        "id", F.concat_ws("/", "ball", F.col("v").cast("string")).alias("party"))
    return cores.join(inside, "id", "left").select("id", "x", "ball", "n", F.coalesce("party", "ball").alias("party"))


def _linked(cores: DataFrame, balls: _Balls, shape: DataFrame, sized: DataFrame, eps: float, leaf_rows: int) -> DataFrame:
    """Pairs of parties ``(u, v)``, enough to connect all that hold core points within eps of each other.

    Balls are compared tile by tile where one of the two has at most ``leaf_rows`` points, so the work is
    linear in the other.  Two larger ones are tight, one party each, and need one link at most.
    """
    sized = sized.filter(F.col("a") < F.col("b"))
    small = (F.col("n_a") <= leaf_rows) | (F.col("n_b") <= leaf_rows)
    large = sized.filter(~small).select("a", "b")
    linked = _linked_tiles(cores, balls, sized.filter(small).select("a", "b"), eps, leaf_rows)
    return linked if large.isEmpty() else linked.unionByName(_linked_crowds(cores, shape, large, eps, leaf_rows))


def _linked_tiles(cores: DataFrame, balls: _Balls, pairs: DataFrame, eps: float, leaf_rows: int) -> DataFrame:
    """Links between parties of two balls, by tiles of at most about ``leaf_rows`` points."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / leaf_rows))
    tiles = balls.tiles(cores.withColumn("part", F.pmod(F.xxhash64("id"), parts)), F.struct("party", "x"), "part")

    def links(own: dict, others: list[dict]) -> dict:
        u, v, mine = [], [], own["party"].values.dictionary_encode()
        for other in others:
            theirs = other["party"].values.dictionary_encode()
            found = linking_pairs(own["x"], mine.indices.to_numpy(), other["x"], theirs.indices.to_numpy(), eps)
            u += [mine.dictionary[i].as_py() for i, _ in found]
            v += [theirs.dictionary[j].as_py() for _, j in found]
        return {"u": pa.array(u, pa.string()), "v": pa.array(v, pa.string())}

    return balls.met(tiles, tiles, pairs, links, "u string, v string").distinct()


def _linked_crowds(cores: DataFrame, shape: DataFrame, across: DataFrame, eps: float, leaf_rows: int) -> DataFrame:
    """Pairs of parties that hold core points within eps of each other.

    Parties whose first points are within eps are linked at once.  Of the other
    pairs, those already joined through further parties need no look; what is
    left is searched by splitting the points that face each other into ever
    smaller balls until two within eps turn up or none can.
    """
    party = cut(
        cores.groupBy("ball", "party").agg(F.min_by("x", "id").alias("some")).join(shape, "ball")
        .withColumn("r", widened(F.col("r"))))

    def side(s: str) -> DataFrame:
        return party.select(F.col("ball").alias(s), F.col("party").alias(f"party_{s}"),
                            F.col("some").alias(f"some_{s}"), F.col("pivot").alias(f"pivot_{s}"), F.col("r").alias(f"r_{s}"))

    near = cut(
        across.join(side("a"), "a").join(side("b"), "b")
        .withColumn("sure", distance("some_a", "some_b") <= eps))
    sure = near.filter("sure").select(F.col("party_a").alias("u"), F.col("party_b").alias("v"))
    unsure = near.filter(~F.col("sure"))
    if unsure.isEmpty():
        return sure
    joined = components(sure)

    def name(s: str) -> DataFrame:
        return joined.select(F.col("node").alias(f"party_{s}"), F.col("component").alias(f"c_{s}"))

    apart = cut(
        unsure.join(name("a"), "party_a", "left").join(name("b"), "party_b", "left")
        .filter(F.col("c_a").isNull() | F.col("c_b").isNull() | (F.col("c_a") != F.col("c_b")))
        .select(F.struct("party_a", "party_b").alias("grp"), "pivot_a", "pivot_b", "r_a", "r_b"))
    reach = eps * (1 + SLACK)

    def facing(own: str, other: str) -> DataFrame:
        seen = apart.select("grp", F.col(f"grp.party_{own}").alias("party"),
                            F.col(f"pivot_{other}").alias("p"), F.col(f"r_{other}").alias("r"))
        return cores.join(seen, "party").filter(distance("x", "p") <= reach + F.col("r")).select(
            "grp", "id", "x", F.lit(own.upper()).alias("ball"))

    def search(candidates: DataFrame) -> DataFrame:
        hits = candidates.groupBy("grp").agg(F.max(F.col("gap") <= eps).alias("hit"))
        possible = ~F.col("hit") & (F.col("gap") - F.col("r_a") - F.col("r_b") <= reach)
        return (
            candidates.join(hits, "grp").withColumn("settled", F.col("hit") & (F.col("gap") <= eps))
            .filter(F.col("settled") | possible))

    faces = facing("a", "b").unionByName(facing("b", "a"))
    roots = apart.select("grp", F.lit("A").alias("a"), F.lit("B").alias("b"))
    found = cover(faces, leaf(leaf_rows), search, roots)
    compared = tile_pairs(found).filter(F.sqrt(closest("xs_a", "xs_b")) <= eps).select("grp")
    hits = compared.unionByName(found.settled.select("grp")).distinct()
    return sure.unionByName(hits.select(F.col("grp.party_a").alias("u"), F.col("grp.party_b").alias("v")))


def dbscan(points: DataFrame, eps: float, min_points: int = MIN_POINTS, leaf_rows: int = LEAF) -> DataFrame:
    """``point_id, label``: the group of every point, or null for noise.

    A group is named by the smallest id among its core points.  A border point
    within reach of several groups joins the one with the smallest name, as a
    scan in id order would decide.  Features that are null or no finite numbers raise.
    """
    require_numbers(points)
    leaf_rows, most = _leaf_rows(points, leaf_rows)
    found = neighbourhood(points, eps, leaf_rows)
    with small_batches(points.sparkSession, most):
        return cut(_labelled(found, eps, min_points, leaf_rows))


def _labelled(found: Cover, eps: float, min_points: int, leaf_rows: int) -> DataFrame:
    shape, sized, balls = found.balls.select("ball", "pivot", "r"), _sized(found), _numbered(found)
    state = cut(_core(found, balls, sized, eps, min_points, leaf_rows))
    cores = cut(_parties(state.filter("core"), eps))
    named = components(_linked(cores, balls, shape, sized, eps, leaf_rows))
    first = cores.groupBy("party").agg(F.min("id").alias("first"))
    placed = first.join(named, F.col("party") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "party"))
    names = placed.groupBy("component").agg(F.min("first").alias("label"))
    labels = cut(placed.join(names, "component").select("party", "label"))
    labelled = cut(cores.join(labels, "party").select("id", "x", "ball", "n", "party", "label"))
    border = state.filter(~F.col("core"))
    itself = found.balls.select(F.col("ball").alias("a"), F.col("ball").alias("b"), F.col("n").alias("n_b"))
    pairs = sized.select("a", "b", "n_b").unionByName(itself)

    def joins(own: dict, others: list[dict]) -> dict:
        ids, labels = [], []
        for other in others:
            at = first_within(own["x"], other["x"], eps)
            ids.append(own["id"].values.take(pa.array(np.flatnonzero(at >= 0))))
            labels.append(other["label"].values.take(pa.array(at[at >= 0])))
        return {"id": pa.concat_arrays(ids), "label": pa.concat_arrays(labels)}

    kind = _kind(state)
    joined = balls.met(
        balls.tiles(border, F.struct("id", "x")), balls.tiles(labelled.filter(F.col("n") <= leaf_rows), F.struct("label", "x")),
        pairs.filter(F.col("n_b") <= leaf_rows), joins, f"id {kind}, label {kind}")
    crowds = pairs.filter(F.col("n_b") > leaf_rows).select("a", "b")
    if not crowds.isEmpty():
        hit = _reached(border, crowds, shape, labelled.filter(F.col("n") > leaf_rows).select("id", "x", "ball", "party"), eps)
        joined = joined.unionByName(hit.join(labels, "party").select("id", "label"))
    joined = joined.groupBy("id").agg(F.min("label").alias("label"))
    return state.select("id").join(labelled.select("id", "label").unionByName(joined), "id", "left").select(
        F.col("id").alias("point_id"), "label")
