"""Radius, diameter and density of clusters, and their summary over several k."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.kernels import largest_sq_distance
from cairn.functions.vectors import distance
from cairn.operators.balls import LEAF, Cover, cover, leaf, meet, numbered, numbered_pairs, stored, tiles
from cairn.operators.states import centroids
from cairn.session import cut, small_batches


def density(n: Column, length: Column) -> Column:
    """Points per squared length; infinite for a cluster without extent."""
    return F.when(length == 0, F.lit(float("inf"))).otherwise(F.try_divide(n, length * length))


#: Parts that the points of one cluster are dealt over where centroids are too many to broadcast.
SALTS = 64
#: A cluster is cut into tiles of about this share of the largest one, as a tile goes to all tiles it is compared
#: with, but into tiles of ``TILE_BYTES`` at most, some of which a task gets at a time.
TILES = 16
TILE_BYTES, BATCH_BYTES = 1 << 21, 1 << 26


def radius(points: DataFrame, keys: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """Largest distance of a member to its cluster's centroid, and size per squared radius.

    Centroids are written first, so Spark knows their size: while it is small they are broadcast and
    points stay where they are; beyond that points are dealt by cluster and a salt.
    """
    middle = cut(centroids(points, keys).drop("n"))
    salted = middle.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = points.withColumn("salt", F.pmod(F.xxhash64("point_id"), F.lit(SALTS)).cast("int"))
    far = dealt.join(salted, [*keys, "salt"]).groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(distance("features", "centroid")).alias("radius"))
    return far.withColumn("density_r", density(F.col("n"), F.col("radius")))


def _may_be_farthest(pairs: DataFrame) -> DataFrame:
    seen = F.greatest("best", "gap", distance("far_a", "far_b"))
    best = pairs.groupBy("grp").agg(F.max(seen).alias("best"))
    reach = F.col("gap") + F.col("r_a") + F.col("r_b")
    return pairs.drop("best").join(best, "grp").filter(reach >= F.col("best"))


def tile_pairs(found: Cover) -> DataFrame:
    """``grp, best``: the largest distance within the surviving pairs of tiles, of each tile in turn."""
    dims = found.points.select(F.size("x").alias("dims")).first()
    named = numbered(found.balls, dims.dims if dims else 1)
    rows = stored(tiles(found.points).select("grp", "ball", "xs"), named)

    def widest(own: dict, others: list[dict]) -> dict:
        best = 0.0
        for other in others:
            best = largest_sq_distance(own["x"], other["x"], best)
        return {"no": pa.array([own["no"]]), "best": pa.array([best])}

    best = meet(rows, rows, numbered_pairs(found.pairs, named), dims.dims if dims else 1, widest, "no long, best double")
    return named.join(best, "no").select("grp", F.sqrt("best").alias("best"))


def diameter(points: DataFrame, keys: tuple[str, ...] = ("cluster_id",), leaf_rows: int = LEAF) -> DataFrame:
    """Largest distance between two members of a cluster, and size per squared diameter.

    Exact.  The distance of two known points is a lower limit; pairs of balls
    that cannot reach it are dropped together with their points.  Where points lie so evenly
    that bounds drop nothing, as in many dimensions, leaves meet all leaves of
    their cluster: the distances are then quadratic in it, in tiles spread over tasks.  Leaves
    hold ``leaf_rows`` points or a fixed share of the largest cluster, ``TILE_BYTES`` at most, and are sent to tasks
    by blocks (`balls.meet`), so that what is written is linear in the points.
    """
    grp = F.struct(*keys)
    work = points.select(grp.alias("grp"), F.col("point_id").alias("id"), F.col("features").alias("x"))
    sizes = cut(points.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.size("features")).alias("dims")))
    most = sizes.agg(F.max("n").alias("n"), F.max("dims").alias("dims")).first()
    row_bytes = 8 * max(most.dims or 1, 1)
    leaf_rows = max(leaf_rows, min(TILE_BYTES // row_bytes, -(-(most.n or 0) // TILES)))
    roots = work.select("grp").distinct().select(
        "grp", F.lit("").alias("a"), F.lit("").alias("b"), F.lit(0.0).alias("best"))
    found = cover(work, leaf(leaf_rows), _may_be_farthest, roots, extra=("best",))
    with small_batches(points.sparkSession, max(1, BATCH_BYTES // (2 * leaf_rows * row_bytes))):
        both = found.pairs.select("grp", "best").unionByName(tile_pairs(found))
        widest = cut(both.groupBy("grp").agg(F.max("best").alias("diameter")).select("grp.*", "diameter"))
    return sizes.drop("dims").join(widest, list(keys)).withColumn("density_d", density(F.col("n"), F.col("diameter")))


def metrics(points: DataFrame, keys: tuple[str, ...] = ("k", "cluster_id"), leaf_rows: int = LEAF) -> DataFrame:
    """All four metrics of every cluster."""
    return radius(points, keys).join(diameter(points, keys, leaf_rows).drop("n"), list(keys))


def sweep_summary(per_cluster: DataFrame, drop_singletons: bool = False) -> DataFrame:
    """Mean and sample variance of both densities over the clusters of each k."""
    if drop_singletons:
        per_cluster = per_cluster.filter(F.col("n") > 1)

    def var(c: str) -> Column:
        endless = F.max(F.col(c)) == float("inf")
        finite = F.when(F.col(c) != float("inf"), F.col(c))
        return F.when(endless, F.lit(float("nan"))).otherwise(F.var_samp(finite))

    return per_cluster.groupBy("k").agg(
        F.avg("density_r").alias("avg_density_r"), F.avg("density_d").alias("avg_density_d"),
        var("density_r").alias("var_density_r"), var("density_d").alias("var_density_d"),
    )


def zscores(summary: DataFrame) -> DataFrame:
    """Each metric's z-score over the tried k, by population deviation: ``metric, k, value, z``."""
    names = [c for c in summary.columns if c != "k"]
    long = summary.unpivot("k", names, "metric", "value")
    w = Window.partitionBy("metric")
    z = F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w))
    return long.withColumn("z", z)
