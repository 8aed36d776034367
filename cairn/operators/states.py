"""Mergeable cluster states: count, sum, sum of squares and central moment per cluster and dimension.

A state table has the key columns plus ``dim INT, n BIGINT, s DOUBLE, q DOUBLE, m2 DOUBLE``; ``m2`` is the
sum of squared deviations from the mean, and variances come from it alone: ``q / n`` less the squared mean has no
digit left where values lie far from zero.  States of separate data add up, so Spark combines them map-side
and only (cluster, dimension) cells are shuffled, however large a cluster is.

States made elsewhere may lack ``m2``; it is then taken from the sums, with their rounding.  Null values
are not counted; a cell of nulls only has ``n`` 0 and all else null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("cluster_id",)
CELL = ("n", "s", "q", "m2")


def summarize(points: DataFrame, keys: Sequence[str] = KEYS, vec: str = "features") -> DataFrame:
    """State of every group of points."""
    x = F.col("x")
    return (
        points.select(*keys, F.posexplode(vec).alias("dim", "x"))
        .groupBy(*keys, "dim")
        .agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(x * x).alias("q"),
             (F.var_pop("x") * F.count("x")).alias("m2"))
    )


def with_moment(states: DataFrame) -> DataFrame:
    """States with ``m2``, from the sums where it isn't there."""
    if "m2" in states.columns:
        return states
    return states.withColumn("m2", F.col("q") - F.col("s") * F.col("s") / F.col("n"))


def merge(*states: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add states with equal keys.

    The part of ``m2`` that lies between the states is summed around the least of their means, which is
    as near to the common mean as they are to each other, wherever zero is.  The states of one cell
    meet by one shuffle, which the sums use again.
    """
    every = reduce(DataFrame.unionByName, [with_moment(s).select(*keys, "dim", *CELL) for s in states])
    mean = F.col("s") / F.col("n")
    away, n = F.col("away"), F.col("n")
    placed = every.withColumn("away", mean - F.min(mean).over(Window.partitionBy(*keys, "dim")))
    between = F.sum(n * away * away) - F.sum(n * away) * F.sum(n * away) / F.sum("n")
    return placed.groupBy(*keys, "dim").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        (F.sum("m2") + F.greatest(between, F.lit(0.0))).alias("m2"))


def finish(states: DataFrame) -> DataFrame:
    """Add centroid, population variance and standard deviation.

    The variance of states without ``m2`` can be rounded to just below zero, whose root is not a number;
    the deviation is null then.
    """
    var = F.col("m2") / F.col("n")
    return with_moment(states).withColumns(
        {"centroid": F.col("s") / F.col("n"), "variance": var, "std": F.when(var >= 0, F.sqrt(F.abs(var)))}
    )


def centroids(points: DataFrame, keys: Sequence[str] = KEYS, vec: str = "features") -> DataFrame:
    """Plain mean of each group as a vector."""
    means = summarize(points, keys, vec).withColumn("centroid", F.col("s") / F.col("n"))
    return as_vectors(means, ["centroid"], keys)


def as_vectors(long: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Long form back to one row per key; each vector has one entry per dimension."""
    cells = F.sort_array(F.collect_list(F.struct("dim", *columns)))
    packed = long.groupBy(*keys).agg(F.first("n").alias("n"), cells.alias("cells"))
    return packed.select(*keys, "n", *[F.col(f"cells.{c}").alias(c) for c in columns])


def overlaps(membership: DataFrame, key: str = "point_id") -> DataFrame:
    """Points found in more than one set; empty when the sets are disjoint."""
    return membership.groupBy(key).agg(F.count("*").alias("sets")).filter(F.col("sets") > 1)


def merge_checked(a: DataFrame, b: DataFrame, members_a: DataFrame, members_b: DataFrame,
                  keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Add two state tables and unite their members; fails if the members overlap."""
    members = members_a.unionByName(members_b)
    if not overlaps(members).isEmpty():
        raise ValueError("the sets to merge overlap: a point is in more than one of them")
    return merge(a, b, keys=keys), members


def set_sizes(membership: DataFrame) -> DataFrame:
    """Points per kind of set."""
    return membership.groupBy("set_kind").agg(F.count("*").alias("points"))
