"""Distances of points to clusters and assignment to the nearest.

Cluster states are (clusters x dimensions) numbers, set by parameters and not by
the data.  They go to every task in blocks of bounded size; the points, however
many, are read once per block and not shuffled.  The functions are marked
non-deterministic only so that Spark does not run them again for a filter on
their result.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from cairn.functions.kernels import matrix
from cairn.operators.states import as_vectors, finish
from cairn.session import cut, forget

OUTLIER = -1
BLOCK_CELLS = 4_000_000  # cluster x dimension cells sent to the tasks at a time (32 MB)


class Block(NamedTuple):
    """Ids, centroids and variances of some clusters, in id order."""

    ids: list
    centroid: np.ndarray
    variance: np.ndarray


def _block(rows) -> Block:
    return Block([r.cluster_id for r in rows], np.array([r.centroid for r in rows], float),
                 np.array([r.variance for r in rows], float))


def cluster_blocks(states: DataFrame, block_cells: int = BLOCK_CELLS):
    """Cluster states in blocks of at most ``block_cells`` cells, by ascending cluster id."""
    wide = as_vectors(finish(states), ["centroid", "variance"]).orderBy("cluster_id")
    rows, cells = [], 0
    for r in wide.toLocalIterator():
        if rows and cells + len(r.centroid) > block_cells:
            yield _block(rows)
            rows, cells = [], 0
        rows.append(r)
        cells += len(r.centroid)
    if rows:
        yield _block(rows)


def mahalanobis(x: np.ndarray, centroid: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """Distance with a diagonal covariance.

    A dimension without spread adds 0 where the point sits on the centroid and
    infinity elsewhere, where a centroid rounded in its last digits still counts as the point's own
    place; a variance rounded below zero adds 0.
    """
    spread = np.sqrt(np.where(variance > 0, variance, 1.0))
    z = np.where(variance > 0, (x - centroid) / spread, 0.0)
    off = ((variance == 0) & (np.abs(x - centroid) > 1e-14 * np.abs(centroid))).any(axis=1)
    return np.where(off, np.inf, np.sqrt((z * z).sum(axis=1)))


def euclidean(x: np.ndarray, centroid: np.ndarray, variance: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centroid) ** 2).sum(axis=1))


def _all(spark, block: Block, measure):
    held = spark.sparkContext.broadcast(tuple(block))

    @arrow_udf(ArrayType(DoubleType()))
    def distances(x: pa.Array) -> pa.Array:
        (ids, centroid, variance), points = held.value, matrix(x)
        table = np.array([measure(points, c, v) for c, v in zip(centroid, variance)]).reshape(len(ids), len(points))
        offsets = np.arange(len(points) + 1, dtype=np.int32) * len(ids)
        return pa.ListArray.from_arrays(offsets, pa.array(table.T.ravel()))

    return distances.asNondeterministic()


def _nearest(spark, block: Block, measure, id_type):
    held = spark.sparkContext.broadcast(tuple(block))

    @arrow_udf(StructType([StructField("distance", DoubleType()), StructField("cluster_id", id_type)]))
    def nearest(x: pa.Array) -> pa.Array:
        (ids, centroid, variance), points = held.value, matrix(x)
        best, which = np.full(len(points), np.inf), np.zeros(len(points), np.int64)
        for i, (c, v) in enumerate(zip(centroid, variance)):
            d = measure(points, c, v)
            closer = d < best
            best[closer], which[closer] = d[closer], i
        picked = np.array(ids)[which]
        return pa.StructArray.from_arrays([pa.array(best), pa.array(picked)], ["distance", "cluster_id"])

    return nearest.asNondeterministic(), held


def distance_matrix(points: DataFrame, states: DataFrame, measure=mahalanobis,
                    block_cells: int = BLOCK_CELLS) -> DataFrame:
    """``point_id, cluster_id, distance`` of every point to every cluster."""
    parts = []
    for block in cluster_blocks(states, block_cells):
        names = F.array(*[F.lit(i) for i in block.ids])
        table = _all(points.sparkSession, block, measure)("features")
        cells = points.select("point_id", F.posexplode(table).alias("at", "distance"))
        parts.append(cells.select("point_id", F.get(names, "at").alias("cluster_id"), "distance"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nearest(points: DataFrame, states: DataFrame, measure=mahalanobis,
            block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Points with ``distance`` and ``cluster_id`` of the nearest cluster, lowest id on ties.

    A task and the driver hold one block of states at a time, ``block_cells`` numbers of each kind.  Where
    there are several blocks, the points are written with their best answer after each one,
    and the block's broadcast is released.
    """
    id_type = states.schema["cluster_id"].dataType
    now, best, step, held = points, None, None, None
    for block in cluster_blocks(states, block_cells):
        if best is not None:  # the blocks before are done with: their answer is kept, not their states
            before, step = step, cut(now.withColumn("nearest", best))
            held.unpersist()
            forget(before)
            now = step
        measured, held = _nearest(points.sparkSession, block, measure, id_type)
        found = measured("features")
        best = found if step is None else F.least(F.col("nearest"), found)
    if best is None:
        raise ValueError("no clusters to assign to")
    return now.withColumn("nearest", best).select(*points.columns, "nearest.distance", "nearest.cluster_id")


def assign(points: DataFrame, states: DataFrame, deviations: float, dimensions: int,
           block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Nearest cluster of each point, or -1 at ``deviations * sqrt(dimensions)`` and beyond."""
    limit = math.sqrt(deviations**2 * dimensions)
    near = nearest(points, states, mahalanobis, block_cells)
    return near.withColumn(
        "cluster_id", F.when(F.col("distance") >= limit, F.lit(OUTLIER)).otherwise(F.col("cluster_id")))
