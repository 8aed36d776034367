"""Splitting a table: by subset, by hash, into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BYTES_PER_CELL = 8  # a double


def in_subset(df: DataFrame, tracks: DataFrame, subset: str, key: str = "track_id",
              column: str = "set-subset") -> DataFrame:
    """Rows of ``df`` whose key is a track of the subset."""
    return df.join(tracks.filter(F.col(f"`{column}`") == subset).select(key), key, "left_semi")


def not_in_subset(df: DataFrame, tracks: DataFrame, subset: str, key: str = "track_id",
                  column: str = "set-subset") -> DataFrame:
    """Rows of ``df`` whose key is no track of the subset."""
    return df.join(tracks.filter(F.col(f"`{column}`") == subset).select(key), key, "left_anti")


def random_split(df: DataFrame, weights: list[float], seed: int) -> list[DataFrame]:
    """Random parts; repeatable only while the partitioning of ``df`` stays the same."""
    return df.randomSplit(weights, seed=seed)


def hash_split(df: DataFrame, bucket: Column, test_buckets: int = 1) -> tuple[DataFrame, DataFrame]:
    """Train and test by a per-row bucket number: the same rows on any cluster.

    Rows with ``bucket < test_buckets`` are the test part.  Nothing is shuffled
    and the parts cannot overlap.
    """
    return df.filter(bucket >= test_buckets), df.filter(bucket < test_buckets)


def chunk_count(total_rows: int, n_columns: int, max_bytes: int) -> int:
    """Chunks needed so that each stays near ``max_bytes`` when held as doubles."""
    rows_per_chunk = max(1, max_bytes // (BYTES_PER_CELL * n_columns))
    return 1 + total_rows // rows_per_chunk


def assign_chunks(df: DataFrame, n_chunks: int, hashed: Column | None = None) -> DataFrame:
    """Add the chunk number of each row, drawn from its key's hash."""
    h = F.xxhash64("point_id") if hashed is None else hashed
    return df.withColumn("chunk", F.pmod(h, F.lit(n_chunks)).cast("int"))
