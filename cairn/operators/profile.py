"""Profile of clusters by root genre."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUTSIDE = "none"  # matrix column of tracks without a cluster


def root_genres(genres: DataFrame) -> DataFrame:
    """Genres without a parent, with their number."""
    return genres.filter(F.col("parent").try_cast("int") == 0).select(
        F.col("genre_id").try_cast("int").alias("genre_no"), "genre_id", "title"
    )


def sorted_root_genres(genres: DataFrame) -> DataFrame:
    """Root genres in numeric order of their id."""
    return root_genres(genres).orderBy("genre_no")


def genre_colors(genres: DataFrame, colors: DataFrame) -> DataFrame:
    """Colour of each root genre."""
    return root_genres(genres).join(colors, "genre_id").select("genre_id", "title", "genre_color")


def track_genres(tracks: DataFrame, column: str = "track-genres_all") -> DataFrame:
    """One row per track and listed genre; null or malformed lists give none."""
    ids = F.from_json(F.col(f"`{column}`"), "array<string>")
    keep = [c for c in tracks.columns if c != column]
    return tracks.select(*[F.col(f"`{c}`") for c in keep], F.explode(ids).alias("genre_id"))


def null_portion(df: DataFrame, column: str) -> DataFrame:
    """Share of rows where the column is null, in one pass."""
    return df.agg(F.avg(F.col(f"`{column}`").isNull().cast("double")).alias("portion"))


def genre_counts(tracks: DataFrame, genres: DataFrame, membership: DataFrame,
                 column: str = "track-genres_all") -> DataFrame:
    """Tracks per (cluster, root genre); a null cluster holds tracks outside all clusters.

    A track counts once for each of its root genres.  The cluster is joined
    before the genre lists are unfolded, so one row per track is shuffled, and
    the genre tree, a small dimension, is left to Spark's size-checked
    broadcast.
    """
    placed = tracks.select("track_id", F.col(f"`{column}`")).join(membership, "track_id", "left")
    roots = root_genres(genres).select("genre_id", F.col("title").alias("genre_title"))
    return (
        track_genres(placed, column)
        .join(roots, "genre_id")
        .groupBy("cluster_id", "genre_title")
        .agg(F.count("track_id").alias("count"))
    )


def genre_count_map(counts: DataFrame) -> DataFrame:
    """One ``map<genre, count>`` per cluster; as long as the list of root genres."""
    entries = F.sort_array(F.collect_list(F.struct("genre_title", "count")))
    return counts.groupBy("cluster_id").agg(F.map_from_entries(entries).alias("genre_counts"))


def _matrix(df: DataFrame, value: str, clusters: Sequence[int], row: str, fill) -> DataFrame:
    names = [OUTSIDE, *[str(c) for c in clusters]]
    label = F.coalesce(F.col("cluster_id").cast("string"), F.lit(OUTSIDE))
    return (
        df.withColumn("label", label)
        .groupBy(row)
        .pivot("label", names)
        .agg(F.sum(value))
        .fillna(fill)
    )


def genre_matrix(counts: DataFrame, genres: DataFrame, clusters: Sequence[int]) -> DataFrame:
    """Genre by cluster, the null cluster first; every root genre has a row."""
    roots = root_genres(genres).select(F.col("title").alias("genre_title"))
    return roots.join(_matrix(counts, "count", clusters, "genre_title", 0), "genre_title", "left").fillna(0)


def top_genres(counts: DataFrame, n: int = 3) -> DataFrame:
    """The n commonest genres per cluster; equal counts by genre name."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc("count"), "genre_title")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_genre_portions(counts: DataFrame, n: int = 3) -> DataFrame:
    """Share of each genre among its cluster's n commonest."""
    w = Window.partitionBy("cluster_id")
    return top_genres(counts, n).withColumn("portion", F.col("count") / F.sum("count").over(w))


def top_portion_matrix(counts: DataFrame, clusters: Sequence[int], n: int = 3) -> DataFrame:
    """Those shares as genre by cluster, 0 where a genre is not among the commonest."""
    return _matrix(top_genre_portions(counts, n), "portion", clusters, "genre_title", 0.0)
