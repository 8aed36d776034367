"""Inputs for the registered queries, each derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OCTANTS = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points64(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding as a vector of doubles, with its label as a fixed cluster."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("point_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").alias("cluster_id"),
    )


def octant():
    """Fixed cluster of a point: the signs of its first three coordinates."""
    f = F.col("features")
    return ((f[0] > 0).cast("int") * 4 + (f[1] > 0).cast("int") * 2 + (f[2] > 0).cast("int"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding in all its dimensions, with the sign pattern of three as cluster."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("point_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.when(F.col("label") < 2, "small").otherwise("large").alias("set-subset"),
    ).withColumn("cluster_id", octant())


def seed_points(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).filter(F.col("`set-subset`") == "small").drop("set-subset")


def other_points(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).filter(F.col("`set-subset`") != "small").drop("set-subset", "cluster_id")


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """A track per embedding: subset, top genre and the JSON list of genre ids."""
    n = F.col("vec_id") % 25
    e = (
        table(spark, sf, "embeddings").withColumn("n", n).join(
            table(spark, sf, "nation"), F.col("n") == F.col("n_nationkey"))
        .withColumn("root", F.col("n_regionkey") + 1)
        .withColumn("second", F.col("label") % 5 + 1)
    )
    two = (F.col("label") % 3 == 0) & (F.col("root") != F.col("second"))
    listed = F.concat_ws(
        ", ", (100 + F.col("n_nationkey")).cast("string"), F.col("root").cast("string"),
        F.when(two, F.col("second").cast("string")))
    return e.select(
        F.col("vec_id").cast("string").alias("track_id"),
        F.when(F.col("label") < 2, "small").otherwise("large").alias("set-subset"),
        F.when(~two, F.col("root").cast("string")).alias("track-genre_top"),
        F.concat(F.lit("["), listed, F.lit("]")).alias("track-genres_all"),
    )


def genres(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as root genres, nations below them."""
    roots = table(spark, sf, "region").select(
        (F.col("r_regionkey") + 1).cast("string").alias("genre_id"), F.lit("0").alias("parent"),
        F.col("r_name").alias("title"))
    children = table(spark, sf, "nation").select(
        (100 + F.col("n_nationkey")).cast("string"), (F.col("n_regionkey") + 1).cast("string"), "n_name")
    return roots.union(children)


def colors(spark: SparkSession, sf: str) -> DataFrame:
    return genres(spark, sf).select(
        "genre_id", F.concat(F.lit("#"), F.lpad((F.col("genre_id").cast("int") * 4321).cast("string"), 6, "0")).alias("genre_color"))


def membership(spark: SparkSession, sf: str) -> DataFrame:
    """Labels 0 to 7 as clusters; labels 8 and 9 belong to none."""
    return table(spark, sf, "embeddings").filter(F.col("label") <= 7).select(
        F.col("vec_id").alias("point_id"), F.lit("discard").alias("set_kind"), F.col("label").alias("set_id"))


def track_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return membership(spark, sf).select(
        F.col("point_id").cast("string").alias("track_id"), F.col("set_id").alias("cluster_id"))


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Newest event per (user, item) as a rating from 1 to 5."""
    e = table(spark, sf, "events").select(
        F.col("user_id").cast("int").alias("user_id"),
        F.get_json_object("props", "$.k").cast("int").alias("item_id"),
        "event_id",
        (1 + F.least(F.lit(4), F.floor(F.col("value") / 25))).cast("int").alias("rating"),
    )
    return e.groupBy("user_id", "item_id").agg(F.max_by("rating", "event_id").alias("rating"))


def test_bucket():
    """Bucket 0 of 10 is the test part."""
    return F.pmod(F.col("user_id").cast("long") * 7919 + F.col("item_id").cast("long") * 104729, F.lit(10))


def kept_out():
    """Items only ever seen in the test part."""
    return F.col("item_id") % 37 == 5


def blocks(train: DataFrame) -> DataFrame:
    """Fixed blocks of items for checks against SQL."""
    return train.select("item_id").distinct().withColumn("cluster_id", (F.col("item_id") % 5).cast("int"))


def big_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' largest order of each part as a rating."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    q = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(
        F.max("l_quantity").alias("q"))
    return q.select(
        F.col("o_custkey").cast("int").alias("user_id"), F.col("l_partkey").cast("int").alias("item_id"),
        (1 + F.least(F.lit(4), F.floor(F.col("q") / 10.01))).cast("int").alias("rating"))
