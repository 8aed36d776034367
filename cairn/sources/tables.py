"""Stored results: build once, and result tables keyed by their parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_exists(spark: SparkSession, path: str) -> bool:
    """True when a finished write is at ``path``."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def materialize_once(
    spark: SparkSession, path: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Read the table at ``path``, building and writing it first if it is missing."""
    if not table_exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def with_parameters(df: DataFrame, parameters: Mapping[str, object]) -> DataFrame:
    """Put the run's parameters in front of its result columns."""
    return df.select(*[F.lit(v).alias(k) for k, v in parameters.items()], "*")


def write_result(df: DataFrame, path: str, parameters: Mapping[str, object]) -> None:
    """Append a run's result to the table at ``path``, one folder per parameter set.

    Storing a run again replaces that run's folder only.
    """
    (
        with_parameters(df, parameters)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parameters)
        .parquet(path)
    )
