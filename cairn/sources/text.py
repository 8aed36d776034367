"""Scans of delimited text, including tables whose header spans several rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Words in the key column that mark header rows left in the data.
TRACK_HEADER_KEYS = ("track_id",)
FEATURE_HEADER_KEYS = ("feature", "statistics", "number", "track_id")

RATINGS_SCHEMA = "user_id INT, item_id INT, rating INT, rated_at LONG"


def read_quoted_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV whose quoted cells may hold line breaks and doubled quotes; all strings.

    A file read this way cannot be split, so spread big data over many files.
    """
    return (
        spark.read.option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_plain_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Headerless CSV, all strings."""
    return spark.read.csv(path)


def read_header_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV with one header row and a declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated user, item, rating, time without a header; the time is dropped."""
    return spark.read.schema(RATINGS_SCHEMA).option("sep", "\t").csv(path).drop("rated_at")


def flatten_header(
    df: DataFrame,
    header: Sequence[Row],
    drop_keys: Sequence[str],
    key: str = "track_id",
    as_double: bool = False,
) -> DataFrame:
    """Name each column by its header cells joined with ``-``; drop header rows.

    ``header`` holds the two or three header rows.  An empty header cell reads
    as null and is written into the name as ``None``.  Rows whose key is null or
    one of ``drop_keys`` are header rows and go.  Cells that are no number
    become null when ``as_double`` is set.
    """
    first, *rest = df.columns
    names = ["-".join(str(row[i]) for row in header) for i in range(1, len(df.columns))]
    cells = [F.col(c).try_cast("double") if as_double else F.col(c) for c in rest]
    return df.filter(~F.col(first).isin(*drop_keys)).select(
        F.col(first).alias(key), *[c.alias(n) for c, n in zip(cells, names)]
    )


def read_tracks(
    spark: SparkSession, path: str | Sequence[str], header_path: str | None = None
) -> DataFrame:
    """Track table under two header rows.

    One file starts with its own header.  For a table in many files pass the
    file holding the header as ``header_path``: which file comes first in a
    scan is up to Spark.
    """
    df = read_quoted_csv(spark, path)
    header = (read_quoted_csv(spark, header_path) if header_path else df).take(2)
    return flatten_header(df, header, TRACK_HEADER_KEYS)


def read_features(
    spark: SparkSession, path: str | Sequence[str], header_path: str | None = None
) -> DataFrame:
    """Feature table under three header rows, every feature a double."""
    df = read_plain_csv(spark, path)
    header = (read_plain_csv(spark, header_path) if header_path else df).take(3)
    return flatten_header(df, header, FEATURE_HEADER_KEYS, as_double=True)
