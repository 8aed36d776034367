"""Checks of input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_numbers(points: DataFrame, vec: str = "features") -> None:
    """Raise unless every vector is there and all its entries are finite numbers, alike in length.

    One such entry would make every distance to its point, and every state with it, not a number.
    """
    bad = F.col(vec).isNull() | F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = points.agg(F.count_if(bad).alias("bad"), F.min(F.size(vec)).alias("least"), F.max(F.size(vec)).alias("most")).head()
    if found.bad:
        raise ValueError(f"{found.bad} points have missing or non-finite features")
    if found.least != found.most:
        raise ValueError(f"feature vectors have {found.least} to {found.most} entries")
