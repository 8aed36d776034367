"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import cut as cut  # re-exported: operators cut their lineage with it
from cairn.session import small_batches as small_batches


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def kept_by_worker(key: tuple, make: Callable):
    """``make()`` once per Python worker and key.

    Functions reach the workers by value, so a module's own globals would be made
    anew for every task; tables that are costly to build live on ``sys`` instead.
    """
    store = sys.__dict__.setdefault("_cairn_kept", {})
    if key not in store:
        store[key] = make()
    return store[key]


def release_kept() -> None:
    """Drop what `kept_by_worker` holds, in functions of a stage that needs the memory for itself."""
    if sys.__dict__.pop("_cairn_kept", None):
        gc.collect()
        give_back()
    pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Free memory of this process to the system, as workers outlive a stage and the next one's stand beside them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def strings(column: Iterable) -> list[str]:
    """Texts with null as the empty text."""
    return ["" if t is None or t is pd.NA or t != t else t for t in column]


def slices(frame: pd.DataFrame, column: str, chars: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Consecutive rows holding about ``chars`` characters, one row at least."""
    start = size = 0
    for i, t in enumerate(frame[column]):
        size += len(t) if t is not None else 0
        if size >= chars:
            yield frame.iloc[start:i + 1]
            start, size = i + 1, 0
    if start < len(frame):
        yield frame.iloc[start:]


def runs(pattern, text: str, most: int = 1 << 18) -> Iterator[list[str]]:
    """Matches of ``pattern`` in lists of at most ``most``, so that one text never fills memory."""
    if len(text) < most:
        yield pattern.findall(text)
        return
    found = pattern.finditer(text)
    while part := [m[0] for m in islice(found, most)]:
        yield part


def text_key(column: str = "text"):
    """A 256-bit digest that stands for equal texts; null stays null."""
    return F.sha2(F.col(column).cast("binary"), 256)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
