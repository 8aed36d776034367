"""Token ids on disk: one zstandard frame per document, one shared dictionary.

A token folder holds four tables, written by Spark and so safe against lost tasks:

- ``dictionary`` one row: ``hash`` (hex sha256 of the dictionary), ``bytes``;
- ``blocks``: ``shard``, ``block``, ``hash``, ``frames`` (frames end to end, at most
  ``BLOCK`` bytes unless one frame is longer);
- ``index``: per document ``doc_id``, ``row`` (its place in the shard), ``shard``, ``block``,
  ``offset`` and ``length`` of its frame in the block, ``start`` (ids before it in its shard),
  ``n_tokens``;
- ``shards``: ``shard``, ``start`` (ids of all shards before it), ``n_tokens``.

Documents lie in ascending order, shard after shard.  One short document costs one
index row, one block and one small decompression with the shared dictionary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import kept_by_worker, slices, small_batches, strings
from cairn.llm.library import Library

BLOCK = 1 << 20
#: Bounds of the dictionary's training sample: documents, and characters used of each, from a hashed place on.
SAMPLE_DOCS, WINDOW, DICTIONARY = 2000, 4096, 64 * 1024
LEVEL = 3
#: Characters by which shards of equal keys are told apart; whole texts are ordered within a shard.
BEGINNING = 256
#: Pieces of text that a worker remembers the ids of (some 200 MB).
MEMO = 1_000_000
_INDEX = "doc_id long, row long, offset long, length long, start long, n_tokens long"


def _text(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def sample_window() -> Column:
    """``WINDOW`` characters of ``text`` from a place that the row's hash names; all places are as likely."""
    places = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    return F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", "text"), places) + 1).cast("int"), F.lit(WINDOW))


def train_dictionary(texts: list[str], source: str, end: int) -> bytes:
    """A zstandard dictionary for serialized id arrays; empty when there is too little to learn from."""
    import zstandard

    samples = [i + np.array([end], dtype="<u4").tobytes() for i in Library(source).encode(texts)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(df: DataFrame, folder: str, path: str, end: int, shards: int | None = None,
                 key: str = "doc_id", text: str = "text") -> None:
    """Encode every text with the tokenizer file at ``path``, append ``end``, write a token folder.

    Null texts count as empty (they hold ``end`` alone), null keys come first, equal keys
    are ordered by text, repeated rows are all written.  An empty table gives an
    empty folder that reads back as no rows.  Only ``key`` and ``text`` are read.

    The dictionary is fitted on a bounded sample (of ``SAMPLE_DOCS`` texts of smallest digest
    a window of ``WINDOW`` characters, anywhere in the text); every document is then compressed with it.
    """
    spark = df.sparkSession
    rows = _text(df, key, text)
    with open(path, encoding="utf-8") as f:
        source = f.read()
    # first the keys alone, so that no task sends more than its part of the sample's texts
    drawn = F.xxhash64("doc_id")
    last = rows.select(drawn.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).head()[0]
    sample = rows.filter(drawn <= F.lit(last)).select(sample_window().alias("text")) if last is not None else rows.limit(0)
    texts = sorted(r["text"] for r in sample.limit(SAMPLE_DOCS).collect())
    dictionary = train_dictionary(texts, source, end)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "hash string, bytes binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    shared = spark.sparkContext.broadcast((source, dictionary))
    parts = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a text's beginning is in order wherever the text is, so shards of one key follow each other by text
    ordered = rows.repartitionByRange(parts, "doc_id", F.substring("text", 1, BEGINNING)).sortWithinPartitions("doc_id", "text")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        library = kept_by_worker(("library", path, MEMO), lambda: Library(shared.value[0], MEMO))
        known = zstandard.ZstdCompressionDict(shared.value[1]) if shared.value[1] else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
        shard, block, row, start = TaskContext.get().partitionId(), 0, 0, 0
        frames, entries, size = [], [], 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"shard": [shard], "block": [block], "hash": [digest], "frames": [b"".join(frames)], "entries": [entries]})

        stop = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                ids = library.encode(strings(part["text"]))
                for doc, raw in zip(part["doc_id"], ids):
                    frame = press.compress(raw + stop)
                    if frames and size + len(frame) > BLOCK:
                        yield flush()
                        block, frames, entries, size = block + 1, [], [], 0
                    n = len(raw) // 4 + 1
                    entries.append({"doc_id": None if pd.isna(doc) else int(doc), "row": row, "offset": size, "length": len(frame), "start": start, "n_tokens": n})
                    frames.append(frame)
                    size, start, row = size + len(frame), start + n, row + 1
        if frames:
            yield flush()

    kind = _INDEX.replace(" long", ": bigint")
    blocks = ordered.mapInPandas(packed, f"shard int, block int, hash string, frames binary, entries array<struct<{kind}>>")
    with small_batches(spark):
        blocks.write.parquet(f"{folder}/blocks")
    stored = spark.read.parquet(f"{folder}/blocks")
    index = stored.select("shard", "block", F.inline("entries"))
    index.write.parquet(f"{folder}/index")
    # one row per shard; the running sum over them is all that is done in one place
    totals = spark.read.parquet(f"{folder}/index").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), "n_tokens").write.parquet(f"{folder}/shards")


def _dictionary(spark: SparkSession, folder: str) -> bytes:
    r = spark.read.parquet(f"{folder}/dictionary").head()
    if hashlib.sha256(r["bytes"]).hexdigest() != r["hash"]:
        raise ValueError(f"damaged dictionary in {folder}")
    return bytes(r["bytes"])


def read_tokens(spark: SparkSession, folder: str, docs: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) read from the frames of a token folder.

    ``ids`` are little-endian unsigned 32-bit integers.  With ``docs`` only the blocks that hold
    those documents are read.  A frame written with another dictionary raises.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    if docs is not None:
        wanted = spark.read.parquet(f"{folder}/index").filter(F.col("doc_id").isin(docs)).select("shard", "block").distinct()
        blocks = blocks.join(wanted, ["shard", "block"], "left_semi")
        blocks = blocks.withColumn("entries", F.filter("entries", lambda e: e["doc_id"].isin(docs)))
    shared = spark.sparkContext.broadcast(_dictionary(spark, folder))

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        known = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        press, digest = zstandard.ZstdDecompressor(dict_data=known), hashlib.sha256(shared.value).hexdigest()
        for batch in batches:
            for shard, name, frames, entries in zip(batch["shard"], batch["hash"], batch["frames"], batch["entries"]):
                if name != digest:
                    raise ValueError("a block names another dictionary")
                for at in range(0, len(entries), 2000):
                    out = [(shard, e["doc_id"], e["start"], e["n_tokens"], press.decompress(frames[e["offset"]:e["offset"] + e["length"]])) for e in entries[at:at + 2000]]
                    yield pd.DataFrame(out, columns=["shard", "doc_id", "within", "n_tokens", "ids"]).astype({"doc_id": "Int64"})

    got = blocks.select("shard", "hash", "frames", "entries").mapInPandas(unpacked, "shard int, doc_id long, within long, n_tokens long, ids binary")
    shards = spark.read.parquet(f"{folder}/shards").select("shard", F.col("start").alias("before"))
    return got.join(shards, "shard").select("doc_id", (F.col("within") + F.col("before")).alias("start"), "n_tokens", "ids")
