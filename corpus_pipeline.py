"""A corpus from raw documents: language, repeated lines, near duplicates, secret_scan, packing.

Every stage is a function of (spark, docs, sf_dir).  Its result is written as Parquet and read again
as the next one's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import language, line_chunks, near_text, packing, secret_scan
from cairn.llm.common import small_batches, table
from cairn.session import cut

#: Name of the vocabulary that packed ids come from, and the id that ends a document.
VOCABULARY, END = "byte_bpe_50k.json", 0
#: Rows that a Python worker gets at a time.
BATCH = 1000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; ``lang`` becomes the language found.

    From here on workers get ``BATCH`` rows at a time: whole texts are in them, and workers outlive a stage.
    `run` gives the setting back; who calls the stages one by one does so after the last.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    found = language.identify(docs, into=("language__", "confidence__", "accepted__")).filter("accepted__")
    return found.select([F.col("language__").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that occurred before."""
    return _counted(line_chunks.remove_repeated_runs(docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_text.first_of_each(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secret_scan replaced by a mark."""
    return _counted(secret_scan.redact(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents laid into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(VOCABULARY), END)


def _counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, in the type it had."""
    if "n_chars" not in docs.columns:
        return changed
    kind = docs.schema["n_chars"].dataType
    return changed.withColumn("n_chars", F.length("text").cast(kind)).select(docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", remove_secrets),
    ("packing", pack_sequences),
]

#: Trigram models, MinHash and the knapsack have no form in SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the session's settings are afterwards as they were."""
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark, BATCH):
        for _, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir))
    return docs
