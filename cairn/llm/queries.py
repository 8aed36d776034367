"""Registered queries of the text operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, html_text, language, line_chunks, near_text, near_vector, ns_clusters, packing, phrases, quality, secret_scan, token_file, top_k
from cairn.llm.common import table
from cairn.llm.sql_checks import ORACLE_SQL as ORACLE_SQL  # re-exported: the entry point reads both
from cairn.session import new_path


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document; ``kept`` is false for those rejected."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return language.identify(docs, into=("language", "confidence", "kept")).select("doc_id", "language", F.round("confidence", 6).alias("confidence"), "kept")


def page_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every web page, with markup, suffix, domain and host as further evidence."""
    pages = language.page_rows(table(spark, sf, "pages"))
    found = language.identify(pages, declared="declared", host="host", domain="domain", suffix="suffix")
    return found.select("page_id", "language", F.round("confidence", 6).alias("confidence"), "accepted")


def op3_bpe(spark: SparkSession, sf: str, path: str | None = None) -> DataFrame:
    path = path or _vocabulary("byte_bpe_50k.json")
    both = bpe.decode(bpe.encode(table(spark, sf, "documents"), path), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_token_file(spark: SparkSession, sf: str, path: str | None = None) -> DataFrame:
    folder = new_path(spark, "tokens")
    token_file.write_tokens(table(spark, sf, "documents"), folder, path or _vocabulary("word_bpe_49k.json"), end=1)

    return token_file.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return top_k.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    columns = secret_scan.counts_and_lists()
    return found.select("doc_id", *[columns[c].alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named")])


def op7_line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return line_chunks.remove_repeated_runs(docs, removed="chunks_removed")


def op8_packing(spark: SparkSession, sf: str, path: str | None = None) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), path or _vocabulary("byte_bpe_50k.json"), end=0)


def op9_near_text(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document: its class and whether it stays."""
    return near_text.near_duplicates(table(spark, sf, "documents")).select("doc_id", "class_id", "kept")


def op10_near_vector(spark: SparkSession, sf: str) -> DataFrame:
    return near_vector.near_vectors(table(spark, sf, "embeddings"))


def op11_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


def op12_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


def op13_ns_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return ns_clusters.cluster_vectors(table(spark, sf, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "page_languages": page_languages,
    "op3_bpe": op3_bpe,
    "op4_token_file": op4_token_file,
    "op5_top_k": op5_top_k,
    "op6_secrets": op6_secrets,
    "op7_line_chunks": op7_line_chunks,
    "op8_packing": op8_packing,
    "op9_near_text": op9_near_text,
    "op10_near_vector": op10_near_vector,
    "op11_html_text": op11_html_text,
    "op12_phrases": op12_phrases,
    "op13_ns_clusters": op13_ns_clusters,
}
