"""The corpus pipeline stage by stage against brute force, and the registered queries."""

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
import __spark_entry__ as entry  # noqa: E402
from cairn.llm import secret_scan  # noqa: E402
from cairn.session import cut  # noqa: E402
from tests.llm import plain  # noqa: E402
from tests.llm.test_tokens import check_packing  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, got = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        got.append(cut(stage(spark, got[-1], SF)))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "secret_scan", "packing"]
    assert all(d.columns == columns for d in got[:-1])
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for d in got[:-1]]
    assert texts[1] == texts[0]  # all clean languages stay
    want = plain.without_repeated_runs(sorted(texts[1].items()))
    assert texts[2] == {k: want[k, t] for k, t in texts[1].items()}
    rows = sorted(texts[2].items())
    classes = plain.text_classes([t for _, t in rows])
    assert texts[3] == {k: t for i, (k, t) in enumerate(rows) if classes[i] == i}
    assert texts[4] == {k: secret_scan.replaced(t, "[SECRET]") for k, t in texts[3].items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got[4].collect())
    check_packing(sorted(texts[4].items()), got[5].collect())
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(setting)
    before = spark.conf.get(setting)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "ids_crc32").collect())) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in got[5].collect())
    assert spark.conf.get(setting) == before


def test_stages_of_no_rows_and_extra_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS node", "'x' AS H")
    for d in (docs.limit(0), docs.limit(3)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, d, SF)
            assert got.columns == docs.columns and got.count() <= d.count()
        assert corpus_pipeline.STAGES[-1][1](spark, d, SF).count() >= d.count()


def test_one_query_for_each_operator():
    names = entry.queries()
    for n in range(1, 14):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
