"""Queries over hits move the texts that are hit, not all texts, also where no table is small enough for Spark's own broadcast."""

import random

import pytest

import __spark_entry__ as entry

ITEM = "amber basalt cedar dune ember fjord grove"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """600 documents of 3,000 characters that hardly compress; every hundredth holds the one item."""
    rng, folder = random.Random(5), tmp_path_factory.mktemp("moved")
    docs = [(i, (f"{ITEM} " if i % 100 == 0 else "") + " ".join(f"{rng.getrandbits(64):x}" for _ in range(180)), "en", f"src{i % 3}") for i in range(600)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def shuffled(spark, run) -> int:
    """Bytes that run() shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        told = store.executorList(True)
        return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))

    before = total()
    run()
    return total() - before


@pytest.mark.parametrize("name", ["bm25_topk", "mock_answer", "evidence_select", "evidence_dedupe_nochain", "rerank_delta", "rerank_trace_sample", "retrieval_metrics_grouped", "self_rag", "candidate_json"])
def test_other_texts_stay(spark, tables, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = []
        moved = shuffled(spark, lambda: rows.extend(entry.queries()[name](spark, tables).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows and moved < 300_000, moved
