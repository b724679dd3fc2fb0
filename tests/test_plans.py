import json

import pytest
from pyspark.sql import functions as F

from veriloom import __main__ as cli
from veriloom import queries
from veriloom.functions.filters import RetrievalFilters
from veriloom.operators import planning
from veriloom.plans import recorder, suite
from veriloom.plans.settings import Retrieval, Settings
from veriloom.sources.tables import VectorTable
from veriloom.streaming import traces


def test_recorder(spark):
    recorder.record("any", "ignored")  # no recorder: nothing happens
    r = recorder.Recorder(spark, "t1", max_events=3)
    with r.active(), recorder.stage("retrieve"):
        recorder.record("retrieve", "hits", n=3)
    rows = r.events().orderBy("seq").collect()
    assert [x.event for x in rows] == ["retrieve.started", "hits", "retrieve.completed", "trace.completed"]
    full = recorder.Recorder(spark, "t3", max_events=2)
    with pytest.raises(RuntimeError, match="more than 2"), full.active():
        for _ in range(3):
            recorder.record("retrieve", "hit")
    assert traces.snapshots(full.events()).first().status == "failed"  # no trace stays running
    assert traces.snapshots(r.events()).first().status == "completed"
    bad = recorder.Recorder(spark, "t2")
    with pytest.raises(KeyError), bad.active():
        raise KeyError
    assert traces.snapshots(bad.events()).first().status == "failed"
    with pytest.raises(ValueError):
        recorder.Recorder(spark, "t", "loud")


def test_suite(spark):
    base = Settings(retrieval=Retrieval(retriever="bm25"))
    other = Settings(retrieval=Retrieval(retriever="bm25", bm25_b=0.5))
    assert suite.differing(base, other) == ["retrieval.bm25_b"]
    with pytest.raises(ValueError, match="changes 2"):
        suite.check_suite({"a": base, "b": Settings(strategy="graph_rag", retrieval=Retrieval(retriever="bm25", bm25_b=0.5))}, "a")
    with pytest.raises(ValueError, match="same"):
        suite.check_suite({"a": base, "b": base}, "a")
    with pytest.raises(ValueError, match="baseline"):
        suite.check_suite({"a": base}, "x")
    chunks = spark.createDataFrame([("c0", 0, "red light"), ("c1", 1, "seat belt")], "chunk_id string, ordinal long, text string")
    qs = spark.createDataFrame([(1, "red")], "query_id int, text string")
    cases = spark.createDataFrame([(1, "single", True)], "case_id int, question_type string, answerable boolean")
    gold = spark.createDataFrame([(1, "c0")], "case_id int, chunk_id string")
    rows = suite.run_suite(chunks, {"a": base, "b": other}, "a", qs, cases, gold).collect()
    assert {(r.config_id, r.scope, r.rr) for r in rows} == {(c, s, 1.0) for c in "ab" for s in ("all", "single")}
    assert all(suite.valid_report(r.asDict()) for r in rows) and not suite.valid_report({"count": 1})


def test_planner_client(spark):
    q = spark.createDataFrame([(1, "where"), (2, "when")], "query_id int, text string")
    asked = planning.planned(q, planning.PROMPTS["rewrite"], lambda: lambda prompt: json.dumps({"query": prompt.splitlines()[-1] + " exactly"}))
    assert {r.text for r in planning.rewrite(asked).collect()} == {"where exactly", "when exactly"}


def test_vector_search(spark, tmp_path):
    table = VectorTable(spark, str(tmp_path / "v"), 2)
    rows = [("a", 0, "m1", [1.0, 0.0]), ("b", 1, "m2", [0.9, 0.1])]
    table.upsert(spark.createDataFrame(rows, "chunk_id string, ordinal long, manual_id string, embedding array<float>"))
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert [r.chunk_id for r in table.search(q, 2).orderBy("rank").collect()] == ["a", "b"]
    assert [r.chunk_id for r in table.search(q, 2, RetrievalFilters(manual_id="m2")).collect()] == ["b"]
    assert table.scroll(RetrievalFilters(manual_id="m1")).columns == ["chunk_id", "ordinal", "manual_id"]
    assert table.retrieve(spark.createDataFrame([("b",)], "chunk_id string")).count() == 1


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["queries"]) == 0 and "bm25_topk" in capsys.readouterr().out
    assert cli.main(["run", "nope", "d", "o"]) == 2
    assert cli.main(["run", "request_counts", "/root/testdata/sf0.001", str(tmp_path / "o")]) == 0
    assert cli.main(["report", str(tmp_path / "o"), "Requests"]) == 0 and "# Requests" in capsys.readouterr().out
    spark.createDataFrame([("c1", "hello world")], "chunk_id string, text string").write.parquet(str(tmp_path / "c"))
    assert cli.main(["embed", str(tmp_path / "c"), str(tmp_path / "e"), "--dimension", "8"]) == 0
    assert spark.read.parquet(str(tmp_path / "e")).select(F.size("embedding")).first()[0] == 8


def test_every_query_is_named_after_its_function():
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) > 60
