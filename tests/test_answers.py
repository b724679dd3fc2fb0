import json
import os
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veriloom import queries
from veriloom.functions.filters import RetrievalFilters
from veriloom.operators import answers, cells, datasets, evidence, metrics, planning, postings, reports, strategies
from veriloom.plans import registry
from veriloom.plans.engine import Engine, evaluate
from veriloom.plans import suite
from veriloom.plans.registry import QUERY_PROCESSORS, Clients, require
from veriloom.plans.settings import Query, Retrieval, Settings, load_mapping, settings
from veriloom.sources.tables import VectorTable
from veriloom.streaming import store, traces


@pytest.mark.parametrize(("text", "n", "valid"), [("none", 3, False), ("[0]", 3, False), ("[9]", 3, False), ("a [1] b [1]", 3, True), ("[1][7]", 3, False), ("[2] [3]", 3, True)])
def test_citations(spark, text, n, valid):
    assert spark.createDataFrame([(text,)], "t string").select(answers.citations_valid(F.col("t"), F.lit(n))).first()[0] is valid


def test_mock_answer(spark):
    df = spark.createDataFrame([("正文：\n" + "字" * 300,), ("short",), (None,)], "t string")
    a, b, c = [r[0] for r in df.select(answers.mock_answer(F.col("t"))).collect()]
    assert a == "根据知识库正文，" + "字" * 220 + "…… [1]" and b == "根据知识库正文，short [1]" and c == answers.REFUSAL


CHUNKS = "chunk_id string, ordinal long, text string, topic_id string, content_hash string, title string, section_path array<string>, source_url string, manual_id string, manual_key string, snapshot_id string, document_id string, vehicle_model string"


@pytest.fixture(scope="module")
def chunks(spark):
    from veriloom.functions.vectors import hash_embed

    rows = [(f"c{i}", i, t, f"t{i % 2}", f"h{i}", "T", ["s"], "u", "m", "k", "1", f"d{i}", "x") for i, t in enumerate(["red light", "seat belt", "red seat", "charge battery"])]
    df = spark.createDataFrame(rows, CHUNKS)
    return df.join(hash_embed(df.select(F.col("chunk_id").alias("id"), "text"), 64).withColumnRenamed("id", "chunk_id"), "chunk_id").cache()


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "red light"), (2, "xyzzy"), (3, "battery")], "query_id int, text string")


@pytest.mark.parametrize("strategy", ["vanilla", "self_rag", "agentic_rag", "graph_rag"])
def test_engine_answers(spark, chunks, questions, strategy):
    engine = Engine(chunks, Settings(strategy=strategy, retrieval=Retrieval(retriever="bm25")))
    got = {r.query_id: r for r in engine.chat(questions).collect()}
    assert got[1].answer == "根据知识库正文，red light [1]" and not got[1].refused and got[1].citations[0].chunk_id == "c0"
    assert got[2].refused and got[2].answer == answers.REFUSAL and got[2].citation_validated
    assert got[3].evidence[0].chunk_id == "c3"


@pytest.mark.parametrize("retriever", ["dense", "bm25", "hybrid"])
def test_engine_retrieves(spark, chunks, questions, retriever):
    engine = Engine(chunks, Settings(retrieval=Retrieval(retriever=retriever)))
    got = engine.retrieve(questions, 2).filter("query_id = 1").orderBy("rank").collect()
    assert got[0].chunk_id == "c0" and got[0].recall_score == got[0].score
    with pytest.raises(ValueError):
        engine.retrieve(questions, 51)


def test_engine_runs_on_what_the_settings_name(spark, chunks, questions, tmp_path, monkeypatch):
    key = lambda rows: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in rows.collect())
    plain = Engine(chunks, Settings(retrieval=Retrieval(retriever="hybrid")))
    want = key(plain.retrieve(questions, 3))
    table = VectorTable(spark, str(tmp_path / "v"), 64)
    table.upsert(chunks.select("chunk_id", "embedding"))
    stores = {"table": table, "cells": cells.CellIndex.build(chunks.select("chunk_id", "ordinal", "embedding"), str(tmp_path / "c"))}
    index = postings.build(chunks, str(tmp_path / "p"))
    for name, store_of in stores.items():
        told = Settings(vector_store=name, retrieval=Retrieval(retriever="hybrid"))
        with pytest.raises(RuntimeError, match="needs a store"):
            Engine(chunks, told)
        with Engine(chunks.drop("embedding"), told, index, vectors=store_of) as engine:
            assert key(engine.retrieve(questions, 3)) == want
            assert key(engine.filtered(RetrievalFilters(manual_keys=["k"])).retrieve(questions, 3)) == want
            paths = [p for _, p in engine._owned]
            assert paths
        assert not any(os.path.exists(p.removeprefix("file:")) for p in paths) and not engine._owned
    monkeypatch.setitem(registry.EVIDENCE_SELECTORS, "none", lambda told, *a: evidence.select_evidence(told, *a).withColumn("selected", F.lit(False)))
    chosen = Engine(chunks, Settings(evidence_selector="none", retrieval=Retrieval(retriever="bm25"))).chat(questions).collect()
    assert chosen and all(r.refused for r in chosen)


def test_engine_evaluates(spark, chunks, questions):
    cases = spark.createDataFrame([(1, "single", True), (2, "none", False)], "case_id int, question_type string, answerable boolean")
    gold = spark.createDataFrame([(1, "c0")], "case_id int, chunk_id string")
    got = evaluate({"a": Engine(chunks, Settings(retrieval=Retrieval(retriever="bm25"))), "b": Engine(chunks)}, questions, cases, gold).collect()
    assert {r.config_id: r.rr for r in got} == {"a": 1.0, "b": 1.0}


def test_bad_drafts_are_refused(spark):
    rows = spark.createDataFrame([(1, [("c", "t", "u", "x")])], "query_id int, evidence array<struct<chunk_id string, title string, source_url string, text string>>")
    out = answers.finished(rows, repairs=0, draft=F.lit("no citation")).first()
    assert out.refused and not out.citation_validated and out.answer == answers.REFUSAL
    out = answers.finished(rows, repairs=1, draft=F.lit("no citation")).first()
    assert not out.refused and out.answer == "no citation [1]"
    assert answers.finished(rows, citation_required=False, draft=F.lit("free")).first().citations[0]["index"] == 1


def test_agentic_bound(spark):
    qs = spark.createDataFrame([(1, "q")], "query_id int, text string")
    calls = []

    def find(q):
        calls.append(1)
        return q.select("query_id", F.concat(F.lit("c"), F.lit(len(calls)).cast("string")).alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    always = lambda q, held, step: q.select("query_id", F.lit("retrieve").alias("action"), F.lit(None).cast("string").alias("query"))
    assert strategies.agentic(qs, find, always, 3).count() == 3 and len(calls) == 3
    with pytest.raises(ValueError):
        strategies.agentic(qs, find, always, 0)


def test_metrics(spark):
    cases = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "b", False)], "case_id int, question_type string, answerable boolean")
    gold = spark.createDataFrame([(1, "1"), (1, "2"), (2, "9")], "case_id int, chunk_id string")
    hits = spark.createDataFrame([(1, "1", 1), (1, "x", 2), (1, "2", 3)], "case_id int, chunk_id string, rank int")
    rows = {r.case_id: r for r in metrics.retrieval_cases(cases, gold, hits).collect()}
    assert (rows[1].precision, rows[1].recall, rows[1].rr) == (pytest.approx(2 / 3), 1.0, 1.0) and rows[1].f1 == pytest.approx(0.8)
    assert set(rows) == {1, 2} and rows[2].f1 == 0.0
    empty = metrics.retrieval_summary(metrics.retrieval_cases(cases.limit(0), gold, hits)).collect()
    assert [(r.scope, r["count"]) for r in empty] == [("all", 0)]


def test_generation_metrics(spark):
    rows = spark.createDataFrame([(1, True, False, 1, 0.5, float("nan"), 1.0), (2, True, True, 1, 0.9, 0.9, 0.9), (3, False, True, 0, 0.9, 0.9, 0.9)], "case_id int, answerable boolean, refused boolean, n_evidence int, faithfulness double, answer_relevancy double, completeness double")
    got = {r.case_id: r for r in metrics.generation_cases(rows).collect()}
    assert got[1].answer_relevancy is None and got[2].faithfulness == 0.0 and got[3].refusal_correct and got[3].faithfulness is None
    s = metrics.generation_summary(metrics.generation_cases(rows)).first()
    assert s.answerable_count == 2 and s.refusal_accuracy == 1.0


def test_processors(spark):
    q = spark.createDataFrame([(1, "  a  b ")], "query_id int, text string")
    assert planning.identity(q).first().text == "a b"
    with pytest.raises(Exception, match="empty"):
        planning.identity(q.withColumn("text", F.lit("  "))).collect()
    told = q.withColumn("answer", F.lit('{"queries": ["x", " x", "y", "z"]}'))
    assert planning.multi_query(told, 3).first().queries == ["x", "y"]
    with pytest.raises(Exception, match="blank"):
        planning.multi_query(q.withColumn("answer", F.lit('{"queries": ["x", " "]}'))).collect()
    with pytest.raises(Exception, match="JSON"):
        planning.rewrite(q.withColumn("answer", F.lit("not json"))).collect()
    assert planning.hyde(q.withColumn("answer", F.lit('{"hypothetical_document": "d"}'))).first().text == "d"
    plan = planning.identity(q)
    for bad in ("multi_query", "other"):
        with pytest.raises(Exception, match="fusion"):
            planning.validated(plan.withColumn("fusion_strategy", F.lit(bad))).select("fusion_strategy").collect()


def test_reports(spark):
    runs = spark.createDataFrame([("a", "planned"), ("b", "completed"), ("b", "failed"), ("c", "completed"), ("c", "planned")], "suite_id string, status string")
    assert {r.suite_id: r.status for r in reports.suite_status(runs).collect()} == {"a": "planned", "b": "failed", "c": "incomplete"}
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    assert [r.case_id for r in reports.subset(cases, ["b", "a"]).collect()] == ["b", "a"]
    for bad in (["a", "a"], ["zz"]):
        with pytest.raises(ValueError):
            reports.subset(cases, bad)


def test_dataset_builder(spark):
    rows = [(f"c{m}-{t}-{s}", f"m{m}", f"t{t}", "T", [f"section {s}"], "正文：" + ("充电" if t % 2 else "座椅") + "x" * 90) for m in range(12) for t in range(6) for s in range(3)]
    df = spark.createDataFrame(rows, "chunk_id string, manual_key string, topic_id string, title string, section_path array<string>, text string")
    counts = {"single_chunk": 6, "multi_chunk_same_topic": 3, "multi_topic": 3, "cross_manual": 2, "unanswerable": 2}
    got = datasets.build_cases(df, counts).collect()
    ids = [c for r in got for c in r.gold_chunk_ids]
    assert len(got) == 16 and len(ids) == len(set(ids)) and sum(not r.answerable for r in got) == 2
    with pytest.raises(RuntimeError, match="cross_manual"):
        datasets.build_cases(df.filter("manual_key = 'm0' or topic_id != 't0'").filter("manual_key = 'm0'"), counts | {"single_chunk": 1, "multi_chunk_same_topic": 1, "multi_topic": 1})


def test_dataset_builder_chooses_among_all_chunks(spark):
    # the tag and the shared section stand only behind the first chunks of a large topic and manual
    rows = [(f"c{m}-{t}-{s:03d}", f"m{m}", f"t{t:02d}", "T", [f"own {m} {s:03d}"], "正文：" + "座椅" + "x" * 90) for m in range(3) for t in range(8) for s in range(40)]
    rows += [(f"z{m}", f"m{m}", "t07", "T", ["zz shared"], "正文：" + "充电" + "x" * 90) for m in range(3)]
    rows += [(f"y{m}", f"m{m}", "t07", "T", ["zy shared"], "正文：" + "充电" + "x" * 90) for m in range(3)]
    df = spark.createDataFrame(rows, "chunk_id string, manual_key string, topic_id string, title string, section_path array<string>, text string")
    counts = {"single_chunk": 4, "multi_chunk_same_topic": 3, "multi_topic": 3, "cross_manual": 1, "unanswerable": 1}
    want = plain_cases([r.asDict() for r in datasets.readable(df).collect()], counts)
    got = {r.case_id: list(r.gold_chunk_ids) for r in datasets.build_cases(df, counts).collect()}
    assert got == want and len({c for k, g in want.items() if k.startswith("cross") for c in g}) == 2


def test_dataset_builder_with_fewer_cases(spark):
    """Where a kind has fewer cases than asked for, they are raised or told as they are, and the other kinds with them."""
    rows = [(f"c{m}-{t}-{s}", f"m{m}", f"t{t}", "T", ["one section"], "正文：" + "x" * 90) for m in range(4) for t in range(3) for s in range(3)]
    df = spark.createDataFrame(rows, "chunk_id string, manual_key string, topic_id string, title string, section_path array<string>, text string")
    counts = {"single_chunk": 2, "multi_chunk_same_topic": 2, "multi_topic": 3, "cross_manual": 2, "unanswerable": 1}
    with pytest.raises(RuntimeError, match="only 0 of 2 multi_chunk_same_topic"):
        datasets.build_cases(df, counts)
    want = plain_cases([r.asDict() for r in datasets.readable(df).collect()], counts)
    got = {r.case_id: list(r.gold_chunk_ids) for r in datasets.build_cases(df, counts, complete=False).collect()}
    assert got == want and [k.rsplit("-", 1)[0] for k in sorted(want)] == ["cross-manual", "multi-topic", "multi-topic", "multi-topic", "single", "single", "unanswerable"]


def plain_cases(rows, counts):
    """Case ids with their chunks, by one pass over ordered rows for each kind."""
    rows = sorted(rows, key=lambda r: (r["manual_key"], r["topic_id"], r["section"], r["chunk_id"]))
    out, used, topics, n = {}, set(), set(), 0
    tags = sorted({r["tag"] for r in rows})
    while n < counts["single_chunk"]:
        for tag in tags:
            row = next((r for r in rows if r["tag"] == tag and (r["manual_key"], r["topic_id"]) not in topics), None)
            if row and n < counts["single_chunk"]:
                n += 1
                out[f"single-{n:03d}"] = [row["chunk_id"]]
                topics.add((row["manual_key"], row["topic_id"]))
                used.add(row["chunk_id"])

    def groups(key):
        held = {}
        for r in rows:
            if r["chunk_id"] not in used:
                held.setdefault(tuple(r[k] for k in key), []).append(r)
        return [held[k] for k in sorted(held)]

    def heads(part, key):
        held = {}
        for r in part:
            held.setdefault(r[key], r)
        return list(held.values())

    for kind, prefix, key in (("multi_chunk_same_topic", "same-topic", ("manual_key", "topic_id")), ("multi_topic", "multi-topic", ("manual_key",)), ("cross_manual", "cross-manual", ("section",))):
        found = []
        for part in groups(key):
            if prefix == "same-topic":
                pair = part[:2] if len({r["section"] for r in part[:2]}) == 2 else []
            elif prefix == "multi-topic":
                one, *rest = heads(part, "topic_id")
                pair = [one, next((r for r in rest if r["tag"] != one["tag"]), rest[0])] if rest else []
            else:
                pair = heads(part, "manual_key")[:2] if len(part[0]["section"]) >= 3 else []
            if len(pair) == 2:
                found.append([r["chunk_id"] for r in pair])
        for i, ids in enumerate(found[: counts[kind]], 1):
            out[f"{prefix}-{i:03d}"] = ids
            used.update(ids)
    return out | {f"unanswerable-{i:03d}": [] for i in range(1, counts["unanswerable"] + 1)}


def test_dataset_builder_against_plain(spark):
    import random

    rng = random.Random(11)
    words = ["充电", "座椅", "安全", "驾驶", "轮胎", ""]
    rows = [(f"c{i:03d}", f"m{rng.randrange(9)}", f"t{rng.randrange(12)}", "T", [f"sec {rng.randrange(15)}"], "正文：" + rng.choice(words) + "x" * 90) for i in range(400)]
    df = spark.createDataFrame(rows, "chunk_id string, manual_key string, topic_id string, title string, section_path array<string>, text string")
    counts = {"single_chunk": 18, "multi_chunk_same_topic": 8, "multi_topic": 6, "cross_manual": 6, "unanswerable": 3}
    want = plain_cases([r.asDict() for r in datasets.readable(df).collect()], counts)
    assert {r.case_id: list(r.gold_chunk_ids) for r in datasets.build_cases(df, counts).collect()} == want


# ---- models ----


def test_components_need_their_client(spark, chunks):
    for bad in ({"reranker": "bge_local"}, {"generator": "openrouter"}, {"embedder": "bge_m3_local"}, {"controller": "llm"}):
        with pytest.raises(RuntimeError, match="client"):
            Engine(chunks, Settings(**bad))
    for bad in ({"reranker": "x"}, {"generator": "x"}, {"embedder": "x"}, {"controller": "x"}, {"chunker": "x"}, {"vector_store": "x"}, {"strategy": "x"}):
        with pytest.raises(ValueError, match="choose one of"):
            Engine(chunks, Settings(**bad))
    with pytest.raises(RuntimeError, match="planner"):
        Engine(chunks, Settings(query=Query(processor="rewrite"))).plan(spark.createDataFrame([(1, "q")], "query_id int, text string"))


def test_models_run_where_the_settings_name_them(spark, chunks, questions):
    bm25 = Retrieval(retriever="bm25")
    shortest = Clients(reranker=lambda: lambda pairs: [-len(t) for _, t in pairs])
    got = Engine(chunks, Settings(reranker="bge_local", retrieval=bm25), clients=shortest).retrieve(spark.createDataFrame([(1, "red light seat")], "query_id int, text string"), 3).orderBy("rank").collect()
    assert got[0].chunk_id == "c2" and got[0].rerank_score == -8.0 and got[0].recall_score > 0  # "red seat" is the shortest

    says = Clients(generator=lambda: lambda question, prompt: f"{question}: see [1]" if "Answer again" in prompt else f"{question}: no citation")
    out = {r.query_id: r for r in Engine(chunks, Settings(generator="openrouter", retrieval=bm25, max_repairs=1), clients=says).chat(questions).collect()}
    assert out[1].answer == "red light: see [1]" and out[2].refused and not out[1].refused
    out = {r.query_id: r for r in Engine(chunks, Settings(generator="openrouter", retrieval=bm25, max_repairs=0), clients=says).chat(questions).collect()}
    assert out[1].refused and not out[1].citation_validated and len(out[1].evidence) > 0

    plans = Clients(planner=lambda: lambda prompt: '{"queries": ["battery", "seat belt"]}')
    hits = Engine(chunks, Settings(query=Query(processor="decomposition"), retrieval=bm25), clients=plans).retrieve(questions, 4).filter("query_id = 2").collect()
    assert {"c1", "c3"} <= {r.chunk_id for r in hits}  # fused over the planner's queries

    def embed(texts):
        return [[1.0, 0.0] if "red" in t else [0.0, 1.0] for t in texts]

    model = Clients(embedder=lambda: embed)
    engine = Engine(chunks, Settings(embedder="bge_m3_local", dimension=2, retrieval=Retrieval(retriever="dense")), clients=model)
    own = engine.embed(chunks.select(F.col("chunk_id").alias("id"), "text")).withColumnRenamed("id", "chunk_id")
    engine = Engine(chunks.drop("embedding").join(own, "chunk_id"), engine.settings, clients=model)
    assert [r.chunk_id for r in engine.retrieve(questions, 2).filter("query_id = 1").orderBy("rank").collect()] == ["c0", "c2"]


def _controller(**says):
    """A controller that answers by task."""
    import json

    def load():
        def ask(prompt):
            for task, key in (("suffice", "assess"), ("next", "act"), ("support", "support")):
                if task in prompt.splitlines()[0]:
                    told = says[key](prompt)
                    return told if isinstance(told, str) else json.dumps(told)
        return ask

    return Clients(controller=load)


def test_self_rag_rewrites_once_and_checks_support(spark, chunks):
    questions = spark.createDataFrame([(1, "red light"), (2, "xyzzy"), (3, "battery")], "query_id int, text string")
    settings = Settings(strategy="self_rag", controller="llm", retrieval=Retrieval(retriever="bm25"))
    c = _controller(assess=lambda p: {"sufficient": "xyzzy" not in p, "rewritten_query": "seat belt"}, support=lambda p: {"supported": "battery" not in p})
    got = {r.query_id: r for r in Engine(chunks, settings, clients=c).chat(questions).collect()}
    assert (got[1].rounds, got[1].asked, got[1].refused) == (1, "red light", False)
    assert (got[2].rounds, got[2].asked, got[2].refused) == (2, "seat belt", False) and got[2].evidence[0].chunk_id == "c1"
    assert got[3].refused and got[3].answer == answers.REFUSAL and got[3].citations == [] and len(got[3].evidence) > 0
    same = _controller(assess=lambda p: {"sufficient": False, "rewritten_query": " "}, support=lambda p: "true")
    got = {r.query_id: r for r in Engine(chunks, settings, clients=same).chat(questions).collect()}
    assert all(r.rounds == 1 for r in got.values()) and got[2].refused and not got[3].refused


def test_agentic_controller(spark, chunks):
    questions = spark.createDataFrame([(1, "red light"), (2, "nothing"), (3, "battery")], "query_id int, text string")
    settings = Settings(strategy="agentic_rag", controller="llm", retrieval=Retrieval(retriever="bm25"), max_steps=3)

    def act(prompt):
        if "nothing" in prompt:
            return {"action": "stop"}
        return {"action": "answer"} if "charge" in prompt or "light" in prompt.split("Evidence:")[1] else {"type": "RETRIEVE", "query": prompt.split("Question: ")[1].splitlines()[0]}

    got = {r.query_id: r for r in Engine(chunks, settings, clients=_controller(act=act)).chat(questions).collect()}
    assert got[1].evidence[0].chunk_id == "c0" and got[3].evidence[0].chunk_id == "c3" and got[2].refused


def test_faulty_questions_and_failing_configurations(spark, chunks):
    questions = spark.createDataFrame([(1, "red light"), (2, "  "), (3, "x" * 2001)], "query_id int, text string")
    engine = Engine(chunks, Settings(retrieval=Retrieval(retriever="bm25")))
    assert {r.query_id for r in engine.faults(questions).collect()} == {2, 3}
    cases = spark.createDataFrame([(1, "single", True), (2, "single", True), (3, "multi", True)], "case_id int, question_type string, answerable boolean")
    gold = spark.createDataFrame([(1, "c0")], "case_id int, chunk_id string")
    base = Settings(retrieval=Retrieval(retriever="bm25"))
    broken = Clients(reranker=lambda: lambda pairs: 1 / 0)
    rows = suite.run_suite(chunks, {"a": base, "b": Settings(retrieval=base.retrieval, reranker="bge_local")}, "a", questions, cases, gold, clients=broken).collect()
    told = {(r.config_id, r.scope): r for r in rows}
    assert told["a", "all"].errors == 2 and told["a", "all"].rr == 1.0 and told["a", "all"]["count"] == 1 and told["a", "all"].status == "completed"
    assert told["b", "all"].status == "failed" and told["b", "all"].error and told["b", "all"].errors == 3
    with pytest.raises(Exception):
        suite.run_suite(chunks, {"a": base, "b": Settings(retrieval=base.retrieval, reranker="bge_local")}, "a", questions, cases, gold, clients=broken, fail_fast=True)


def test_cases_that_fail_while_running(spark, chunks):
    """A planner and a reranker that fail for some questions: these have errors, the others metrics."""
    questions = spark.createDataFrame([(1, "red light"), (2, "battery bad plan"), (3, "seat bad pair"), (4, " ")], "query_id int, text string")
    cases = spark.createDataFrame([(i, "single", True) for i in (1, 2, 3, 4)], "case_id int, question_type string, answerable boolean")
    gold = spark.createDataFrame([(1, "c0")], "case_id int, chunk_id string")

    def plan(prompt):
        if "bad plan" in prompt:
            raise OSError("planner is down")
        return json.dumps({"query": prompt.splitlines()[-1]})

    def score(pairs):
        if any("bad pair" in q for q, _ in pairs):
            raise ValueError("cannot score")
        return [1.0 if "light" in t else 0.0 for _, t in pairs]

    told = Settings(reranker="bge_local", query=Query(processor="rewrite"), retrieval=Retrieval(retriever="bm25"))
    clients = Clients(planner=lambda: plan, reranker=lambda: score)
    got = {r.case_id: r for r in evaluate({"a": Engine(chunks, told, clients=clients)}, questions, cases, gold).collect()}
    assert got[1].rr == 1.0 and got[1].error is None and got[2].error == "OSError: planner is down" and got[2].rr is None
    assert got[3].error == "ValueError: cannot score" and got[4].error == "query is empty"
    with pytest.raises(Exception, match="planner is down"):
        Engine(chunks, told, clients=clients).retrieve(questions).collect()


def test_settings(tmp_path):
    (tmp_path / "base.json").write_text('{"dimension": 8, "retrieval": {"top_k": 2}}')
    (tmp_path / "top.json").write_text('{"extends": "base.json", "retrieval": {"rrf_k": 10}}')
    told = settings(load_mapping(tmp_path / "top.json"), environ={"VERILOOM_RETRIEVAL__TOP_K": "3"})
    assert (told.dimension, told.retrieval.top_k, told.retrieval.rrf_k) == (8, 3, 10)
    (tmp_path / "loop.json").write_text('{"extends": "loop.json"}')
    with pytest.raises(ValueError, match="extends itself"):
        load_mapping(tmp_path / "loop.json")
    with pytest.raises(ValueError, match="unknown"):
        settings({"nope": 1}, environ={})
    with pytest.raises(ValueError, match="choose one of"):
        require(QUERY_PROCESSORS, "nope", "query processor")


def test_traces(spark):
    ev = spark.createDataFrame([("a", 1, "running", "2024-01-01 00:00:00"), ("a", 2, "completed", "2024-01-01 00:00:05"), ("b", 3, "running", "2024-01-01 01:00:00")], "trace_id string, event_id int, status string, t string").select("trace_id", "event_id", "status", F.col("t").cast("timestamp").alias("ts"))
    snap = traces.snapshots(traces.numbered(ev, "trace_id", "ts"))
    assert {r.trace_id: r.status for r in snap.collect()} == {"a": "completed", "b": "running"}
    now = F.lit("2024-01-01 01:00:01").cast("timestamp")
    assert [r.trace_id for r in traces.expired(snap, now, 600).collect()] == ["a"]
    assert [r.trace_id for r in traces.live(snap, now, 6000, 1).collect()] == ["b"]
    with pytest.raises(Exception, match="too many"):
        traces.numbered(ev, "trace_id", "ts", max_events=1).collect()


def test_streams_agree_with_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    rows = spark.read.parquet(src).select(F.col("user_id").alias("trace_id"), "event_id", "ts")
    for i in range(2):
        rows.filter(F.col("event_id") % 2 == i).orderBy("ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = traces.numbered_stream(stream).writeStream.format("memory").queryName("numbered").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("select trace_id, count(*) n, max(seq) m, count(distinct seq) d from numbered group by 1").collect()
    assert sum(r.n for r in got) == rows.count() and all(r.n == r.m == r.d for r in got)
    s = traces.sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "30 minutes", late="1 minute")
    q = s.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {(r.trace_id, r.created_at) for r in traces.sessions(rows, "30 minutes").collect()}
    emitted = {(r.trace_id, r.created_at) for r in spark.table("sessions").collect()}
    assert emitted and emitted <= batch


def _by_machine(events, ttl_us=None, max_events=None):
    """Rows of the trace store for events (trace, id, ts_us, status) in the order of time."""
    out, held = [], {}
    for trace, i, ts, status in sorted(events, key=lambda e: e[2]):
        state = held.get(trace)
        if state and ttl_us is not None and ts > state["updated"] + ttl_us:
            out.append((trace, "expired", None, state["n"], state["status"]))
            state = None
        state = held[trace] = state or {"n": 0, "refused": 0, "updated": ts, "status": "running"}
        if max_events is not None and state["n"] >= max_events:
            if not state["refused"]:
                out.append((trace, "full", None, state["n"], state["status"]))
            state["refused"] += 1
            continue
        state |= {"n": state["n"] + 1, "updated": ts, "status": status if status in traces.TERMINAL else state["status"]}
        out.append((trace, "event", i, state["n"], state["status"]))
    return out, held


def test_trace_store_over_restarts(spark, tmp_path):
    """Batches and restarts don't matter: the rows are those of a machine that sees one event after the other."""
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("running")
    rows = rows.select((F.col("user_id") % 6).alias("trace_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), status.alias("status")).withColumn("part", F.ntile(3).over(Window.orderBy("ts")))
    events = [(r.trace_id, r.event_id, r.us, r.status) for r in rows.withColumn("us", F.unix_micros("ts")).collect()]
    ttl = 40 * 3600
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("trace_id long, event_id long, ts timestamp, status string").parquet(str(tmp_path / "in"))
    for part in (1, 2, 3):  # each run is a restart from the checkpoint
        rows.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        store.run_store(stream, str(tmp_path / "told"), str(tmp_path / "cp"), ttl_seconds=ttl, max_events=20)
    told = spark.read.parquet(str(tmp_path / "told"))
    want, held = _by_machine(events, ttl * 1_000_000, 20)
    now = max(e[2] for e in events)
    gone = {t for t, s in held.items() if s["updated"] + ttl * 1_000_000 < now - 1000}
    want += [(t, "expired", None, held[t]["n"], held[t]["status"]) for t in gone]
    got = [(r.trace_id, r.kind, r.event_id, r.n_events, r.status) for r in told.filter("kind <> 'snapshot'").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {k for _, k, *_ in got} == {"event", "expired", "full"}
    latest = {r.trace_id: r for r in store.latest(told).collect()}
    assert {t: (r.n_events, r.refused, r.status) for t, r in latest.items()} == {t: (s["n"], s["refused"], s["status"]) for t, s in held.items()}
    assert {t for t, r in latest.items() if r.expired} == gone


def test_trace_store_without_expiry(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 10, "running"), ("a", 2, 20, "completed"), ("b", 3, 5, None), ("a", 4, 30, "running"), (None, 5, 1, "failed")], "trace_id string, event_id long, s long, status string")
    rows.select("trace_id", "event_id", F.timestamp_seconds("s").alias("ts"), "status").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("trace_id string, event_id long, ts timestamp, status string").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="does not end"):
        store.run_store(stream, str(tmp_path / "told"), str(tmp_path / "cp"), event_time=False)
    store.run_store(stream, str(tmp_path / "told"), str(tmp_path / "cp"))
    latest = {r.trace_id: (r.n_events, r.status, r.expired) for r in store.latest(spark.read.parquet(str(tmp_path / "told"))).collect()}
    assert latest == {"a": (3, "completed", False), "b": (1, "running", False), None: (1, "failed", False)}
    with store.with_state_store(spark):
        timed = store.trace_store(stream, ttl_seconds=3600, event_time=False)
        query = timed.writeStream.format("memory").queryName("timed_store").option("checkpointLocation", str(tmp_path / "cp2")).trigger(processingTime="1 second").start()
    try:
        for _ in range(120):
            if spark.table("timed_store").filter("kind = 'snapshot'").count() == 3:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert {r.trace_id: r.n_events for r in store.latest(spark.table("timed_store")).collect()} == {"a": 3, "b": 1, None: 1}


@pytest.mark.parametrize("files", [0, 3])
def test_trace_queries_over_a_file_and_a_folder(spark, tmp_path, files):
    """The stream reads its table whether it is one file or a folder of files."""
    held = "/root/testdata/sf0.001"
    if files:
        spark.read.parquet(f"{held}/events.parquet").repartition(files).write.parquet(str(tmp_path / "events.parquet"))
        held = str(tmp_path)
    want = {(r.trace_id, r.n_events, r.status) for r in queries.trace_snapshot(spark, held).collect()}
    assert {(r.trace_id, r.n_events, r.status) for r in queries.trace_stream(spark, held).collect()} == want and want
    gone = {r.trace_id for r in queries.trace_ttl(spark, held).collect()}
    assert {r.trace_id for r in queries.trace_stream_ttl(spark, held).collect()} == gone and gone
