import numpy as np
import math

import pytest
from pyspark.sql import functions as F

from veriloom.operators import dense, evidence, fuse, graph, lexical, rerank

CHUNKS = "chunk_id string, ordinal long, text string"


def bm25_of(spark, texts, questions, k=10):
    chunks = spark.createDataFrame([(f"c{i}", i, t) for i, t in enumerate(texts)], CHUNKS)
    qs = spark.createDataFrame(list(enumerate(questions)), "query_id int, text string")
    return lexical.bm25(lexical.postings(chunks), lexical.corpus_stats(chunks), qs, k)


def plain_bm25(texts, q):
    docs = [t.lower().split() for t in texts]
    avg = sum(map(len, docs)) / len(docs) or 1.0
    out = {}
    for i, d in enumerate(docs):
        s = 0.0
        for t in q.lower().split():
            df = sum(t in x for x in docs)
            tf = d.count(t)
            if tf:
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
        if s > 0:
            out[f"c{i}"] = s
    return out


def test_bm25_against_plain(spark):
    texts = ["red light check", "light light", "seat belt red", "nothing here", "red light check"]
    got = bm25_of(spark, texts, ["red light light", "absent", "Seat"]).collect()
    for q, question in enumerate(["red light light", "absent", "Seat"]):
        want = plain_bm25(texts, question)
        mine = {r.chunk_id: r.score for r in got if r.query_id == q}
        assert mine == pytest.approx(want)
    # ties: the higher ordinal first
    order = [r.chunk_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r["rank"])]
    assert order.index("c4") < order.index("c0")


def test_bm25_empty_corpus(spark):
    assert bm25_of(spark, [], ["x"]).count() == 0


def _search_case(spark, n=400):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 25))) if i % 11 else "" for i in range(n)]
    chunks = spark.createDataFrame([(f"c{i}", i, t) for i, t in enumerate(texts)], CHUNKS).repartition(3)
    asked = [" ".join(rng.choice(words, 6)) for _ in range(12)] + ["absent", ""]
    return texts, chunks, asked, spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")


def _first(texts, question, k):
    order = sorted(((-round(s, 6), -int(c[1:])) for c, s in plain_bm25(texts, question).items()))
    return [(f"c{-i}", -s) for s, i in order[:k]]


def test_search_moves_no_postings(spark, monkeypatch):
    """Of chunks and questions only counts and a task's best are written: neither postings nor scores of pairs."""
    texts, chunks, asked, qs = _search_case(spark)
    rows, plain = {}, lexical.written

    def noted(df, name):
        out = plain(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(lexical, "written", noted)
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in lexical.search(chunks, qs, 3, digits=6).collect()}
    for q, question in enumerate(asked):
        want = _first(texts, question, 3)
        assert [got[q, i + 1] for i in range(len(want))] == want and (q, len(want) + 1) not in got
    assert rows.pop("hits") <= 4 * 12 * 3 and max(rows.values()) <= 12 * 6 + 2


def test_search_in_groups_and_small_steps(spark, monkeypatch):
    """More questions than go to the tasks at once, few products a pass, few rows a batch: the same hits, k or not."""
    texts, chunks, asked, qs = _search_case(spark, 150)
    for name, value in (("ASKED_QUERIES", 4), ("ASKED_TOKENS", 30), ("PRODUCTS", 50), ("BATCH_ROWS", 7)):
        monkeypatch.setattr(lexical, name, value)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in (5, None):
        rows = sorted(lexical.search(chunks, qs, k, digits=6).collect(), key=lambda r: (r.query_id, r["rank"]))
        for q, question in enumerate(asked):
            assert [(r.chunk_id, r.score) for r in rows if r.query_id == q] == _first(texts, question, k)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert lexical.search(chunks.limit(0), qs, 3).count() == 0 and lexical.search(chunks, qs.limit(0), 3).count() == 0


def test_dense(spark):
    rows = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [1.0, 0.0]), ("c", 2, [-1.0, 0.0]), ("z", 3, [0.0, 0.0])], "chunk_id string, ordinal long, embedding array<float>")
    qs = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, embedding array<float>")
    got = [(r.chunk_id, round(r.score, 6)) for r in dense.dense(rows, qs, 10).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("b", 1.0), ("z", 0.0), ("c", -1.0)]
    with pytest.raises(Exception, match="vector size"):
        dense.dense(rows, spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<float>"), 3).collect()
    assert dense.dense(rows, qs.limit(0), 3).count() == 0


def test_rrf_order(spark):
    runs = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1), (1, 1, "c", 2)], "query_id int, query_index int, chunk_id string, rank int")
    got = fuse.multi_query(runs).orderBy("rank").collect()
    assert [(r.chunk_id, r["rank"]) for r in got] == [("b", 1), ("a", 2), ("c", 3)]


def test_hybrid_contributions(spark):
    hit = "query_id int, chunk_id string, rank int"
    out = {r.chunk_id: r for r in fuse.hybrid(spark.createDataFrame([(1, "a", 1)], hit), spark.createDataFrame([(1, "a", 2), (1, "b", 1)], hit), 5).collect()}
    assert out["a"].score == pytest.approx(1 / 61 + 1 / 62) and out["b"].dense_rank is None and out["a"].bm25_contribution == pytest.approx(1 / 62)


def test_merge_best(spark):
    s = "query_id int, chunk_id string, score double, rank int"
    got = fuse.merge_best(spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.4, 2)], s), spark.createDataFrame([(1, "b", 0.5, 1), (1, "c", 0.1, 2)], s)).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("a", 0.5), ("b", 0.5), ("c", 0.1)]


def test_evidence(spark):
    hit = "query_id int, chunk_id string, rank int, score double, topic_id string, content_hash string"
    three = spark.createDataFrame([(1, "x", 1, 0.9, "1", "A"), (1, "y", 2, 0.8, "1", "A"), (1, "z", 3, 0.7, "2", "B")], hit)
    got = {r.chunk_id: r.reason for r in evidence.select_evidence(three, 3, 0.5, 1).collect()}
    assert got == {"x": "selected", "y": "duplicate_content_hash", "z": "selected"}
    # a row that the topic limit rejects does not reserve its hash
    counter = spark.createDataFrame([(1, "x", 1, 0.9, "t1", "h1"), (1, "y", 2, 0.8, "t1", "h2"), (1, "z", 3, 0.7, "t2", "h2"), (1, "w", 4, 0.1, "t3", "h9")], hit)
    got = {r.chunk_id: r.reason for r in evidence.select_evidence(counter, 2, 0.5, 1).collect()}
    assert got == {"x": "selected", "y": "topic_limit_exceeded", "z": "selected", "w": "below_min_score"}
    got = {r.chunk_id: r.reason for r in evidence.select_evidence(counter, 1, 0.0, 5).collect()}
    assert got["y"] == "evidence_top_k_reached"
    assert evidence.select_evidence(three.limit(0)).count() == 0


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "a", 1, 0.0, "red light", "nothing"), (1, "b", 2, 0.4, "red light", "red light"), (1, "c", 3, 0.3, "red light", "red")], "query_id int, chunk_id string, rank int, score double, query string, text string")
    got = rerank.rerank(rows).orderBy("rank").collect()
    assert [(r.chunk_id, r.rank_delta) for r in got] == [("b", 1), ("c", 1), ("a", -2)]
    assert got[0].recall_score == 0.4
    plain = rerank.noop(rows.select("query_id", "chunk_id", "rank", "score")).orderBy("rank").collect()
    assert [r.recall_score for r in plain] == [0.0, 0.4, 0.3] and plain[0].rerank_score is None
    assert rerank.trace_sample(rerank.rerank(rows), "summary").count() == 0


def graph_chunks(spark, n=100, snapshots=("1",)):
    rows = [("m", "k", s, f"chunk-{i}", f"d{i}", "t", "title", ["s"], f"text {i}", i) for s in snapshots for i in range(n)]
    return spark.createDataFrame(rows, "manual_id string, manual_key string, snapshot_id string, chunk_id string, document_id string, topic_id string, title string, section_path array<string>, text string, ordinal long")


def test_graph_is_a_path(spark):
    links = graph.edges(graph_chunks(spark))
    assert links.count() == 198 and graph.degrees(links).agg(F.max("degree")).first()[0] == 2
    pairs = {(r.src, r.dst) for r in links.collect()}
    assert ("chunk-0", "chunk-1") in pairs and ("chunk-98", "chunk-99") in pairs


def test_graph_boundary_and_hop(spark):
    rows = graph_chunks(spark, 1, ("1", "2")).withColumn("chunk_id", F.concat("chunk_id", F.lit("-"), "snapshot_id"))
    assert graph.edges(rows).count() == 0
    chunks = graph_chunks(spark, 2).withColumn("text", F.when(F.col("ordinal") == 0, "needle").otherwise("other"))
    got = graph.graph_retrieve(chunks, spark.createDataFrame([(1, "needle")], "query_id int, text string"), 5).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.seed) for r in got] == [("chunk-0", 1.0, True), ("chunk-1", 0.5, False)]


def test_searches_ask_for_whole_tables(spark, tmp_path):
    import numpy as np

    from veriloom import queries

    values = np.random.default_rng(3).normal(size=(2301, 8)).astype("float32")
    spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(values)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = values.astype(float) / np.linalg.norm(values.astype(float), axis=1)[:, None]
    for name, held in (("dense_topk", np.arange(2301)), ("dense_filtered", np.arange(3, 2301, 5))):
        got = {(r.query_id, r.rank): r.chunk_id for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert {q for q, _ in got} == set(range(0, 2301, 100))
        for q in range(0, 2301, 100):
            scores = np.round(unit[held] @ unit[q], 6)
            assert [got[q, k] for k in range(1, 11)] == held[np.lexsort((held, -scores))][:10].tolist()


def test_hybrid_answers_every_question(spark):
    from veriloom import queries

    data = "/root/testdata/sf0.001"
    items = {r.item_id for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id").collect()}
    got = queries.hybrid_rrf(spark, data).collect()
    assert {r.query_id for r in got if r.dense_rank} == items and len(items) > 20


def test_dense_beyond_the_bound(spark, monkeypatch):
    rng = np.random.default_rng(5)
    own, asked = rng.normal(size=(300, 4)), rng.normal(size=(40, 4))
    table = lambda m, name: spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(m)], f"{name} long, ordinal long, embedding array<float>")
    rows, qs = table(own, "chunk_id"), table(asked, "query_id").drop("ordinal")
    want = sorted(tuple(r) for r in dense.dense(rows, qs, 5, 6).collect())
    monkeypatch.setattr(dense, "BROADCAST_VALUES", 64)
    assert sorted(tuple(r) for r in dense.dense(rows, qs, 5, 6).collect()) == want and len(want) == 200


def test_graph_over_many_partitions(spark):
    rows = [(f"c{i:03d}", i, f"d{i % 40:02d}", "m", "k", "1", f"t{i % 3}", "T", [f"s{i % 2}"], "x") for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id string, ordinal long, document_id string, manual_id string, manual_key string, snapshot_id string, topic_id string, title string, section_path array<string>, text string").repartition(13)
    want = set()
    for key in (6, 8):
        groups = {}
        for r in sorted(rows, key=lambda r: (r[2], r[0])):
            groups.setdefault(str(r[key]), []).append(r[0])
        want |= {p for g in groups.values() for a, b in zip(g, g[1:]) for p in ((a, b), (b, a))}
    assert {(r.src, r.dst) for r in graph.edges(chunks).collect()} == want
