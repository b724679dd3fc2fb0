import hashlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from tests.llm.test_dedup import plain_near  # noqa: E402
from tests.llm.test_texts import best_fit_decreasing  # noqa: E402
from veriloom.llm import entry, packing, secrets, tokens, toxicity  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        kept[name] = docs.count()
    assert before >= kept["toxicity"] >= kept["exact_dedup"] >= kept["near_dedup"] == kept["secret_scans"] > 0
    texts = [r.text for r in docs.collect()]
    assert len({hashlib.sha256(t.encode()).digest() for t in texts}) >= kept["near_dedup"] - 2  # redaction may make two equal
    assert not any(k < 3 for t in texts for _, _, k in secrets.findings(t.encode()))
    out = pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    encode = tokens.encoder(tokens.vocabulary(packing.VOCABULARY))
    assert sum(r.length for r in out) == sum(len(encode.ids(t.encode())) // 4 + 1 for t in texts)


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in entry.QUERIES) == list(range(1, 14))
    assert set(entry.ORACLES) <= set(entry.QUERIES)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secret_scans", "best_fit_packing"]


def test_dedup_stages_without_telling_keys(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = lambda n, end="": " ".join(f"w{n}x{k}" for k in range(120)) + end
    given = [(None, text(1)), (None, text(2)), (None, text(2)), (3, text(3)), (3, text(3)), (4, text(4)), (None, text(4)), (5, text(5)), (5, text(6)), (7, text(6)), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in given], schema)
    out = pipeline.exact_copies_out(spark, docs, DATA)
    assert out.columns == docs.columns
    want = [(None, text(1)), (None, text(2)), (3, text(3)), (4, text(4)), (5, text(5)), (7, text(6)), (8, "")]
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, r.text) for r in out.collect()) == order(want)

    near = [(None, text(1)), (None, text(1, " more")), (None, text(2)), (3, text(3)), (3, text(3)), (None, text(3, " more")), (5, text(5)), (5, text(6)), (6, text(6, " more"))]
    out = pipeline.near_copies_out(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in near], schema), DATA)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert order(got) in (order(w + [(None, text(1, end))]) for w in [[(None, text(2)), (3, text(3)), (5, text(5)), (5, text(6))]] for end in ("", " more"))


def test_all_stages_against_a_plain_run(spark, tmp_path):
    """What run() keeps, redacts and packs is what plain Python does to the same rows."""
    rows = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    scorer = toxicity.Scorer(toxicity.learn(spark, DATA))
    keys = sorted(rows)
    scores = [scorer([(rows[k].text or "").encode()])[0][0] for k in keys]
    left = [k for k, x in zip(keys, scores) if x < toxicity.THRESHOLD]
    last = {rows[k].text or "": k for k in left}
    left = sorted(last.values())
    near = plain_near([(k, rows[k].text) for k in left])
    left = [k for k in left if near[k][2]]
    texts = {}
    for k in left:
        body = rows[k].text
        texts[k] = body and secrets.redacted(body, secrets.findings(body.encode()))
    encode = tokens.encoder(tokens.vocabulary(packing.VOCABULARY))
    pieces = {}
    for k in left:
        n = len(encode.ids((texts[k] or "").encode())) // 4 + 1
        for i, at in enumerate(range(0, n, packing.CAPACITY)):
            pieces[k, i] = (at, min(packing.CAPACITY, n - at))
    out = pipeline.run(spark, DATA).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length) for r in out} == pieces and len(out) == len(pieces)
    assert len({r.sequence_id for r in out}) == best_fit_decreasing([n for _, n in pieces.values()], packing.CAPACITY)


def test_stages_on_odd_rows(spark, tmp_path):
    """Null keys and texts, an empty table, ties, repeats, a long text and columns named as the stages' own."""
    names = ("score", "spans", "digest", "body", "row", "winner", "veriloom_score", "veriloom_row", "kept", "base", "ids")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long_text = "one two three four five six " * 20_000
    given = [(1, None), (2, ""), (None, None), (None, "x y z"), (3, "x y z"), (3, "x y z"), (4, long_text), (5, long_text + "seven"), (6, 'api_key = "abcdefgh1"')]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in given], schema).select("*", *(F.lit("own").alias(n) for n in names))
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for name, stage in pipeline.STAGES[:-1]:
            path = str(tmp_path / f"{name}-{empty}")
            stage(spark, at, DATA).write.parquet(path)
            at = spark.read.schema(docs.schema).parquet(path)
            rows = at.collect()
            assert at.columns == docs.columns and all(r[n] == "own" for r in rows for n in names)
        assert {(r.doc_id, (r.text or "")[:7]) for r in rows} == (set() if empty else {(2, ""), (3, "x y z"), (4, "one two"), (6, "[SECRET")})
        packed = pipeline.STAGES[-1][1](spark, at, DATA).collect()
        assert {r.doc_id for r in packed} == (set() if empty else {2, 3, 4, 6})
