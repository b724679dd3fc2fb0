import json
import math
import random

import pytest
from pyspark.sql import functions as F

from veriloom import __main__ as cli
from veriloom.operators import reports
from veriloom.plans.ingest import ingest
from veriloom.plans.settings import Settings
from veriloom.sources import catalog, crawl, tables

ROOT = "https://h.io/app/manuals"


def manuals(spark, texts):
    """entries and pages of manuals: {key: {topic: text}}, None for a broken index."""
    entries, pages = [], []
    for key, topics in texts.items():
        at = f"{ROOT}/{key}/1"
        entries.append((f"{at}/index.html", key, "1", f"Manual {key}", "v1"))
        items = "".join(f'<li><a href="{t}.html">{t}</a></li>' for t in topics or {})
        pages.append((f"{at}/index.html", "<p>moved</p>" if topics is None else f'<div id="menu" data-number="{key}" data-title="Car"></div><ul id="manual-nav">{items}</ul>'))
        for t, body in (topics or {}).items():
            if body is not None:
                pages.append((f"{at}/{t}.html", f'<article role="article"><h1>{t}</h1><div class="body"><p>{body}</p></div></article>'))
    return spark.createDataFrame(entries, "url string, manual_key string, snapshot_id string, name string, version string"), spark.createDataFrame(pages, "url string, html string")


def test_failures_stay_with_their_manual(spark):
    first = ingest(*manuals(spark, {"a": {"t1": "one", "t2": "two"}, "b": {"t1": "bee"}}))
    assert {(r.manual_key, r.status, r.chunks) for r in first.manuals.collect()} == {("a", "completed", 2), ("b", "completed", 1)}
    again = ingest(*manuals(spark, {"a": {"t1": "one", "t2": "changed"}, "b": None, "c": {"t1": None}}), first.index, first.cache)
    assert {(r.manual_key, r.status, r.error) for r in again.manuals.collect()} == {("a", "completed", None), ("b", "failed", "no navigation list"), ("c", "failed", "no chunks to index")}
    held = {(r.manual_key, r.text.split("正文：\n")[1]) for r in again.index.collect()}
    assert held == {("a", "one"), ("a", "changed"), ("b", "bee")}  # the failed manual keeps what it had
    told = again.report.first()
    assert (told.reused, told.embedded, told.stale, told.completed, told.failed) == (1, 1, 1, 1, 2)
    with pytest.raises(RuntimeError, match="b: no navigation list"):
        ingest(*manuals(spark, {"a": {"t1": "one"}, "b": None}), fail_fast=True)
    forced = ingest(*manuals(spark, {"a": {"t1": "one", "t2": "two"}}), first.index, first.cache, force_embed=True)
    assert forced.cache.count() == 2 and forced.index.count() == 3
    small = ingest(*manuals(spark, {"a": {"t1": "one"}}), settings=Settings(dimension=8)).index.first()
    assert len(small.embedding) == 8


def test_crawl_tries_again_and_resumes(spark, tmp_path):
    targets = spark.createDataFrame([("https://h/a",), ("https://h/b",), ("https://h/c",), ("https://h/d",), ("https://h/a",)], "url string")
    known = spark.createDataFrame([("https://h/b", "e1", None, "held b")], "url string, etag string, last_modified string, html string")

    def load():
        tries = {}

        def fetch(url, etag, modified):
            tries[url] = tries.get(url, 0) + 1
            if url.endswith("b"):
                assert etag == "e1"
                return 304, etag, modified, None
            if url.endswith("c"):
                return 404, None, None, None
            if tries[url] < 3:
                raise OSError("try again")
            return (200, "n", "m", "body") if url.endswith("a") else (503, None, None, None)

        return fetch

    pages = crawl.crawl(targets, known, load, retries=3, pause=0.01, interval=0.001).cache()
    got = {r.url[-1]: (r.status, r.http, r.html) for r in pages.collect()}
    assert got == {"a": ("ok", 200, "body"), "b": ("reused", 304, "held b"), "c": ("failed", 404, None), "d": ("failed", 503, None)}
    assert tuple(crawl.crawl_report(pages).first()) == (4, 1, 1, 2)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.html").write_text("été", encoding="utf-8")
    lines = spark.createDataFrame([(0, '{"url": "https://h/a", "status": "ok", "path": "x/a.html"}'), (1, "broken")], "ordinal long, value string")
    assert [tuple(r) for r in crawl.stored_pages(spark, str(tmp_path), catalog.manifest_state(lines)).collect()] == [("https://h/a", "été")]


def test_catalogs_are_fetched_from_their_host(spark):
    payload = ("﻿" + json.dumps([{"id": 1, "url": f"{ROOT}/k/7/index.html?x", "name": "K", "version": "2"}])).encode()
    got = catalog.parsed(catalog.fetched(spark, "https://h.io/c.json", ["h.io"], lambda url: payload), ["h.io"]).first()
    assert (got.manual_key, got.snapshot_id, got.name, got.publishDate) == ("k", "7", "K", None)
    for bad in ("http://h.io/c.json", "https://other.io/c.json"):
        with pytest.raises(ValueError, match="catalog url"):
            catalog.fetched(spark, bad, ["h.io"], lambda url: payload)
    with pytest.raises(ValueError, match="list of objects"):
        catalog.fetched(spark, "https://h.io/c.json", ["h.io"], lambda url: b"{}")


def test_command_line_flows(spark, tmp_path, capsys):
    entries, pages = manuals(spark, {"a": {"t1": "red light"}, "b": None})
    (tmp_path / "catalog.json").write_text(json.dumps([{"id": i, "url": r.url, "name": r.name, "version": "v1"} for i, r in enumerate(entries.collect())]))
    pages.write.parquet(str(tmp_path / "pages"))
    args = [str(tmp_path / "catalog.json"), str(tmp_path / "pages"), str(tmp_path / "index"), "--host", "h.io"]
    assert cli.main(["batch", *args]) == 1 and "no navigation list" in capsys.readouterr().out
    assert cli.main(["ingest", *args, "--select", "manual a|/a/"]) == 0
    assert tables.VectorTable(spark, str(tmp_path / "index" / "vectors"), 64).count() == 1
    with pytest.raises(RuntimeError):
        cli.main(["ingest", *args])
    chunks = spark.createDataFrame([("c0", 0, "red light"), ("c1", 1, "seat belt")], "chunk_id string, ordinal long, text string")
    chunks.write.parquet(str(tmp_path / "chunks"))
    cases = spark.createDataFrame([(1, "red", "single", True, ["c0"])], "query_id int, text string, question_type string, answerable boolean, gold_chunk_ids array<string>")
    cases.write.parquet(str(tmp_path / "cases"))
    for name, b in (("base", 0.75), ("flat", 0.5)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"retrieval": {"retriever": "bm25", "bm25_b": b}}))
    places = [str(tmp_path / "chunks"), str(tmp_path / "cases")]
    assert cli.main(["suite", *places, str(tmp_path / "s"), str(tmp_path / "base.json"), str(tmp_path / "flat.json")]) == 0
    assert {(r.config_id, r.scope, r.rr) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {(c, s, 1.0) for c in ("base", "flat") for s in ("all", "single")}
    assert cli.main(["evaluate", *places, str(tmp_path / "e"), "--config", str(tmp_path / "base.json")]) == 0


def test_percentiles_survive_outliers(spark, monkeypatch):
    """Intervals are refined until few values are left, however far away a single one is."""
    monkeypatch.setattr(reports, "MEET", 50)
    monkeypatch.setattr(reports, "BUCKETS", 8)
    rng = random.Random(4)
    inf = float("inf")
    groups = {"a": [rng.random() for _ in range(900)] + [1e300], "b": [inf, -inf] + [rng.gauss(0, 1) for _ in range(400)], "c": [2.5] * 700 + [1e-310, -1e308], None: [10.0 ** rng.uniform(-9, 9) for _ in range(500)]}
    met = []
    within = reports._within
    monkeypatch.setattr(reports, "_within", lambda rows, state, by: met.append(state.agg(F.max("here")).first()[0]) or within(rows, state, by))
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: [r.p50, r.p95, r.p99] for r in reports.latency_percentiles(df, "v", "k").collect()}
    for k, vs in groups.items():
        ordered = sorted(vs)
        want = []
        for q in (0.5, 0.95, 0.99):
            at = q * (len(vs) - 1)
            low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
            want.append(low if low == high else low + (high - low) * (at - math.floor(at)))
        assert got[k] == pytest.approx(want)
    assert met[-1] <= 50 and len(met) > 2


def test_percentiles_are_exact(spark):
    import numpy as np

    from veriloom.operators import reports

    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.exponential(size=999)] + [("b", 3.0)] * 7 + [(None, float(v)) for v in rng.integers(0, 4, 50)] + [("a", None), ("c", 1.5), ("a", 1e9)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.p50, r.p95, r.p99) for r in reports.latency_percentiles(df, "v", "k").collect()}
    for k in ("a", "b", "c", None):
        values = [v for x, v in rows if x == k and v is not None]
        assert got[k] == pytest.approx(np.quantile(values, [0.5, 0.95, 0.99]).tolist())
    assert reports.latency_percentiles(df.limit(0), "v", "k").count() == 0


def test_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from veriloom.session import shared_folder

    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda _: None), getCheckpointDir=lambda: None, master="spark://x")
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context))
    named = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda _: "hdfs://x/y/"), master="spark://x")
    assert shared_folder(SimpleNamespace(sparkContext=named)) == "hdfs://x/y"
