"""Stored indexes and tables: postings with block maxima, vector cells, snapshots."""

import re
import subprocess
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.operators import cells, dense, lexical, postings
from veriloom.sources import snapshots
from veriloom.sources.snapshots import CommitConflict, KeyedTable


def _size(path) -> int:
    return int(subprocess.run(["du", "-sb", str(path)], capture_output=True, text=True).stdout.split()[0])


# ---- postings --------------------------------------------------------------------------------


def _chunks(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        size = int(rng.integers(0, 60))
        words = [f"w{int(x)}" for x in rng.zipf(1.3, size) if x < 5000]
        rows.append((i, i * 7 % n, " ".join(words) + (" 车门门锁" if i % 50 == 3 else "")))
    rows += [(n, n, None), (n + 1, n + 1, "")]
    return spark.createDataFrame(rows, "chunk_id long, ordinal long, text string").repartition(5)


QUESTIONS = [(1, "w1 w2 w77"), (2, "w3 w3 w900 w12"), (3, "nothing here"), (4, "门锁 w1"), (5, ""), (6, "w4 w5 w6 w7 w8 w9 w10 w11"), (7, "w1")]


def _same(got, want):
    key = lambda rows: sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in rows)
    assert key(got.collect()) == key(want.collect())


def test_stored_postings_find_what_scoring_everything_finds(spark, tmp_path):
    chunks, asked = _chunks(spark).cache(), spark.createDataFrame(QUESTIONS, "query_id int, text string")
    index = postings.build(chunks, str(tmp_path / "p"), size=16)
    for k, k1, b in ((1, 1.5, 0.75), (5, 0.9, 0.2), (None, 1.5, 0.75)):
        found = index.search(asked, k, k1, b, digits=6)
        _same(found.hits, lexical.search(chunks, asked, k, k1, b, digits=6))
        asked_for, scored = found.report.agg(F.sum("asked"), F.sum("scored")).first()
        assert scored < asked_for if k else scored == asked_for


def test_block_maxima_leave_out_blocks(spark, tmp_path):
    """One chunk that holds a question whole sets a threshold that ranges of its common words don't reach."""
    rows = [(i, i, "the of and " + f"x{i} " * 20) for i in range(2000)] + [(5000 + i, 5000 + i, "the rare blue door") for i in range(3)]
    index = postings.build(spark.createDataFrame(rows, "chunk_id long, ordinal long, text string"), str(tmp_path / "p"))
    found = index.search(spark.createDataFrame([(1, "the rare blue door")], "query_id int, text string"), 3)
    assert sorted(r.chunk_id for r in found.hits.collect()) == [5000, 5001, 5002]
    told = found.report.first()
    assert told.scored * 5 < told.asked


def test_appended_segments(spark, tmp_path):
    chunks, asked = _chunks(spark), spark.createDataFrame(QUESTIONS, "query_id int, text string")
    index = postings.build(chunks.filter("chunk_id % 3 = 0"), str(tmp_path / "p"))
    first = index.segments()
    index.append(chunks.filter("chunk_id % 3 > 0"))
    assert len(index.segments()) == 2 and set(first) < set(index.segments())
    _same(index.search(asked, 5, digits=6).hits, lexical.search(chunks, asked, 5, digits=6))
    want = {r.token: (r.df, r.cf) for r in lexical.token_stats(lexical.postings(chunks)).collect()}
    assert {r.token: (r.df, r.cf) for r in index.tokens().collect()} == want
    # a segment that was not written to its end does not count
    (tmp_path / "p" / "sbroken" / "blocks").mkdir(parents=True)
    assert len(index.segments()) == 2
    index.drop()
    with pytest.raises(ValueError, match="no postings"):
        index.search(asked)


def test_postings_are_packed_a_few_ranges_at_a_time(spark, tmp_path, monkeypatch):
    """However many chunks a partition has, no batch that is packed holds more than BATCH_ROWS of them."""
    seen, plain = spark.sparkContext.accumulator(0), postings._blocks
    small = spark.sparkContext.accumulator(0)

    def noted(kind, size):
        run = plain(kind, size)

        def watched(batches):
            def each():
                for batch in batches:
                    seen.add(batch.num_rows)
                    small.add(batch.num_rows if batch.num_rows <= postings.BATCH_ROWS else 0)
                    yield batch

            return run(each())

        return watched

    monkeypatch.setattr(postings, "_blocks", noted)
    chunks = spark.range(2000).select(F.col("id").alias("chunk_id"), F.col("id").alias("ordinal"), F.concat(F.lit("a b"), (F.col("id") % 9).cast("string")).alias("text")).coalesce(1)
    index = postings.build(chunks, str(tmp_path / "index"))
    assert seen.value == small.value == 2000
    assert {(r.token, r.df, r.cf) for r in index.tokens().collect()} == {("a", 2000, 2000)} | {(f"b{i}", n, n) for i, n in ((i, len(range(i, 2000, 9))) for i in range(9))}


def test_a_search_moves_blocks_and_not_scores(spark, tmp_path):
    """Ranges beyond the first are scored in one task each: no exchange by question and range, nor by question and chunk."""
    chunks = spark.range(900).select(F.col("id").alias("chunk_id"), F.col("id").alias("ordinal"), F.concat(F.lit("a b"), (F.col("id") % 9).cast("string"), F.lit(" c"), (F.col("id") % 17).cast("string")).alias("text"))
    asked = spark.createDataFrame([(i, f"b{i % 9} a c{i}") for i in range(12)], "query_id int, text string")
    found = postings.build(chunks, str(tmp_path / "index")).search(asked, 40, digits=6)
    plan = found.hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(segment#" in plan and not re.search(r"hashpartitioning\(query_id#[0-9]+L?, (segment|range|chunk_id)", plan)
    _same(found.hits, lexical.search(chunks, asked, 40, digits=6))


def test_postings_of_nothing(spark, tmp_path):
    asked = spark.createDataFrame(QUESTIONS, "query_id int, text string")
    index = postings.build(spark.createDataFrame([(1, 1, "  "), (2, 2, None)], "chunk_id long, ordinal long, text string"), str(tmp_path / "p"))
    assert index.search(asked, 3).hits.collect() == [] and tuple(index.stats().first()) == (2, 1.0)
    assert index.search(asked.limit(0), 3).hits.collect() == []


# ---- cells -----------------------------------------------------------------------------------


def _clustered(spark, n=3000, dimension=16, clusters=30):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(clusters, dimension))
    x = centres[rng.integers(0, clusters, n)] + 0.15 * rng.normal(size=(n, dimension))
    return spark.createDataFrame([(i, i, v.tolist(), i % 3) for i, v in enumerate(x)], "chunk_id long, ordinal long, embedding array<double>, label int")


def _asked(rows):
    return rows.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


def _pairs(hits):
    return {(r.query_id, r.chunk_id) for r in hits.collect()}


def test_cells_of_clustered_vectors(spark, tmp_path):
    rows = _clustered(spark)
    index = cells.CellIndex.build(rows, str(tmp_path / "c"))
    assert index.rows().count() == 3000 and sum(c.n for c in index.cells()) == 3000
    want = _pairs(dense.dense(rows, _asked(rows), 10, 6))
    found = index.search(_asked(rows), 10, recall=0.95, digits=6)
    assert len(want & _pairs(found.hits)) >= 0.9 * len(want)
    read = [r.rows for r in found.report.collect()]
    assert len(read) == 30 and sum(read) < 0.25 * 30 * 3000
    exact = index.search(_asked(rows), 10, recall=0.9, exact=True, digits=6)
    assert {(r.query_id, r.rank, r.chunk_id, r.score) for r in exact.hits.collect()} == {(r.query_id, r.rank, r.chunk_id, r.score) for r in dense.dense(rows, _asked(rows), 10, 6).collect()}
    assert sum(r.rows for r in exact.report.collect()) < 30 * 3000
    plan = index.search(_asked(rows).limit(1), 10, probes=1).hits
    some = index.search(_asked(rows), 5, exact=True, digits=6, where=F.col("label") == 1)
    _same(some.hits, dense.dense(rows.filter("label = 1"), _asked(rows), 5, 6))
    assert plan.count() == 10


def test_cells_of_odd_vectors(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    held = [(i, i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 6)))] + [(400, 400, [0.0] * 6), (401, 401, None)] + [(500 + i, 500 + i, [1.0] * 6) for i in range(30)]
    rows = spark.createDataFrame(held, "chunk_id long, ordinal long, embedding array<double>")
    index = cells.CellIndex.build(rows, str(tmp_path / "c"), cells=12)
    known, asked = rows.filter("embedding is not null"), rows.filter("embedding is not null and chunk_id % 25 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    want = dense.dense(known, asked, 7, 6)
    _same(index.search(asked, 7, probes=2, exact=True, digits=6).hits, want)
    monkeypatch.setattr(cells, "BROADCAST_VALUES", 60)
    _same(index.search(asked, 7, probes=2, exact=True, digits=6).hits, want)
    none = cells.CellIndex.build(rows.limit(0), str(tmp_path / "e"))
    assert none.search(asked, 3).hits.collect() == []


# ---- snapshots -------------------------------------------------------------------------------


def _rows(spark, ids, value):
    payload = np.random.default_rng(5).random((len(ids), 64)).tolist()
    return spark.createDataFrame([(i, value, p) for i, p in zip(ids, payload, strict=True)], "id long, value string, payload array<double>")


def _held(table, version=None):
    return {r.id: r.value for r in table.read(version).collect()}


def test_changes_are_written_beside_the_rows(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id")
    assert table.upsert(_rows(spark, range(5000), "a")) == 1
    before = _size(tmp_path / "t")
    table.upsert(_rows(spark, range(0, 5000, 100), "b"))
    assert _size(tmp_path / "t") - before < 0.03 * before
    table.delete(spark.createDataFrame([(i,) for i in range(50, 60)] + [(99_999,), (None,)], "id long"))
    table.apply(_rows(spark, [55, 7000], "c"), spark.createDataFrame([(55,), (1,)], "id long"))
    want = dict.fromkeys(range(5000), "a") | dict.fromkeys(range(0, 5000, 100), "b")
    for i in range(50, 60):
        want.pop(i)
    want |= {55: "c", 7000: "c"}
    want.pop(1)
    assert _held(table) == want and table.read().count() == len(want)
    # older snapshots stay readable
    assert _held(table, 1) == dict.fromkeys(range(5000), "a") and len(_held(table, 2)) == 5000
    # merged rows are those that were read before, and only changed buckets are written
    version = table.compact()
    assert _held(table) == want and {f.kind for f in table.manifest().folders} == {"base"} and table.compact() == version
    assert table.vacuum() > 0 and table.versions() == [version] and _held(table) == want
    with pytest.raises(ValueError, match="more than once"):
        table.upsert(_rows(spark, [3, 3], "d"))
    assert _held(table) == want


def test_a_lost_commit_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), "id")
    table.upsert(_rows(spark, range(10), "a"))

    def lost(self, manifest):
        raise OSError("the writer is gone")

    with monkeypatch.context() as patched:
        patched.setattr(KeyedTable, "_claim", lost)
        with pytest.raises(OSError):
            table.upsert(_rows(spark, range(5), "b"))
    assert _held(table) == dict.fromkeys(range(10), "a")
    # a writer that died within its manifest: the file is there and is no manifest
    (tmp_path / "t" / "manifests" / "v000000000002.json").write_text('{"version": 2, "fold')
    assert table.manifest().version == 1 and _held(table) == dict.fromkeys(range(10), "a")
    assert table.upsert(_rows(spark, [1], "c")) == 3
    assert _held(table)[1] == "c" and table.vacuum() == 1  # what the lost writer left


def test_two_writers(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), "id")
    table.upsert(_rows(spark, range(10), "a"))
    made = [threading.Thread(target=lambda i=i: KeyedTable(spark, str(tmp_path / "t"), "id").upsert(_rows(spark, [i], f"w{i}"))) for i in range(3)]
    for t in made:
        t.start()
    for t in made:
        t.join()
    assert _held(table) == dict.fromkeys(range(10), "a") | {i: f"w{i}" for i in range(3)}
    assert table.manifest().version == 4
    # a compaction that another one overtook gives up, and changes nothing
    write = KeyedTable._write

    def overtaken(self, rows, buckets):
        out = write(self, rows, buckets)
        monkeypatch.setattr(KeyedTable, "_write", write)
        KeyedTable(spark, str(tmp_path / "t"), "id").compact()
        return out

    monkeypatch.setattr(KeyedTable, "_write", overtaken)
    with pytest.raises(CommitConflict):
        table.compact()
    assert _held(table) == dict.fromkeys(range(10), "a") | {i: f"w{i}" for i in range(3)}


def test_changes_that_outnumber_the_base_are_merged(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id")
    table.upsert(_rows(spark, range(10), "a"))
    for i in range(6):
        table.upsert(_rows(spark, [i], "b"))
    assert any(f.kind == "base" and f.version > 1 for f in table.manifest().folders)
    assert _held(table) == dict.fromkeys(range(10), "a") | dict.fromkeys(range(6), "b")
    table.replace(_rows(spark, [4], "z"))
    assert _held(table) == {4: "z"}
    table.delete(spark.createDataFrame([(4,)], "id long"))
    assert _held(table) == {} and snapshots.COMPACT_SHARE == 0.5
