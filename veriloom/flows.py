"""Flows over several operators as queries: ingestion, stores, the engine, suites; with their oracles.

Pages become manuals here: a host is a manual, its pages are topics of simple HTML. Model clients are
small functions whose answers SQL can tell too.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import filters, text
from .operators import chunking, datasets, planning, rerank
from .plans import recorder, suite
from .plans.engine import Engine
from .plans.ingest import ingest
from .plans.registry import Clients
from .plans.settings import Query, Retrieval, Settings
from .queries import _BM25, _PER_CASE, DIGITS, TOP_K, _cases, _chunks, _gold, _lexical, _questions, _t, query
from .session import among, shared_folder
from .sources import catalog, crawl, html, tables

ROOT = "https://cdn.example/app/manuals/"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/veriloom-{name}-{uuid.uuid4().hex}"


# ---- manuals made of pages -----------------------------------------------------------------


def _manuals(spark: SparkSession, d: str, without: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, pages). Hosts that begin with m. have a broken index; every tenth page has no topic,
    every 25th is missing. without: pages whose id gives this modulo 6 are on no list."""
    rows = _t(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    path = lambda name: F.concat(F.lit(ROOT), "host", F.lit("/7/"), name)
    id_ = F.col("page_id").cast("string")
    listed = rows if without is None else rows.filter(F.col("page_id") % 6 != without)
    items = listed.groupBy("host").agg(F.array_sort(F.collect_list("page_id")).alias("ids"))
    item = lambda i: F.concat(F.lit('<li><a data-content="t'), i.cast("string"), F.lit('.html">Page '), i.cast("string"), F.lit("</a></li>"))
    nav = F.concat(F.lit('<html><body><div id="menu" data-number="'), "host", F.lit('" data-title="Model '), "host", F.lit('"></div><ul id="manual-nav">'), F.array_join(F.transform("ids", item), ""), F.lit("</ul></body></html>"))
    indexes = items.select(path(F.lit("index.html")).alias("url"), F.when(F.startswith("host", F.lit("m.")), "<p>moved</p>").otherwise(nav).alias("html"))
    shown = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    topic = F.concat(F.lit('<html><body><main><article role="article"><h1>Topic '), id_, F.lit('</h1><div class="body"><p>'), shown, F.lit("</p><ul><li>one</li><li>two</li></ul></div></article></main></body></html>"))
    page = F.when(F.col("page_id") % 10 == 3, "<html><body>empty</body></html>").otherwise(topic)
    topics = rows.filter(F.col("page_id") % 25 > 0).select(path(F.concat(F.lit("t"), id_, F.lit(".html"))).alias("url"), page.alias("html"))
    hosts = rows.select("host").distinct()
    entries = hosts.select(path(F.lit("index.html")).alias("url"), F.col("host").alias("manual_key"), F.lit("7").alias("snapshot_id"), F.concat(F.lit("Manual "), "host").alias("name"), F.lit("v1").alias("version"))
    return entries, indexes.unionByName(topics)


_PAGES = """g AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages),
t AS (SELECT *, starts_with(host, 'm.') AS broken, page_id % 25 > 0 AND page_id % 10 <> 3 AS good FROM g),
c AS (SELECT host, page_id, 'Topic ' || page_id AS title, '车型：Model ' || host || chr(10) || '手册版本：v1' || chr(10) || '路径：Page ' || page_id || ' > Topic ' || page_id || chr(10) || '标题：Topic ' || page_id || chr(10) || '正文：' || chr(10) || url || chr(10) || '- one' || chr(10) || '- two' AS text
  FROM t WHERE good AND NOT broken)"""


@query("""WITH g AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)
SELECT host AS manual_id, 'Model ' || host AS vehicle_model, count(*) OVER (PARTITION BY host)::INT AS refs, (row_number() OVER (PARTITION BY host ORDER BY page_id) - 1)::INT AS place, 't' || page_id AS topic_id, 'Page ' || page_id AS crumbs,
 'https://cdn.example/app/manuals/' || host || '/7/t' || page_id || '.html' AS source_url, NULL AS error FROM g WHERE NOT starts_with(host, 'm.')
UNION ALL SELECT DISTINCT NULL, NULL, NULL::INT, NULL::INT, NULL, NULL, 'https://cdn.example/app/manuals/' || host || '/7/index.html', 'no navigation list' FROM g WHERE starts_with(host, 'm.')""")
def nav_tree(spark, d):
    """Navigation lists of all manuals; unreadable ones are a row with their error."""
    _, pages = _manuals(spark, d)
    found = html.parse_navigation(pages.filter(F.endswith("url", F.lit("index.html"))))
    return found.select("manual_id", "vehicle_model", "refs", "place", "topic_id", F.array_join("breadcrumbs", ">").alias("crumbs"), F.coalesce("source_url", "index_url").alias("source_url"), "error")


@query(f"""WITH {_PAGES}, n AS (SELECT host, count(*) AS refs, count(*) FILTER (good) AS chunks FROM t GROUP BY host)
SELECT host AS manual_key, CASE WHEN starts_with(host, 'm.') OR chunks = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN starts_with(host, 'm.') THEN 'no navigation list' WHEN chunks = 0 THEN 'no chunks to index' END AS error,
 CASE WHEN starts_with(host, 'm.') THEN 0 ELSE refs END AS topics, CASE WHEN starts_with(host, 'm.') THEN 0 ELSE chunks END AS documents, CASE WHEN starts_with(host, 'm.') THEN 0 ELSE chunks END AS chunks FROM n""")
def batch_ingest(spark, d):
    """All manuals in one run; the failures of some don't stop the others."""
    return ingest(*_manuals(spark, d)).manuals.select("manual_key", "status", "error", "topics", "documents", "chunks")


@query(f"""WITH {_PAGES}, u AS (SELECT *, sha256(text) AS h, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(host || '|7|t' || page_id || '|' || title || '|1|' || sha256(text))) AS s FROM c)
SELECT s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || substr('89ab', (('0x' || s[17])::INT % 4) + 1, 1) || s[18:20] || '-' || s[21:32] AS chunk_id, host || ':7:t' || page_id AS document_id, title, text, h AS content_hash, true AS has_vector FROM u""")
def ingest_run(spark, d):
    """The index after a first run: strict topics, chunk texts, ids, vectors."""
    out = ingest(*_manuals(spark, d)).index
    return out.select("chunk_id", "document_id", "title", "text", "content_hash", (F.size("embedding") == 64).alias("has_vector"))


@query(f"""WITH {_PAGES}, ok AS (SELECT host FROM c WHERE page_id % 6 <> 2 GROUP BY host), k AS (SELECT c.* FROM c JOIN ok USING (host))
SELECT count(*) FILTER (page_id % 6 <> 2) AS chunks, count(*) FILTER (page_id % 6 NOT IN (1, 2)) AS reused, count(*) FILTER (page_id % 6 = 1) AS embedded, 0::BIGINT AS cache_hits, count(*) FILTER (page_id % 6 IN (1, 2)) AS stale, count(*) FILTER (page_id % 6 <> 2) + (SELECT count(*) FROM c WHERE host NOT IN (SELECT host FROM ok)) AS indexed FROM k""")
def ingest_again(spark, d):
    """A second run: a sixth of the topics has another text, a sixth is on no list any more."""
    first = ingest(*_manuals(spark, d))
    entries, pages = _manuals(spark, d, without=2)
    number = F.regexp_extract("url", "/t([0-9]+)[.]html$", 1).try_cast("long")
    pages = pages.withColumn("html", F.when(number % 6 == 1, F.replace("html", F.lit("<li>two</li>"), F.lit("<li>three</li>"))).otherwise(F.col("html")))
    again = ingest(entries, pages, first.index, first.cache)
    size = again.index.agg(F.count(F.lit(1)).alias("indexed"))
    return again.report.select("chunks", "reused", "embedded", "cache_hits", "stale").crossJoin(F.broadcast(size))  # one row each


_TOPIC = """<html><body><main><article role="article"><h1> Safe  drive </h1><article class="topic"><h2>Belts</h2><div class="body"><p>Put it on.</p><ul><li>front</li><li>back</li></ul><ol><li>one</li><li></li><li>three</li></ol><div class="warning"><p>Danger</p><p>second</p></div><section>bare<p>inner</p></section><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><figure><img src="x/y.png" alt="belt"></figure></div></article><article class="topic"><div class="body"><p>untitled</p></div></article></article></main></body></html>"""


@query("""SELECT * FROM (VALUES ('p1', 0::INT, 'Belts', 2::INT, 'Safe drive>Belts', 'Put it on.|- front|- back|1. one|3. three|[警告] Danger|second|inner|a | b' || chr(10) || '1 | 2', 'https://h.io/m/x/y.png'),
 ('p1', 1, 'Page', 2, 'Safe drive', 'untitled', '')) t(topic_id, place, title, level, path, blocks, images)""")
def strict_topics(spark, d):
    """The topic contract on one page that has every kind of block, beside pages that are no topics."""
    rows = [("p1", _TOPIC), ("p2", "<html><body>empty</body></html>"), ("p3", "<article><h1>no role</h1><div class='body'><p>x</p></div></article>"), ("p4", "<article role='article'><h1>nothing in it</h1></article>")]
    pages = spark.createDataFrame(rows, "topic_id string, html string").select("topic_id", F.lit("Page").alias("title"), F.array(F.lit("a")).alias("breadcrumbs"), F.lit("https://h.io/m/t.html").alias("source_url"), F.lit("t.html").alias("source_file"), F.lit("m").alias("manual_id"), F.lit("1").alias("snapshot_id"), F.lit("x").alias("vehicle_model"), "html")
    out = html.parse_topics(pages).select("topic_id", F.posexplode("sections").alias("place", "s"))
    return out.select("topic_id", "place", "s.title", "s.level", F.array_join("s.path", ">").alias("path"), F.array_join("s.blocks", "|").alias("blocks"), F.array_join("s.images.url", "|").alias("images"))


@query("""SELECT doc_id, sha256('车型：' || lang || chr(10) || '手册版本：v' || (doc_id % 3) || chr(10) || '路径：' || source || ' > ' || lang || chr(10) || '标题：' || lang || chr(10) || '正文：' || chr(10) || text) AS text_sha256 FROM documents WHERE doc_id % 3 > 0
UNION ALL SELECT doc_id, sha256('车型：' || lang || chr(10) || '路径：' || source || ' > ' || lang || chr(10) || '标题：' || lang || chr(10) || '正文：' || chr(10) || text) FROM documents WHERE doc_id % 3 = 0""")
def chunk_text(spark, d):
    """Whole texts as chunks with their prefix lines; the version line only where there is one."""
    rows = _t(spark, d, "documents")
    section = F.struct(F.col("lang").alias("title"), F.lit(1).alias("level"), F.array("lang").alias("path"), F.array("text").alias("blocks"), F.expr("cast(array() as array<struct<url: string>>)").alias("images"))
    documents = rows.select(F.col("doc_id").cast("string").alias("document_id"), F.lit("m").alias("manual_id"), F.lit("1").alias("snapshot_id"), F.col("lang").alias("vehicle_model"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string"))).alias("manual_version"), F.col("doc_id").cast("string").alias("topic_id"), F.lit("t").alias("title"), F.array("source").alias("breadcrumb"), F.lit("u").alias("source_url"), F.array(section).alias("sections"))
    return chunking.chunk_documents(documents, chunking.Chunking(1_000_000, 0)).select(F.col("document_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("text_sha256"))


# ---- sources and stores --------------------------------------------------------------------


@query("""SELECT url, CASE WHEN known THEN 'reused' WHEN contains(url, 'org') AND ends_with(url, '.html') THEN 'failed' ELSE 'ok' END AS status,
 CASE WHEN known THEN 304 WHEN contains(url, 'org') AND ends_with(url, '.html') THEN NULL ELSE 200 END::INT AS http, CASE WHEN known THEN 'held' WHEN contains(url, 'org') AND ends_with(url, '.html') THEN NULL ELSE 'body of ' || url END AS html
FROM (SELECT url, bool_or(page_id % 3 = 0) AS known FROM pages GROUP BY url)""")
def crawl_resume(spark, d):
    """A third of the pages is held and asked for conditionally; some requests fail for good."""
    rows = _t(spark, d, "pages")
    known = rows.filter("page_id % 3 = 0").select("url").distinct().select("url", F.lit("tag").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit("held").alias("html"))

    def load():
        def fetch(url, etag, modified):
            if etag:
                return 304, etag, modified, None
            if "org" in url and url.endswith(".html"):
                raise OSError("refused")
            return 200, "new", None, "body of " + url

        return fetch

    return crawl.crawl(rows, known, load, retries=1, pause=0.0).select("url", "status", "http", "html")


@query("""SELECT url, arg_max(path, event_id) AS path FROM (SELECT event_id, 'u' || user_id AS url, 'p' || event_id AS path, event_type FROM events WHERE event_id % 7 > 0) WHERE event_type <> 'error' GROUP BY url""")
def manifest_lines(spark, d):
    """An append-only manifest of JSON lines, a seventh of them broken off."""
    row = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("path"))
    line = F.when(F.col("event_id") % 7 > 0, F.to_json(row)).otherwise('{"url": "u')
    lines = _t(spark, d, "events").select(F.col("event_id").alias("ordinal"), line.alias("value"))
    return catalog.manifest_state(lines).select("url", "path")


@query("""SELECT n_nationkey AS ordinal, n_nationkey AS id, 'https://cdn.example/app/manuals/' || lower(replace(n_name, ' ', '-')) || '/' || n_regionkey || '/index.html' AS url, n_name AS name,
 lower(replace(n_name, ' ', '-')) AS manual_key, n_regionkey::VARCHAR AS snapshot_id FROM nation""")
def catalog_file(spark, d):
    """A catalog file with a byte order mark, read and parsed; the fetched form gives the same rows."""
    url = F.concat(F.lit(ROOT), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit("/"), F.col("n_regionkey").cast("string"), F.lit("/index.html?v=2"))
    entry = F.struct(F.col("n_nationkey").alias("id"), url.alias("url"), F.lit("2025-01-01").alias("publishDate"), F.lit("1").alias("version"), F.col("n_name").alias("name"))
    folder = _folder(spark, "catalog")
    told = _t(spark, d, "nation").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("j"))  # 25 rows
    told.select(F.concat(F.lit("﻿"), "j").alias("value")).coalesce(1).write.text(folder)
    read = catalog.read_catalog(spark, f"{folder}/part-*")
    payload = ("﻿" + json.dumps([r.asDict() for r in read.drop("ordinal").collect()])).encode()
    fetched = catalog.fetched(spark, "https://cdn.example/catalog.json", ["cdn.example"], lambda _: payload)
    out = catalog.parsed(fetched.unionByName(read).distinct(), ["cdn.example"])
    return out.select("ordinal", "id", "url", "name", "manual_key", "snapshot_id")


@query("SELECT vec_id AS chunk_id, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS label, 64::INT AS size, round(embedding[1]::DOUBLE, 6) AS head FROM embeddings WHERE vec_id % 7 > 0")
def vector_table(spark, d):
    """A vector table: all rows in, a fifth replaced, a seventh deleted, and read back."""
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", "embedding")
    table = tables.VectorTable(spark, _folder(spark, "vector-table"), 64)
    table.upsert(rows)
    table.upsert(rows.filter("chunk_id % 5 = 0").withColumn("label", F.lit(-1)))
    table.delete(rows.filter("chunk_id % 7 = 0"))
    if not table.health() or table.generation() != 3:
        raise RuntimeError("the table has not three generations")
    return table.read().select("chunk_id", "label", F.size("embedding").alias("size"), F.round(F.col("embedding")[0].cast("double"), DIGITS).alias("head"))


@query("SELECT doc_id::VARCHAR AS chunk_id, source AS manual_key, sha256(text) AS text_sha256, 'part ' || (doc_id % 7) AS section FROM documents")
def jsonl_chunks(spark, d):
    """Chunk files written as JSON lines, with repeated chunks, and read by glob."""
    folder = _folder(spark, "jsonl")
    rows = _chunks(spark, d).withColumn("chunk_id", F.col("chunk_id").cast("string")).withColumn("document_id", F.col("document_id").cast("string")).drop("ordinal")
    tables.write_jsonl(rows, f"{folder}/a")
    tables.write_jsonl(rows.filter("cast(chunk_id as long) % 4 = 0").withColumn("text", F.lit("later copy")), f"{folder}/b")
    return tables.read_chunks(spark, f"{folder}/*").select("chunk_id", "manual_key", F.sha2("text", 256).alias("text_sha256"), F.element_at("section_path", 1).alias("section"))


# ---- questions -----------------------------------------------------------------------------


@query(f"WITH {_BM25}, h AS (SELECT query_id, chunk_id FROM lex WHERE rank <= {TOP_K}) SELECT query_id, chunk_id FROM h JOIN documents ON doc_id = chunk_id WHERE query_id % 3 = 2 OR (query_id % 3 = 0 AND lang = 'en') OR (query_id % 3 = 1 AND source IN ('src1', 'src2', 'src3'))")
def filters_batched(spark, d):
    """Hits of questions with different filters, each by its own."""
    none = F.lit(None).cast("string")
    m = F.col("query_id") % 3
    told = F.struct(none.alias("manual_id"), F.lit("").alias("snapshot_id"), F.when(m == 0, "en").alias("vehicle_model"), F.when(m == 1, F.array(*map(F.lit, ("src1", "src2", "src3")))).alias("manual_keys"), F.expr("cast(array() as array<string>)").alias("manual_names"), F.expr("cast(null as array<string>)").alias("topic_ids"))
    rows = _lexical(spark, d).select("query_id", "chunk_id").join(_chunks(spark, d).withColumn("manual_name", none).drop("text"), "chunk_id").withColumn("filters", told)
    return rows.filter(filters.batched()).select("query_id", "chunk_id")


def _first_words(c: str, n: int = 5) -> str:
    return f"array_to_string(regexp_extract_all({c}, '[^ ]+')[1:{n}], ' ')"


def _word_parts(question: str) -> list[str]:
    words = [w for w in question.split(" ") if w]
    return [" ".join(words[:5]), " ".join(words[5:10]) or " ".join(words[:5])]


@query("SELECT item_id AS query_id, array_to_string(list_distinct_ordered, '|') AS queries, 'rrf' AS fusion_strategy FROM (SELECT item_id, CASE WHEN b = '' OR b = a THEN [a] ELSE [a, b] END AS list_distinct_ordered FROM (SELECT item_id, array_to_string(w[1:5], ' ') AS a, array_to_string(w[6:10], ' ') AS b FROM (SELECT item_id, regexp_extract_all(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')), '[^ ]+') AS w FROM benchmark)))")
def decomposition(spark, d):
    """A planner client asked once per question; its sub-questions as a plan."""
    planner = lambda: lambda prompt: json.dumps({"queries": _word_parts(" ".join(prompt.split("\n", 1)[1].split()))})
    engine = Engine(_chunks(spark, d), Settings(query=Query(processor="decomposition")), clients=Clients(planner=planner))
    return engine.plan(_questions(spark, d)).select("query_id", F.array_join("queries", "|").alias("queries"), "fusion_strategy")


@query(f"""WITH {_BM25} SELECT l.query_id, l.chunk_id::VARCHAR AS chunk_id, l.rank::VARCHAR AS rank, sha256(substr(d.text, 1, 100)) AS excerpt_sha256, l.query_id % 2 = 0 AS has_text FROM lex l JOIN documents d ON d.doc_id = l.chunk_id WHERE l.rank <= 3""")
def candidate_json(spark, d):
    """Candidates as traces keep them: an excerpt, or the whole text."""
    found = rerank.noop(_lexical(spark, d, 3))
    hits = found.join(among(_chunks(spark, d), found, "chunk_id").select("chunk_id", "text", "title", "source_url"), "chunk_id")
    part = lambda level, m: rerank.serialized(hits.filter(F.col("query_id") % 2 == m), level, 100)
    rows = part("full", 0).unionByName(part("sampled", 1))
    get = lambda name: F.get_json_object("candidate", f"$.{name}")
    return rows.select("query_id", get("chunk_id").alias("chunk_id"), get("rank").alias("rank"), F.sha2(F.coalesce(get("excerpt"), F.substring(get("text"), 1, 100)), 256).alias("excerpt_sha256"), get("text").isNotNull().alias("has_text"))


_PIPELINE = Retrieval(retriever="bm25", top_k=5, candidate_top_k=20, score_digits=DIGITS)


@query(f"""WITH {_BM25},
p AS (SELECT l.query_id, l.chunk_id, l.rank AS before_rank, l.score AS recall_score, len(list_intersect(list_distinct(q.ts), list_distinct(c.ts)))::DOUBLE / len(list_distinct(q.ts)) AS score
  FROM lex l JOIN qtok q USING (query_id) JOIN ctok c USING (chunk_id) WHERE l.rank <= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before_rank) AS rank FROM p)
SELECT query_id, chunk_id, round(score, 6) AS score, rank, recall_score FROM r WHERE rank <= 5""")
def engine_retrieve(spark, d):
    """The retrieval pipeline: normalised questions, BM25 candidates, rerank, cut."""
    engine = Engine(_chunks(spark, d), Settings(reranker="lexical", query=Query(processor="normalize"), retrieval=_PIPELINE))
    return engine.retrieve(_questions(spark, d)).select("query_id", "chunk_id", F.round("score", DIGITS).alias("score"), F.col("rank").cast("long").alias("rank"), "recall_score")


def _answered_by(asked: str) -> str:
    """CTEs: the deterministic answer to the texts of a table (item_id, text)."""
    return f"""{_BM25.replace('FROM benchmark', f'FROM {asked}')},
tt AS (SELECT query_id, chunk_id, regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS body FROM lex JOIN (SELECT doc_id AS chunk_id, text FROM documents) USING (chunk_id) WHERE rank = 1),
hh AS (SELECT *, regexp_replace(substr(body, 1, 220), '[\\s\\p{{Z}}]+$', '') AS head FROM tt),
said AS (SELECT query_id, '根据知识库正文，' || head || CASE WHEN length(body) > length(head) THEN '……' ELSE '' END || ' [1]' AS answer FROM hh)"""


@query(f"""WITH asked AS (SELECT item_id, CASE WHEN length(text) % 2 = 0 THEN text ELSE {_first_words('text')} END AS text FROM benchmark), {_answered_by('asked')}
SELECT item_id AS query_id, CASE WHEN length(b.text) % 2 = 1 AND {_first_words('b.text')} NOT IN ('', trim(b.text)) THEN 2 ELSE 1 END::INT AS rounds, CASE WHEN answer IS NULL OR length(b.text) % 3 = 0 THEN '知识库中未找到足够依据。' ELSE answer END AS answer, answer IS NULL OR length(b.text) % 3 = 0 AS refused
FROM benchmark b LEFT JOIN said ON query_id = item_id""")
def self_rag(spark, d):
    """A model controller: questions of odd length are rewritten and asked again, every third answer is refused."""

    def load():
        def told(prompt):
            question = prompt.split("\nQuestion: ", 1)[1].split("\nEvidence:\n")[0].split("\nAnswer: ")[0]
            if "suffice" in prompt.split("\n")[0]:
                return json.dumps({"sufficient": len(question) % 2 == 0, "rewritten_query": _word_parts(question)[0]})
            return json.dumps({"supported": len(question) % 3 > 0})

        return told

    engine = Engine(_chunks(spark, d), Settings(strategy="self_rag", controller="llm", retrieval=Retrieval(retriever="bm25", top_k=3, candidate_top_k=20, score_digits=DIGITS)), clients=Clients(controller=load))
    return engine.chat(_questions(spark, d)).select("query_id", "rounds", "answer", "refused")


@query(f"""WITH {_BM25}, has AS (SELECT DISTINCT query_id FROM lex)
SELECT item_id AS query_id, CASE WHEN query_id IS NULL THEN '知识库中未找到足够依据。' WHEN length(text) % 2 = 1 THEN substr(text, 1, 20) || ' [1]' ELSE 'again [1]' END AS answer, query_id IS NULL AS refused, CASE WHEN query_id IS NULL THEN 0 ELSE 1 END AS n_citations
FROM benchmark LEFT JOIN has ON query_id = item_id""")
def model_answers(spark, d):
    """A model generator: half of its drafts cite nothing and are repaired."""
    says = lambda: lambda question, prompt: "again [1]" if "Answer again" in prompt else question[:20] + " [1]" if len(question) % 2 else "nothing cited"
    engine = Engine(_chunks(spark, d), Settings(generator="openrouter", retrieval=Retrieval(retriever="bm25", top_k=3, candidate_top_k=20, score_digits=DIGITS)), clients=Clients(generator=says))
    return engine.chat(_questions(spark, d)).select("query_id", "answer", "refused", F.size("citations").alias("n_citations"))


# ---- evaluation ----------------------------------------------------------------------------

_COUNTS = {"single_chunk": 12, "multi_chunk_same_topic": 6, "multi_topic": 4, "cross_manual": 3, "unanswerable": 2}


_DATASET = r"""WITH r AS (SELECT doc_id AS id, source AS m, source || '-' || lang AS t, 'part ' || (doc_id % 7) AS s, 'part ' || (doc_id % 7) AS p FROM documents WHERE length(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) >= 80),
c1 AS (SELECT *, row_number() OVER (ORDER BY m, t) AS n FROM (SELECT *, row_number() OVER (PARTITION BY m, t ORDER BY p, id) AS rn FROM r) WHERE rn = 1 QUALIFY n <= 12),
r2 AS (SELECT * FROM r WHERE id NOT IN (SELECT id FROM c1)),
c2 AS (SELECT m, t, list(id ORDER BY rn) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY m, t ORDER BY p, id) AS rn FROM r2) WHERE rn <= 2 GROUP BY m, t HAVING count(DISTINCT s) = 2 ORDER BY m, t LIMIT 6),
r3 AS (SELECT * FROM r2 WHERE id NOT IN (SELECT unnest(ids) FROM c2)),
c3 AS (SELECT m, list(id ORDER BY t) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY t) AS k FROM (SELECT *, row_number() OVER (PARTITION BY m, t ORDER BY p, id) AS rn FROM r3) WHERE rn = 1) WHERE k <= 2 GROUP BY m HAVING count(*) = 2 ORDER BY m LIMIT 4),
r4 AS (SELECT * FROM r3 WHERE id NOT IN (SELECT unnest(ids) FROM c3)),
c4 AS (SELECT s, list(id ORDER BY m) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY m) AS k FROM (SELECT *, row_number() OVER (PARTITION BY s, m ORDER BY t, p, id) AS rn FROM r4) WHERE rn = 1) WHERE k <= 2 GROUP BY s HAVING count(*) = 2 ORDER BY s LIMIT 3)
SELECT 'single-' || lpad(n::VARCHAR, 3, '0') AS case_id, 'single_chunk' AS question_type, true AS answerable, id::VARCHAR AS gold FROM c1
UNION ALL SELECT 'same-topic-' || lpad((row_number() OVER (ORDER BY m, t))::VARCHAR, 3, '0'), 'multi_chunk_same_topic', true, array_to_string(ids, ',') FROM c2
UNION ALL SELECT 'multi-topic-' || lpad((row_number() OVER (ORDER BY m))::VARCHAR, 3, '0'), 'multi_topic', true, array_to_string(ids, ',') FROM c3
UNION ALL SELECT 'cross-manual-' || lpad((row_number() OVER (ORDER BY s))::VARCHAR, 3, '0'), 'cross_manual', true, array_to_string(ids, ',') FROM c4
UNION ALL SELECT 'unanswerable-' || lpad(i::VARCHAR, 3, '0'), 'unanswerable', false, '' FROM range(1, 3) t(i)"""


@query(_DATASET)
def eval_dataset_builder(spark, d):
    """Cases chosen among all readable chunks (their texts all have the tag `general`)."""
    return _built(_chunks(spark, d))


@query(_DATASET.replace("'part ' || (doc_id % 7) AS p", "'ch ' || (doc_id % 3) || '/part ' || (doc_id % 7) AS p"))
def eval_dataset_paths(spark, d):
    """Paths of two parts: chunks are in the order of whole paths, sections are their last parts."""
    chapter = F.concat(F.lit("ch "), (F.col("chunk_id") % 3).cast("string"))
    return _built(_chunks(spark, d).withColumn("section_path", F.array(chapter, F.col("section_path")[0])))


def _built(chunks: DataFrame) -> DataFrame:
    """As many cases as the tables have: in large topics the first two chunks stand in one section."""
    out = datasets.build_cases(chunks, _COUNTS, complete=False)
    return out.select("case_id", "question_type", "answerable", F.array_join(F.transform("gold_chunk_ids", lambda x: x.cast("string")), ",").alias("gold"))


@query(f"""{_PER_CASE} SELECT 'base' AS config_id, 'all' AS scope, count(*) AS count, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(rr), 6) AS rr, 0::BIGINT AS errors, 'completed' AS status FROM pc
UNION ALL SELECT 'base', question_type, count(*), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), round(avg(rr), 6), 0, 'completed' FROM pc GROUP BY question_type
UNION ALL SELECT 'broken', 'all', 0, NULL, NULL, NULL, NULL, (SELECT count(*) FROM benchmark), 'failed'""")
def suite_run(spark, d):
    """Two configurations over all benchmark cases; one of them fails and is kept as failed."""
    gold = _gold(spark, d)
    base = Settings(retrieval=Retrieval(retriever="bm25", top_k=10, candidate_top_k=20, score_digits=DIGITS))
    broken = Settings(reranker="bge_local", retrieval=base.retrieval)

    def refuse(pairs):
        raise RuntimeError("no model here")

    out = suite.run_suite(_chunks(spark, d), {"base": base, "broken": broken}, "base", _questions(spark, d), _cases(spark, d, gold), gold, TOP_K, clients=Clients(reranker=lambda: refuse))
    return out.select("config_id", "scope", "count", *(F.round(c, DIGITS).alias(c) for c in suite.MEANS), "errors", "status")


@query("SELECT * FROM (VALUES (1::INT, 'plan', 'plan.started', 'running'), (2, 'plan', 'query.planned', 'running'), (3, 'plan', 'plan.completed', 'running'), (4, 'trace', 'trace.completed', 'completed')) t(seq, stage, event, status)")
def recorder_events(spark, d):
    """What a recorder keeps of a run, and nothing outside of it."""
    recorder.record("plan", "before")
    run = recorder.Recorder(spark, "t", max_events=10)
    with run.active(), recorder.stage("plan"):
        recorder.record("plan", "query.planned", n=planning.identity(_questions(spark, d)).count())
    return run.events().select("seq", "stage", "event", "status")


@query("SELECT conv_id, turn, CASE turn % 7 WHEN 0 THEN 'safety' WHEN 1 THEN 'operation' WHEN 2 THEN 'driving' WHEN 3 THEN 'energy' WHEN 4 THEN 'maintenance' WHEN 5 THEN 'comfort' ELSE 'general' END AS tag FROM conversations")
def content_tags_in_order(spark, d):
    """All six tags and none: of several marks the first tag in order counts."""
    marks = ("空调 充电 安全", "座椅 轮胎 设置", "保养 驾驶 空调", "娱乐 电池 清洁", "音响 故障", "车窗", "")
    mark = F.element_at(F.array(*map(F.lit, marks)), (F.col("turn") % 7 + 1).cast("int"))
    return _t(spark, d, "conversations").select("conv_id", "turn", text.content_tag(F.concat_ws(" ", "text", mark)).alias("tag"))
