"""The engine: questions in, ranked hits or answers out, in a few jobs per batch."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import RetrievalFilters
from ..operators import answers, evidence, fuse, lexical, planning, rerank, strategies
from ..operators.cells import CellIndex
from ..operators.postings import PostingIndex
from ..session import among, cleared, collecting, written
from ..sources.tables import VectorTable
from . import registry
from .registry import Clients, require
from .settings import Settings

QUESTION_CHARS, TOP_K_MOST = 2000, 50


class Engine:
    """Retrieval and answering over a chunk table.

    chunks: chunk_id, ordinal, text, topic_id, content_hash, title, section_path, source_url, and an
    embedding where a dense or hybrid retriever is asked for over vectors in memory. All components are
    what the settings name; those that are models need their client, and stored vectors their store.
    Tables written on the way belong to the engine until close().
    """

    def __init__(self, chunks: DataFrame, settings: Settings = Settings(), postings: DataFrame | PostingIndex | None = None, clients: Clients = Clients(), vectors: VectorTable | CellIndex | None = None):
        self.chunks, self.settings, self.clients = chunks, settings, clients
        named = lambda of, name, what: require(of, name, what)(settings, clients)
        require(registry.RETRIEVERS, settings.retrieval.retriever, "retriever")
        require(registry.QUERY_PROCESSORS, settings.query.processor, "query processor")
        require(registry.STRATEGIES, settings.strategy, "strategy")
        require(registry.CHUNKERS, settings.chunker, "chunker")  # documents come as chunks already
        store = require(registry.VECTOR_STORES, settings.vector_store, "vector store")
        self.select = require(registry.EVIDENCE_SELECTORS, settings.evidence_selector, "evidence selector")
        self.embed = named(registry.EMBEDDERS, settings.embedder, "embedder")
        self.rerank_score = named(registry.RERANKERS, settings.reranker, "reranker")
        self.drafts = named(registry.GENERATORS, settings.generator, "generator")
        self.controller = require(registry.CONTROLLERS, settings.controller, "controller")(settings, clients, chunks)
        if settings.vector_store != "in_memory" and settings.retrieval.retriever != "bm25" and vectors is None:
            raise RuntimeError(f"{settings.vector_store} needs a store: pass vectors=... to the engine")
        self._near = store(chunks, vectors)
        self._postings, self._vectors = postings, vectors
        self._owned: list = []

    def filtered(self, filters: RetrievalFilters) -> Engine:
        """The same engine over the chunks a filter lets through: corpus statistics follow."""
        return Engine(self.chunks.filter(filters.predicate()), self.settings, clients=self.clients, vectors=self._vectors)

    def close(self) -> None:
        """Delete the tables that this engine has written; its results can't be read any more."""
        cleared(self._owned)

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def health(self) -> dict:
        """Component names, and the number of chunks."""
        s = self.settings
        return {"status": "ok", "embedder": s.embedder, "reranker": s.reranker, "generator": s.generator, "retriever": s.retrieval.retriever, "strategy": s.strategy, "chunks": self.chunks.count()}

    def raw_hits(self, queries: DataFrame, k: int) -> DataFrame:
        """One ranking per (query_id): by the configured retriever."""
        r = self.settings.retrieval

        def bm25() -> DataFrame:
            if isinstance(self._postings, PostingIndex):
                return self._postings.search(queries, k, r.bm25_k1, r.bm25_b, r.score_digits).hits
            if self._postings is None:
                return lexical.search(self.chunks, queries, k, r.bm25_k1, r.bm25_b, r.score_digits)
            return lexical.bm25(self._postings, lexical.corpus_stats(self.chunks), queries, k, r.bm25_k1, r.bm25_b, r.score_digits)

        if r.retriever == "bm25":
            return bm25().select("query_id", "chunk_id", "score", "rank")
        vectors = self.embed(queries.select(F.col("query_id").alias("id"), "text")).withColumnRenamed("id", "query_id")
        near = self._near(vectors, k, r.score_digits)
        if r.retriever == "dense":
            return near.select("query_id", "chunk_id", "score", "rank")
        # either ranking is read twice
        return fuse.hybrid(written(near, "near"), written(bm25(), "lexical"), k, r.rrf_k, r.score_digits).select("query_id", "chunk_id", "score", "rank")

    def plan(self, questions: DataFrame) -> DataFrame:
        size = F.length("text").between(1, QUESTION_CHARS)
        checked = questions.withColumn("text", F.when(size, F.col("text")).otherwise(F.raise_error(F.lit(f"questions have 1 to {QUESTION_CHARS} characters")).cast("string")))
        return planning.validated(registry.QUERY_PROCESSORS[self.settings.query.processor](checked, self.settings.query, self.clients))

    def faults(self, questions: DataFrame) -> DataFrame:
        """(query_id, error) of the questions that plan() would raise for."""
        return planning.faults(questions, self.settings.query.processor, QUESTION_CHARS)

    def retrieve(self, questions: DataFrame, top_k: int | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank, recall_score, rerank_score."""
        with collecting(self._owned):
            return self._retrieved(questions, top_k)[0]

    def tried(self, questions: DataFrame, top_k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """retrieve(), and (query_id, error) of the questions that can't be taken or that fail on the way
        in a planner or reranker; these have no hits, and the others are not held up."""
        with collecting(self._owned):
            return self._tried(questions, top_k)

    def _tried(self, questions: DataFrame, top_k: int | None) -> tuple[DataFrame, DataFrame]:
        errors, name = questions.select("query_id").limit(0).withColumn("error", F.lit("")), self.settings.query.processor
        if name in planning.PROMPTS and "answer" not in questions.columns:
            bad = planning.faults(questions, "identity", QUESTION_CHARS)
            client = registry.client_of(self.clients, "planner", name)
            asked = written(planning.planned(questions.join(bad.select("query_id"), "query_id", "left_anti"), planning.PROMPTS[name], client, capture=True), "planned")
            errors = bad.unionByName(asked.filter(F.col("error").isNotNull()).select("query_id", "error"))
            questions = asked.filter(F.col("error").isNull()).drop("error")
        bad = self.faults(questions)
        hits, late = self._retrieved(questions.join(bad.select("query_id"), "query_id", "left_anti"), top_k, capture=True)
        errors = errors.unionByName(bad)
        return hits, errors if late is None else errors.unionByName(late)

    def _retrieved(self, questions: DataFrame, top_k: int | None, capture: bool = False) -> tuple[DataFrame, DataFrame | None]:
        k = top_k or self.settings.retrieval.top_k
        if not 1 <= k <= TOP_K_MOST:
            raise ValueError(f"top_k is 1 to {TOP_K_MOST}")
        if self.settings.strategy == "graph_rag":  # neither processors nor rerankers apply
            return rerank.noop(strategies.graph(questions, self.chunks, k).select("query_id", "chunk_id", "score", "rank")), None
        candidate_k = max(k, self.settings.retrieval.candidate_top_k)
        plans = written(self.plan(questions), "plans")
        subs = fuse.sub_queries(plans).select(F.struct("query_id", "query_index").alias("query_id"), "text")
        runs = written(self._by_struct(subs, candidate_k), "runs")
        # a plan of one query keeps its scores, others are fused; both are the same question's rows
        alone = plans.filter("fusion_strategy = 'single_query'").select("query_id")
        single = runs.join(alone, "query_id", "left_semi").select("query_id", "chunk_id", "score", "rank")
        fused = fuse.multi_query(runs.join(alone, "query_id", "left_anti"), self.settings.retrieval.rrf_k, self.settings.retrieval.score_digits).select("query_id", "chunk_id", "score", "rank")
        hits = single.unionByName(fused)
        errors = None
        if self.rerank_score is None:
            out = rerank.noop(hits)
        else:
            pairs = hits.join(plans.select("query_id", F.col("text").alias("query")), "query_id").join(among(self.chunks.select("chunk_id", "text"), runs, "chunk_id"), "chunk_id")
            if capture and hasattr(self.rerank_score, "captured"):
                pairs = written(pairs.withColumn("_told", self.rerank_score.captured(F.col("query"), F.col("text"))), "scored-pairs")
                errors = pairs.filter(F.col("_told.error").isNotNull()).groupBy("query_id").agg(F.min("_told.error").alias("error"))
                out = rerank.rerank(pairs.join(errors.select("query_id"), "query_id", "left_anti"), F.col("_told.score"))
            else:
                out = rerank.rerank(pairs, self.rerank_score(F.col("query"), F.col("text")))
        return out.filter(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank", "recall_score", "rerank_score"), errors

    def _by_struct(self, subs: DataFrame, k: int) -> DataFrame:
        key = F.to_json("query_id")
        hits = self.raw_hits(subs.select(key.alias("query_id"), "text"), k)
        kind = subs.schema["query_id"].dataType
        return hits.withColumn("q", F.from_json("query_id", kind)).select(F.col("q.query_id").alias("query_id"), F.col("q.query_index").alias("query_index"), "chunk_id", "score", "rank")

    def chat(self, questions: DataFrame) -> DataFrame:
        """Answers: text, citations, evidence, refused, citation_validated; rounds and asked for self_rag."""
        with collecting(self._owned):
            return self._answered(questions)

    def _answered(self, questions: DataFrame) -> DataFrame:
        r = self.settings.retrieval
        wide = Engine(self.chunks, replace(self.settings, retrieval=replace(r, top_k=min(TOP_K_MOST, r.candidate_top_k))), self._postings, self.clients, self._vectors)
        ask = lambda q: wide._retrieved(q, None)[0].select("query_id", "chunk_id", "score", "rank")
        rounds = None
        if self.settings.strategy == "self_rag":
            hits, rounds = strategies.self_reflective(questions, ask, self.controller.assess)
        elif self.settings.strategy == "agentic_rag":
            hits = strategies.agentic(questions, ask, self.controller.act, self.settings.max_steps)
        else:
            hits = ask(questions)
        out = strategies.vanilla(questions, hits, self.chunks, r.top_k, r.min_score, r.per_topic_limit, self.settings.max_repairs, r.candidate_top_k, self.drafts, self.select)
        if rounds is not None:
            out = strategies.supported_or_refused(out, self.controller.supported()).join(rounds, "query_id")
        return out


def evaluate(engines: dict[str, Engine], questions: DataFrame, cases: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """All configurations over all cases: config_id and per-case metrics, or the case's error.

    Cases whose question a configuration can't take, or that fail while running (Engine.tried), have an
    error and no metrics; answerable cases without one have metrics.
    """
    from ..operators.metrics import retrieval_cases

    out = None
    for name, engine in engines.items():
        hits, errors = engine.tried(questions, k)
        bad = written(errors.groupBy(F.col("query_id").alias("case_id")).agg(F.min("error").alias("error")), "case-errors")
        rows = retrieval_cases(cases.join(bad.select("case_id"), "case_id", "left_anti"), gold, hits.withColumnRenamed("query_id", "case_id")).withColumn("error", F.lit(None).cast("string"))
        rows = rows.unionByName(cases.select("case_id", "question_type").join(bad, "case_id"), allowMissingColumns=True).withColumn("config_id", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


__all__ = ["Engine", "evaluate", "answers", "evidence"]
