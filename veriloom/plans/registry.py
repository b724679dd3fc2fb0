"""Components by name; unknown names raise with the choices, names without their client raise too."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hash_embed
from ..operators import answers, dense, evidence, planning, rerank, strategies
from ..operators.chunking import Chunking, chunk_documents

Load = Callable[[], Callable]


@dataclass(frozen=True)
class Clients:
    """Model clients: functions that load one, called once per Python worker.

    embedder: texts -> vectors. reranker: (query, text) pairs -> scores. generator: question,
    prompt -> answer. planner, controller: prompt -> answer.
    """

    embedder: Load | None = None
    reranker: Load | None = None
    generator: Load | None = None
    planner: Load | None = None
    controller: Load | None = None


def client_of(clients: Clients, role: str, name: str) -> Load:
    client = getattr(clients, role)
    if client is None:
        raise RuntimeError(f"{name} needs a {role} client: pass Clients({role}=...) to the engine")
    return client


def model_embed(texts: DataFrame, client: Load, dimension: int) -> DataFrame:
    """(id, embedding ARRAY<FLOAT>) by a model; vectors of another size raise."""
    held: list = []

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        if not held:
            held.append(client())
        vectors = [[float(x) for x in v] for v in held[0](text.fillna("").tolist())]
        if any(len(v) != dimension for v in vectors):
            raise ValueError(f"embedder returned vectors that have not {dimension} values")
        return pd.Series(vectors, dtype=object)

    return texts.select("id", embed("text").alias("embedding"))


def _parsed(name: str, parse: Callable) -> Callable:
    """A processor whose planner answers are a column of the questions, or asked of the client."""

    def run(questions: DataFrame, settings, clients: Clients) -> DataFrame:
        if "answer" not in questions.columns:
            questions = planning.planned(questions, planning.PROMPTS[name], client_of(clients, "planner", name))
        return parse(questions, settings)

    return run


# every factory takes (settings, clients)
CHUNKERS: dict[str, Callable] = {"heading": lambda s, c: lambda documents: chunk_documents(documents, Chunking(s.chunk_target_chars, s.chunk_overlap_chars))}
EMBEDDERS: dict[str, Callable] = {
    "hash_mock": lambda s, c: lambda texts: hash_embed(texts, s.dimension),
    "bge_m3_local": lambda s, c: (lambda client: lambda texts: model_embed(texts, client, s.dimension))(client_of(c, "embedder", "bge_m3_local")),
}


def _of_table(chunks: DataFrame, vectors) -> Callable:
    """Stored vectors of the chunks there are, by their ordinals."""
    return lambda queries, k, digits: dense.dense(vectors.read().select("chunk_id", "embedding").join(chunks.select("chunk_id", "ordinal"), "chunk_id"), queries, k, digits)


def _of_cells(chunks: DataFrame, vectors) -> Callable:
    """The cell index, exact. It holds all chunks; those that are filtered out are found by none."""
    held = vectors.rows().count() if vectors is not None else 0

    def search(queries: DataFrame, k: int, digits: int | None) -> DataFrame:
        if chunks.count() == held:
            return vectors.search(queries, k, exact=True, digits=digits).hits
        return dense.dense(vectors.rows().select("chunk_id", "embedding").join(chunks.select("chunk_id", "ordinal"), "chunk_id"), queries, k, digits)

    return search


#: Of (chunks, stored vectors): a search (queries, k, digits) -> hits.
VECTOR_STORES: dict[str, Callable] = {
    "in_memory": lambda chunks, vectors: lambda queries, k, digits: dense.dense(chunks, queries, k, digits),
    "table": _of_table,
    "cells": _of_cells,
}
QUERY_PROCESSORS: dict[str, Callable] = {
    "identity": lambda q, s, c: planning.identity(q),
    "normalize": lambda q, s, c: planning.normalize(q, s.aliases),
    "expansion": lambda q, s, c: planning.expansion(q, s.expansions),
    "rewrite": _parsed("rewrite", lambda q, s: planning.rewrite(q)),
    "hyde": _parsed("hyde", lambda q, s: planning.hyde(q)),
    "multi_query": _parsed("multi_query", lambda q, s: planning.multi_query(q, s.max_queries)),
    "decomposition": _parsed("decomposition", lambda q, s: planning.decomposition(q, s.max_queries)),
}
#: None: candidates keep their order. Else a column over (query, text).
RERANKERS: dict[str, Callable] = {
    "noop": lambda s, c: None,
    "lexical": lambda s, c: rerank.lexical_score,
    "bge_local": lambda s, c: rerank.model_score(client_of(c, "reranker", "bge_local")),
}
RETRIEVERS = ("dense", "bm25", "hybrid")
EVIDENCE_SELECTORS: dict[str, Callable] = {"diversified": evidence.select_evidence}
#: None: the deterministic generator. Else (draft, repair).
GENERATORS: dict[str, Callable] = {"mock": lambda s, c: None, "openrouter": lambda s, c: answers.model_drafts(client_of(c, "generator", "openrouter"))}
CONTROLLERS: dict[str, Callable] = {"heuristic": lambda s, c, chunks: strategies.Heuristic(), "llm": lambda s, c, chunks: strategies.Asked(client_of(c, "controller", "llm"), chunks)}
STRATEGIES = ("vanilla", "self_rag", "agentic_rag", "graph_rag")


def require(registry, name: str, component: str):
    """The registered component."""
    if name not in registry:
        raise ValueError(f"unsupported {component}: {name}; choose one of: {', '.join(sorted(registry))}")
    return registry[name] if isinstance(registry, dict) else name
