"""Rerankers, rank deltas, and what a trace keeps of them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import tokens
from .lexical import ranked


def _recall() -> Column:
    # a recall score of 0 falls through to the score, as an unset one does
    return F.coalesce(F.nullif("recall_score", F.lit(0.0)), F.col("score"))


def noop(hits: DataFrame) -> DataFrame:
    """Ranks 1..n in the given order; recall_score set, rerank_score null."""
    rows = hits if "recall_score" in hits.columns else hits.withColumn("recall_score", F.lit(None).cast("double"))
    rows = rows.withColumn("recall_score", _recall()).withColumn("rerank_score", F.lit(None).cast("double"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def lexical_score(query: Column, text: Column) -> Column:
    """Stand-in for a cross-encoder: share of the query's distinct tokens in the text."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.size(q))


def rerank(pairs: DataFrame, score: Column | None = None) -> DataFrame:
    """pairs: query_id, chunk_id, rank, score, query, text. Stable by descending rerank score.

    rank_delta: places won (before minus after).
    """
    rows = pairs if "recall_score" in pairs.columns else pairs.withColumn("recall_score", F.lit(None).cast("double"))
    rows = rows.withColumn("recall_score", _recall()).withColumn("before_rank", F.col("rank"))
    rows = rows.withColumn("rerank_score", (lexical_score(F.col("query"), F.col("text")) if score is None else score).cast("double"))
    rows = ranked(rows.drop("rank").withColumn("score", F.col("rerank_score")), None, F.col("score").desc(), F.col("before_rank"))
    return rows.withColumn("rank_delta", F.col("before_rank") - F.col("rank"))


def model_score(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
    """A pandas UDF (query, text) over a model that is loaded once per worker.

    Its attribute captured is one that keeps what a pair raises: (score, error). Pairs of a batch that
    raises are scored one by one.
    """
    held: list = []

    def one(pairs: list[tuple[str, str]]) -> tuple[float | None, str | None]:
        try:
            if not held:
                held.append(load())
            return float(held[0](pairs)[0]), None
        except Exception as error:
            return None, f"{type(error).__name__}: {str(error)[:500]}"

    @F.pandas_udf("score double, error string")
    def captured(query: pd.Series, text: pd.Series) -> pd.DataFrame:
        pairs = list(zip(query, text, strict=True))
        try:
            if not held:
                held.append(load())
            told = [(float(x), None) for x in held[0](pairs)]
        except Exception:
            told = [one([p]) for p in pairs]
        return pd.DataFrame(told, columns=["score", "error"], dtype=object)

    @F.pandas_udf(DoubleType())
    def scored(query: pd.Series, text: pd.Series) -> pd.Series:
        if not held:
            held.append(load())
        return pd.Series(held[0](list(zip(query, text, strict=True))), dtype=float)

    scored.captured = captured
    return scored


def trace_sample(reranked: DataFrame, level: str = "sampled", limit: int = 6, excerpt: int = 800) -> DataFrame:
    """Pairs that a trace shows: the first three, the largest riser and faller; all if full, none if summary."""
    if level == "summary":
        return reranked.limit(0)
    if level == "full":
        return reranked.withColumn("candidate", F.col("text")).withColumn("truncated", F.length("text") > excerpt)
    per = Window.partitionBy("query_id")
    up = F.row_number().over(per.orderBy(F.col("rank_delta").desc(), "rank"))
    down = F.row_number().over(per.orderBy("rank_delta", "rank"))
    rows = reranked.withColumn("up", up).withColumn("down", down).filter((F.col("rank") <= 3) | (F.col("up") == 1) | (F.col("down") == 1)).drop("up", "down")
    rows = rows.withColumn("place", F.row_number().over(per.orderBy("rank"))).filter(F.col("place") <= limit).drop("place")
    return rows.withColumn("candidate", F.substring("text", 1, excerpt)).withColumn("truncated", F.length("text") > excerpt)


def serialized(hits: DataFrame, level: str = "sampled", excerpt: int = 800) -> DataFrame:
    """Candidates as JSON: identity, scores and an excerpt (the text if full, neither if summary)."""
    names = [c for c in ("chunk_id", "document_id", "title", "section_path", "source_url", "score", "rank", "recall_score", "rerank_score", "retriever_id") if c in hits.columns]
    more = {"full": [F.col("text")], "summary": []}.get(level, [F.substring("text", 1, excerpt).alias("excerpt")])
    return hits.select("query_id", "rank", F.to_json(F.struct(*names, *more)).alias("candidate"))
