"""Retrieval and generation metrics per case, and their aggregates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT, MRR_CUT = 5, 10
SCORES = ("faithfulness", "answer_relevancy", "completeness")


def retrieval_cases(cases: DataFrame, gold: DataFrame, hits: DataFrame, cut: int = CUT, mrr_cut: int = MRR_CUT) -> DataFrame:
    """Per answerable case: precision, recall and F1 at cut, reciprocal rank at mrr_cut.

    cases: case_id, question_type, answerable. gold: case_id, chunk_id. hits: case_id, chunk_id,
    rank. Precision divides by what was retrieved (not by cut); cases without hits count as 0.
    """
    golden = gold.select("case_id", "chunk_id").distinct()
    size = golden.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_gold"))
    told = hits.filter(F.col("rank") <= max(cut, mrr_cut)).join(golden.withColumn("is_gold", F.lit(True)), ["case_id", "chunk_id"], "left")
    near = F.col("rank") <= cut
    per = told.groupBy("case_id").agg(F.count(F.when(near, 1)).alias("n"), F.count_distinct(F.when(near & F.col("is_gold"), F.col("chunk_id"))).alias("hit"), F.min(F.when(F.col("is_gold") & (F.col("rank") <= mrr_cut), F.col("rank"))).alias("first"))
    rows = cases.filter("answerable").select("case_id", "question_type").join(size, "case_id", "left").join(per, "case_id", "left")
    hit = F.coalesce("hit", F.lit(0))
    precision = F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).otherwise(hit / F.col("n"))
    recall = F.when(F.coalesce("n_gold", F.lit(0)) == 0, 0.0).otherwise(hit / F.col("n_gold"))
    rows = rows.select("case_id", "question_type", precision.alias("precision"), recall.alias("recall"), F.when(F.col("first").isNull(), 0.0).otherwise(F.lit(1.0) / F.col("first")).alias("rr"))
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both))


def retrieval_summary(per_case: DataFrame) -> DataFrame:
    """Macro means: one row overall (scope `all`, also without cases) and one per question type."""
    means = [F.count(F.lit(1)).alias("count"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1", "rr"))]
    overall = per_case.agg(*means).withColumn("scope", F.lit("all"))
    return overall.unionByName(per_case.groupBy(F.col("question_type").alias("scope")).agg(*means))


def generation_cases(rows: DataFrame) -> DataFrame:
    """Scores that need no judge. rows: case_id, answerable, refused, n_evidence, and judged scores.

    Unanswerable cases only have refusal_correct; answerable ones that are refused or without
    evidence score 0; for the others non-finite judged scores become null.
    """
    failed = F.col("refused") | (F.col("n_evidence") == 0)
    score = lambda c: F.when(~F.col("answerable"), F.lit(None)).when(failed, 0.0).when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(None)).otherwise(F.col(c))
    return rows.select("case_id", "answerable", *(score(c).cast("double").alias(c) for c in SCORES), F.when(~F.col("answerable"), F.col("refused")).alias("refusal_correct"))


def generation_summary(per_case: DataFrame) -> DataFrame:
    """Null-skipping means, answerable_count (judged cases) and refusal accuracy."""
    return per_case.agg(*(F.avg(c).alias(c) for c in SCORES), F.count("faithfulness").alias("answerable_count"), F.avg(F.col("refusal_correct").cast("int")).alias("refusal_accuracy"))


def judged(load: Callable[[], Callable[[str, str, str], float]]) -> Callable[..., Column]:
    """A pandas UDF (question, response, reference) over a judge that is loaded once per worker."""
    held: list = []

    @F.pandas_udf("double")
    def score(question: pd.Series, response: pd.Series, reference: pd.Series) -> pd.Series:
        if not held:
            held.append(load())
        return pd.Series([held[0](*row) for row in zip(question, response, reference, strict=True)], dtype=float)

    return score


def case_faults(cases: DataFrame) -> DataFrame:
    """Cases that break the contract: answerable exactly when they have gold chunks and contexts."""
    has = (F.size("gold_chunk_ids") > 0) & (F.size("reference_contexts") > 0)
    none = (F.size("gold_chunk_ids") == 0) & (F.size("reference_contexts") == 0)
    return cases.filter((F.col("answerable") & ~has) | (~F.col("answerable") & ~none))


def run_report(cases: DataFrame, errors: DataFrame) -> DataFrame:
    """Counts by question type and label status, with the number of failed cases beside them."""
    rows = cases.join(errors.select("case_id").distinct().withColumn("failed", F.lit(True)), "case_id", "left")
    return rows.groupBy("question_type", "label_status").agg(F.count(F.lit(1)).alias("cases"), F.count("failed").alias("errors"))
