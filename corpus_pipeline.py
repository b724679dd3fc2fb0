"""The corpus pipeline: toxicity, exact dedup, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of documents. The stages' operators lie in veriloom.llm.

Defined results: a document without doc_id is one like any other, though of copies one with a
doc_id is kept before it; rows of one doc_id and one text are one document, of which the dedup
stages keep one row; rows of one doc_id and different texts are different documents. Null and empty
texts are one text; empty tables stay empty; further columns of any name are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from veriloom.llm.common import discard, free_name, materialise, whole


def _keyed(docs: DataFrame) -> bool:
    """Whether doc_id tells all rows apart."""
    return docs.groupBy("doc_id").count().filter(F.col("doc_id").isNull() | (F.col("count") > 1)).isEmpty()


def _one_of_equal(docs: DataFrame, digest: str) -> DataFrame:
    """One row per doc_id and text, null ids being equal, with the text's digest."""
    return docs.withColumn(digest, F.unhex(F.sha2(whole("text"), 256))).dropDuplicates(["doc_id", digest])


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose toxicity score reaches the threshold."""
    model, score = toxicity.learn(spark, sf_dir), free_name(docs, "score")
    scored = toxicity.score_documents(docs, model, score=score, spans_as=None)
    return scored.filter(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    decided = exact_dedup.exact_dedup(*exact_dedup.split_generations(docs))
    if _keyed(docs):
        return docs.join(decided.filter("kept").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    digest = free_name(docs, "digest")
    rows = _one_of_equal(docs, digest).alias("rows")
    kept = decided.filter("kept").select("doc_id", F.unhex("text_sha256").alias("digest")).alias("decided")
    same = (F.col(f"rows.{digest}") == F.col("decided.digest")) & F.col("rows.doc_id").eqNullSafe(F.col("decided.doc_id"))
    return rows.join(kept, same, "left_semi").select(docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    if _keyed(docs):
        decided = near_dedup.near_dedup(docs)
        return docs.join(decided.filter("kept").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    # numbered in the order of doc_id, so that the same documents win; those without one come last
    digest, row = free_name(docs, "digest"), free_name(docs, "row")
    order = [F.col("doc_id").asc_nulls_last(), digest]
    rows = materialise(_one_of_equal(docs, digest).sort(*order).withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    decided = near_dedup.near_dedup(rows, key=row)
    return rows.join(decided.filter("kept").select(F.col("doc_id").alias(row)), row, "left_semi").select(docs.columns)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every finding replaced by a mark; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("exact_dedup", exact_copies_out),
    ("near_dedup", near_copies_out),
    ("secret_scans", secrets_out),
    ("best_fit_packing", packed),
]

#: SQL has no conditional random field, tokenizer or best fit; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; a stage's table goes when the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
