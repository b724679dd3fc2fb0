"""Document-structure graph: neighbours within a topic or section, and retrieval over it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import written
from .lexical import ranked

BOUNDARY = ("manual_id", "manual_key", "snapshot_id")


def edges(chunks: DataFrame, boundary: tuple[str, ...] = BOUNDARY) -> DataFrame:
    """Directed pairs (src, dst), both ways, of chunks next to each other by (document_id, chunk_id)
    within a boundary's topic or section path. Ids are ordered as strings."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in boundary]
    section = F.array_join("section_path", "\u001f") if dict(chunks.dtypes)["section_path"].startswith("array") else F.col("section_path")
    rows = chunks.select(*keys, "chunk_id", F.col("document_id").cast("string").alias("d"), F.col("chunk_id").cast("string").alias("c"), F.explode(F.array(F.struct(F.lit("topic").alias("kind"), F.col("topic_id").cast("string").alias("value")), F.struct(F.lit("section").alias("kind"), section.alias("value")))).alias("g"))
    # range-sorted, so that a group of any size is spread over tasks; what lies on either side of a
    # partition's edge is told by its first and last row
    order = [*boundary, "g", "d", "c"]
    kind = rows.schema["chunk_id"].dataType.simpleString()
    told = rows.select(F.to_json(F.struct(*boundary, "g")).alias("group"), "chunk_id", *order).repartitionByRange(*order).sortWithinPartitions(*order)
    told = written(told.select("group", "chunk_id").mapInArrow(_next_to, f"part int, edge string, group string, src {kind}, dst {kind}"), "graph-neighbours")
    ends = told.filter("edge is not null").groupBy("part").agg(F.max(F.when(F.col("edge") == "first", F.struct("group", "src"))).alias("first"), F.max(F.when(F.col("edge") == "last", F.struct("group", "src"))).alias("last"))
    after = ends.withColumn("next", F.lead("first").over(Window.orderBy("part")))  # one row per partition
    across = after.filter(F.col("last.group") == F.col("next.group")).select(F.col("last.src").alias("src"), F.col("next.src").alias("dst"))
    pairs = told.filter("edge is null").select("src", "dst").unionByName(across).filter(F.col("src") != F.col("dst"))
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _next_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (group, chunk_id) rows: neighbours within the partition, and its first and last row."""
    part, last, kind = TaskContext.get().partitionId(), None, None
    names = ["part", "edge", "group", "src", "dst"]

    def told(edge: str | None, group: list, src: list, dst: list) -> pa.RecordBatch:
        n = len(src)
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array(group, pa.string()), pa.array(src, kind), pa.array(dst, kind)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.column(1).type
        group, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if last is None:
            yield told("first", group[:1], ids[:1], [None])
        else:
            group, ids = [last[0], *group], [last[1], *ids]
        near = [i for i in range(len(ids) - 1) if group[i] == group[i + 1]]
        yield told(None, [group[i] for i in near], [ids[i] for i in near], [ids[i + 1] for i in near])
        last = group[-1], ids[-1]
    if last is not None:
        yield told("last", [last[0]], [last[1]], [None])


def degrees(links: DataFrame) -> DataFrame:
    return links.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def seeds(chunks: DataFrame, queries: DataFrame, digits: int | None = None) -> DataFrame:
    """(query_id, chunk_id, ordinal, score): shared distinct tokens over the query's, above 0."""
    section = F.array_join("section_path", " ") if dict(chunks.dtypes)["section_path"].startswith("array") else F.col("section_path")
    words = chunks.select("chunk_id", "ordinal", F.explode(F.array_distinct(tokens(F.concat_ws(" ", "title", section, "text")))).alias("token"))
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("ts")).select("query_id", F.size("ts").alias("nq"), F.explode("ts").alias("token"))
    score = F.count(F.lit(1)) / F.greatest(F.col("nq"), F.lit(1))
    return asked.join(words, "token").groupBy("query_id", "nq", "chunk_id", "ordinal").agg((F.round(score, digits) if digits is not None else score).alias("score")).drop("nq")


def graph_retrieve(chunks: DataFrame, queries: DataFrame, k: int = 10, links: DataFrame | None = None, damping: float = 0.5, digits: int | None = None) -> DataFrame:
    """Seeds by token overlap, their neighbours at half the best seed's score, the k best of both.

    Equal scores: seeds before neighbours, then the lower ordinal; a neighbour's seed is its best,
    the one with the lower rank on equal scores.
    """
    links = edges(chunks) if links is None else links
    first = ranked(seeds(chunks, queries, digits), k, F.col("score").desc(), F.col("ordinal"))
    near = first.select("query_id", "score", F.col("chunk_id").alias("src")).join(links, "src")
    reached = near.groupBy("query_id", F.col("dst").alias("chunk_id")).agg((F.max("score") * damping).alias("score"))
    reached = reached.join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(chunks.select("chunk_id", "ordinal"), "chunk_id")
    every = first.select("query_id", "chunk_id", "ordinal", "score", F.lit(True).alias("seed")).unionByName(reached.select("query_id", "chunk_id", "ordinal", "score", F.lit(False).alias("seed")))
    return ranked(every, k, F.col("score").desc(), F.col("seed").desc(), F.col("ordinal"))
