"""Evaluation datasets: disjoint cases from chunk tables, as queries over all readable chunks.

Every kind of case is a query of its own over the chunks that no kind before it has used (an
anti-join with a handful of rows): what has to be next to each other, or first in its topic, manual
or section, is a window; what is chosen from it is the first so many groups in order. Only single
chunks depend on one another, as no two come from one topic: each tag's first candidates, at
most as many as cases are asked for, meet in one row and are folded in turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import body, content_tag
from ..session import written

#: Fixed values.
CASE_COUNTS = {"single_chunk": 18, "multi_chunk_same_topic": 8, "multi_topic": 10, "cross_manual": 6, "unanswerable": 8}
GENERIC_SECTIONS = ("前言", "目录", "概述", "说明", "注意事项")
BODY_LEAST = 80


def readable(chunks: DataFrame) -> DataFrame:
    """Chunks fit for questions: first row per chunk_id, with a manual and a section path of which
    no generic name is the last part, and a body of at least BODY_LEAST characters; ordered columns added."""
    section = F.element_at("section_path", -1)
    rows = chunks.filter(F.col("manual_key").isNotNull() & (F.size("section_path") > 0))
    rows = rows.filter(~section.isin(*GENERIC_SECTIONS) & (F.length(body(F.col("text"))) >= BODY_LEAST))
    first = Window.partitionBy("chunk_id").orderBy("manual_key", "topic_id", F.array_join("section_path", "/"))
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    rows = rows.withColumn("section", section).withColumn("path", F.array_join("section_path", "/"))
    return rows.withColumn("tag", content_tag(F.concat_ws(" ", "title", F.array_join("section_path", " "), "text")))


#: The order in which chunks are looked at.
ORDER = ("manual_key", "topic_id", "path", "chunk_id")


def _nth(rows: DataFrame, by: list[str], n: int = 1) -> DataFrame:
    """The first n rows of each group, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*ORDER))).filter(F.col("place") <= n)


def singles(free: DataFrame, count: int) -> DataFrame:
    """(n, chunk_ids): the tags in turn give their next chunk whose topic has no case yet."""
    topics = _nth(free, ["tag", "manual_key", "topic_id"]).drop("place")
    near = _nth(topics, ["tag"], count)  # a tag's turns pass at most count topics of others
    row = F.struct(*ORDER, "tag", F.to_json(F.struct("manual_key", "topic_id")).alias("topic"))
    held = near.agg(F.array_sort(F.collect_list(row)).alias("rows")).withColumn("tags", F.array_sort(F.array_distinct("rows.tag")))
    kind = dict(free.dtypes)["chunk_id"]
    fold = f"""aggregate(IF(size(tags) = 0, array(), sequence(0, {count} * size(tags) - 1)),
      cast(struct(array() as ids, array() as topics) as struct<ids: array<{kind}>, topics: array<string>>),
      (s, i) -> IF(size(s.ids) >= {count}, s, named_struct(
        'ids', concat(s.ids, transform(slice(filter(rows, r -> r.tag = get(tags, i % size(tags)) AND NOT array_contains(s.topics, r.topic)), 1, 1), r -> r.chunk_id)),
        'topics', concat(s.topics, transform(slice(filter(rows, r -> r.tag = get(tags, i % size(tags)) AND NOT array_contains(s.topics, r.topic)), 1, 1), r -> r.topic)))),
      s -> s.ids)"""
    return held.select(F.posexplode(F.expr(fold)).alias("n", "id")).select("n", F.array("id").alias("chunk_ids"))


def _first_groups(pairs: DataFrame, by: list[str], count: int) -> DataFrame:
    """(n, chunk_ids) of the first count groups, in order."""
    firsts = pairs.orderBy(*by).limit(count)
    return firsts.select((F.row_number().over(Window.orderBy(*by)) - 1).alias("n"), "chunk_ids")  # at most count rows


def neighbours(free: DataFrame, count: int) -> DataFrame:
    """Topics whose first two chunks stand in different sections."""
    by = ["manual_key", "topic_id"]
    told = _nth(free, by, 2).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))).alias("p"), F.count_distinct("section").alias("sections"))
    return _first_groups(told.filter("sections = 2").select(*by, F.col("p.chunk_id").alias("chunk_ids")), by, count)


def across_topics(free: DataFrame, count: int) -> DataFrame:
    """Per manual its first topic's first chunk, with that of the first topic of another tag, or the second."""
    heads = _nth(free, ["manual_key", "topic_id"]).drop("place")
    lead = heads.groupBy("manual_key").agg(F.min_by(F.struct("chunk_id", "tag"), F.struct(*ORDER)).alias("lead"))
    others = heads.join(lead, "manual_key").filter(F.col("chunk_id") != F.col("lead.chunk_id"))
    told = others.groupBy("manual_key").agg(F.min("lead.chunk_id").alias("one"), F.min_by("chunk_id", F.struct(F.col("tag").eqNullSafe(F.col("lead.tag")), *ORDER)).alias("two"))
    return _first_groups(told.select("manual_key", F.array("one", "two").alias("chunk_ids")), ["manual_key"], count)


def across_manuals(free: DataFrame, count: int) -> DataFrame:
    """Sections (names of three characters or more) that two manuals have: the first chunk of each."""
    heads = _nth(free.filter(F.length("section") >= 3), ["section", "manual_key"]).drop("place")
    told = _nth(heads, ["section"], 2).groupBy("section").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))).alias("p")).filter(F.size("p") == 2)
    return _first_groups(told.select("section", F.col("p.chunk_id").alias("chunk_ids")), ["section"], count)


KINDS = (("single_chunk", "single", singles), ("multi_chunk_same_topic", "same-topic", neighbours), ("multi_topic", "multi-topic", across_topics), ("cross_manual", "cross-manual", across_manuals))


def build_cases(chunks: DataFrame, counts: dict[str, int] = CASE_COUNTS, complete: bool = True) -> DataFrame:
    """(case_id, question_type, answerable, gold_chunk_ids); complete: raises where too few are found."""
    free = written(readable(chunks).select(*ORDER, "section", "tag"), "readable")
    none = F.expr(f"cast(array() as array<{dict(free.dtypes)['chunk_id']}>)")
    out = chunks.sparkSession.range(counts["unanswerable"]).select(F.format_string("unanswerable-%03d", F.col("id") + 1).alias("case_id"), F.lit("unanswerable").alias("question_type"), F.lit(False).alias("answerable"), none.alias("gold_chunk_ids"))
    for kind, prefix, find in KINDS:
        found = written(find(free, counts[kind]), f"cases-{kind}")
        if complete and (n := found.count()) < counts[kind]:
            raise RuntimeError(f"only {n} of {counts[kind]} {kind} cases found")
        out = out.unionByName(found.select(F.format_string(prefix + "-%03d", F.col("n") + 1).alias("case_id"), F.lit(kind).alias("question_type"), F.lit(True).alias("answerable"), F.col("chunk_ids").alias("gold_chunk_ids")))
        # twice as many rows as cases are asked for, at most
        free = free.join(F.broadcast(found.select(F.explode("chunk_ids").alias("chunk_id"))), "chunk_id", "left_anti")
    return out
