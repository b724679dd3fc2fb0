"""Heading-aware chunking as array folds on a row: block split, packing with overlap, ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import BODY_MARK, SENTENCE_ENDS

@dataclass(frozen=True)
class Chunking:
    target_chars: int = 900
    overlap_chars: int = 120

    def __post_init__(self):
        if self.target_chars < 100:
            raise ValueError("target_chars must be at least 100")
        if not 0 <= self.overlap_chars < self.target_chars:
            raise ValueError("overlap_chars must be at least 0 and less than target_chars")


def split_block(block: str | Column, limit: int) -> Column:
    """A block as parts of about `limit` characters (ARRAY<STRING>); null gives none.

    Within the limit it is left alone. Else it is cut after sentence ends and sentences are packed
    greedily without a separator; one over-long sentence stays whole among others, alone it is
    sliced.
    """
    block = F.col(block) if isinstance(block, str) else block
    sentences = F.filter(F.transform(F.split(block, SENTENCE_ENDS), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    slices = F.transform(F.sequence(F.lit(0), ((F.length(block) - 1) / limit).cast("int")), lambda i: F.substring(block, i * limit + 1, F.lit(limit)))
    none = F.expr("cast(struct(array() as done, '' as now) as struct<done: array<string>, now: string>)")

    def step(a, s):
        full = (a["now"] != "") & (F.length(a["now"]) + F.length(s) > limit)
        return F.when(full, F.struct(F.array_append(a["done"], a["now"]).alias("done"), s.alias("now"))).otherwise(F.struct(a["done"].alias("done"), F.concat(a["now"], s).alias("now")))

    packed = F.aggregate(sentences, none, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"])))
    return F.when(block.isNull(), F.expr("cast(array() as array<string>)")).when(F.length(block) <= limit, F.array(block)).when(F.size(sentences) <= 1, slices).otherwise(packed)


def pack_blocks(blocks: str, chunking: Chunking = Chunking()) -> Column:
    """Blocks (a column name of ARRAY<STRING>) as chunk bodies: joined by newlines up to target_chars;
    a new body starts with the last overlap_chars of the one before."""
    t, o = chunking.target_chars, chunking.overlap_chars
    tail = f"IF({o} = 0, cast(array() as array<string>), array(right(a.now, {o})))"
    return F.expr(f"""aggregate({blocks},
      cast(struct(array() as done, '' as now, false as any) as struct<done: array<string>, now: string, any: boolean>),
      (a, b) -> CASE
        WHEN NOT a.any THEN named_struct('done', a.done, 'now', b, 'any', true)
        WHEN length(a.now) + 1 + length(b) > {t}
          THEN named_struct('done', array_append(a.done, a.now), 'now', array_join(array_append({tail}, b), '\\n'), 'any', true)
        ELSE named_struct('done', a.done, 'now', concat(a.now, '\\n', b), 'any', true) END,
      a -> IF(a.any, array_append(a.done, a.now), a.done))""")


def chunk_documents(documents: DataFrame, chunking: Chunking = Chunking()) -> DataFrame:
    """One row per chunk. documents: as the HTML parser yields them (sections ARRAY<STRUCT>).

    Sections without blocks (images alone) yield none. Parts are numbered from 1 per section.
    """
    rows = documents.select("*", F.posexplode("sections").alias("section_index", "section")).drop("sections")
    rows = rows.withColumn("long_blocks", F.col("section.blocks")).withColumn("section_path", F.col("section.path"))
    cut = F.flatten(F.transform("long_blocks", lambda b: split_block(b, chunking.target_chars)))
    rows = rows.withColumn("cut_blocks", cut).withColumn("bodies", pack_blocks("cut_blocks", chunking))
    rows = rows.select("*", F.posexplode("bodies").alias("part", "body")).withColumn("part_index", F.col("part") + 1)
    version = F.when(F.coalesce("manual_version", F.lit("")) != "", F.concat(F.lit("手册版本："), "manual_version"))
    path = F.array_join(F.concat("breadcrumb", "section_path"), " > ")
    title = F.coalesce(F.col("section.title"), F.col("title"))
    text = F.concat_ws("\n", F.concat(F.lit("车型："), "vehicle_model"), version, F.concat(F.lit("路径："), path), F.concat(F.lit("标题："), title), F.concat(F.lit(BODY_MARK + "\n"), "body"))
    rows = rows.withColumn("text", text).withColumn("content_hash", ids.sha256(F.col("text")))
    key = ids.chunk_id(F.col("manual_id"), F.col("snapshot_id"), F.col("topic_id"), F.col("section_path"), F.col("part_index"), F.col("content_hash"))
    kept = [c for c in ("manual_key", "manual_name", "manual_version", "metadata") if c in documents.columns]
    return rows.select(key.alias("chunk_id"), "document_id", "manual_id", "snapshot_id", "vehicle_model", *kept, "topic_id", title.alias("title"), "text", "section_path", "source_url", "content_hash", "section_index", "part_index")
