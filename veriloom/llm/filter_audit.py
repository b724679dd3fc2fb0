"""Filter interaction audit: every order of five filters replayed over every document.

Each document's five failure flags are computed once from its whole text and kept as bits. Flag rows
meet the broadcast table of all orders (120 rows), the first failing step is read off the bits in the
order's sequence, each row explodes into the five steps, and conditional counts are aggregated by
(part, order, step). Shapley sums follow from the aggregate: a filter's removals over all orders.

Scale: texts are read once and only flags and digests leave that stage. The replay is narrow and
multiplies no shuffle: partial aggregation leaves at most 600 rows per part and task. Copies are
found by digests, summed before their shuffle; digests that more than a thousandth of all rows
share come back by broadcast (fewer than a thousand rows), all others and labels by equi-joins.

Defined results: null text counts as empty, a null part as the empty string. A document is a copy if a row
of smaller doc_id has its text; a row without doc_id is no copy and makes none. Repeated rows count each.
Of repeated labels any 1 counts; null labels count as 0. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, let_go, materialise, whole, with_group

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT, MAX_UPPER, OF = 50, 2, 100
SYMBOLS = b"#$%&*|"
#: The flag of each filter.
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}

FLAGGED = "doc_id long, part string, flags int, digest binary"


def text_flags(body: bytes) -> int:
    """Bits of the filters that look at one text alone (A to D)."""
    words = body.split()
    upper = len(body) - len(body.translate(None, UPPER.encode()))
    points = len(body.decode("utf-8", "replace"))
    failing = {
        "A": len(words) < MIN_WORDS,
        "B": OF * len(set(words)) < MIN_DISTINCT * len(words),
        "C": OF * upper > MAX_UPPER * points,
        "D": len(body.translate(None, SYMBOLS)) < len(body),
    }
    return sum(BIT[f] for f, fails in failing.items() if fails)


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        flags, told = [], []
        for body in batch.column(2):
            raw = body.as_py()
            flags.append(text_flags(raw))
            told.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flags, pa.int32()), pa.array(told, pa.binary())], ["doc_id", "part", "flags", "digest"])


def flagged(docs: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """doc_id, part and the flags of all five filters: one row per document."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole(text).cast("binary").alias("body"))
    rows = materialise(rows.mapInArrow(_flag, FLAGGED), "audit-flags")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"))
    copy = F.when(F.col("doc_id") > F.col("first"), BIT["E"]).otherwise(0)
    told = with_group(rows, materialise(copies, "audit-copies"), "digest", "size", rows.count())
    return told.select("doc_id", "part", F.col("flags").bitwiseOR(copy).alias("flags"))


def orders(spark: SparkSession) -> DataFrame:
    """All orders: filter_order and the bits b1 to b5 of its steps (a table of 120 rows)."""
    rows = [("".join(o), *(BIT[f] for f in o)) for o in permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, " + ", ".join(f"b{i + 1} int" for i in range(len(FILTERS))))


def audit(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per part, order and step. rows: (doc_id, part, flags); labels: (doc_id, quality, toxic)."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    told = labels.groupBy(F.col(key).cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    rows = rows.join(told, "doc_id", "left").select("part", "flags", F.coalesce(F.col("quality"), F.lit(0)).alias("good"), F.coalesce(F.col("toxic"), F.lit(0)).alias("toxic"))
    steps = range(1, len(FILTERS) + 1)
    fails = lambda i: F.col("flags").bitwiseAND(F.col(f"b{i}")) != 0
    first = F.lit(len(FILTERS) + 1)
    for i in reversed(steps):
        first = F.when(fails(i), i).otherwise(first)
    replayed = rows.crossJoin(F.broadcast(orders(rows.sparkSession))).withColumn("first", first)
    stack = F.expr(f"stack({len(FILTERS)}, {', '.join(f'{i}, b{i}' for i in steps)}) AS (step, bit)")
    exploded = replayed.select("part", "filter_order", "flags", "good", "toxic", "first", stack)
    removed, failing = F.col("first") == F.col("step"), F.col("flags").bitwiseAND(F.col("bit")) != 0
    counts = exploded.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if(failing & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("flags") == F.col("bit")).alias("unique_fails"),
        F.count_if(removed & (F.col("good") == 1)).alias("good_lost"),
        F.count_if(removed & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    counts = materialise(counts, "audit-counts")
    filter_of = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    shapley = counts.groupBy("part", filter_of.alias("filter")).agg(F.sum("removed").alias("shapley"))
    return counts.withColumn("filter", filter_of).join(shapley, ["part", "filter"]).select(*counts.columns, "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by source, with all labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(flagged(docs), labels)


OP12_SQL = r"""
WITH told AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM told
), flags AS (
  SELECT w.doc_id, part,
    {'A': len(words) < 200,
     'B': 100 * len(list_distinct(words)) < 50 * len(words),
     'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'),
     'E': doc_id > min(doc_id) OVER (PARTITION BY text)} AS f
  FROM worded w
), labelled AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), rows AS (
  SELECT part, [f.A, f.B, f.C, f.D, f.E] AS f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM flags LEFT JOIN labelled USING (doc_id)
), letters AS (
  SELECT * FROM (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')) t(n, c)
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.n, b.n, c.n, d.n, e.n] AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.n, b.n, c.n, d.n, e.n])) = 5
), replayed AS (
  SELECT part, filter_order, o, f, good, toxic,
    coalesce(list_position(list_transform(o, lambda i: coalesce(f[i], false)), true), 6) AS first,
    len(list_filter(f, lambda x: x)) AS n_fails
  FROM rows CROSS JOIN orders
), steps AS (
  SELECT *, step::INT AS s, coalesce(f[o[step]], false) AS failing FROM replayed CROSS JOIN (SELECT unnest(range(1, 6)) AS step)
), counted AS (
  SELECT part, filter_order, s AS step,
    count(*) FILTER (first > s) AS kept, count(*) FILTER (first = s) AS removed, count(*) FILTER (failing AND first < s) AS redundant,
    count(*) FILTER (failing AND n_fails = 1) AS unique_fails, count(*) FILTER (first = s AND good) AS good_lost, count(*) FILTER (first = s AND toxic) AS toxic_lost
  FROM steps GROUP BY ALL
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM counted
"""
