"""Quality rules on whole texts, and lines that too many documents of a host share.

Base counts: words, their characters, symbols, lines equal to an earlier line, and words inside
five-word windows that occur twice or more. The method: lines are normalised (white space trimmed
and collapsed, A-Z lower-cased) and hashed; per host the distinct documents holding a line are
counted, where equal texts count as one document; lines of more than the host's limit are taken
out, and a document that keeps less than LEAST_KEPT of its words is depleted and rejected. A
host's limit is LIMIT_SHARE of its distinct documents, and LIMIT_LEAST at least.

DataFrame and SQL functions only. Repeated windows are found within a row: windows are hashes of
word hashes, and only texts whose windows are not all distinct sort them.

Scale: texts are scanned and never shuffled. Line rows are numbers; they are reduced to distinct
(host, line, text) before counting, so a line that a third of all documents share is summed in
every task before it meets in one. Lines over their limit are at most a few hundred per host.

Defined results: null text counts as empty, has no word and fails the base; a null host is a host
of its own; rows without doc_id are judged by their text; repeated rows get equal results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, materialise, whole

WORDS_LEAST = 10
REPEAT_PERCENT = 20
WINDOW = 5
LIMIT_SHARE = 0.02
LIMIT_LEAST = 20
LEAST_KEPT = 0.25

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]+"


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def base_counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    space, blank = _lit(_SPACE), _lit(ASCII_SPACE)
    told = docs.select(F.col(key).alias("doc_id"), whole(text).alias("body"))
    told = told.select(
        "doc_id",
        F.xxhash64("body").alias("text_hash"),
        F.expr(f"filter(split(body, {space}), w -> w <> '')").alias("words"),
        F.expr(f"filter(split(body, '\\n', -1), l -> btrim(l, {blank}) <> '')").alias("lines"),
        F.expr(f"cast(length(body) - length(regexp_replace(body, {_lit(_SYMBOLS)}, '')) as bigint)").alias("n_symbols"),
    )
    told = told.select(
        "doc_id",
        "text_hash",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.expr("aggregate(words, 0L, (a, w) -> a + length(w))").alias("word_chars"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr("transform(words, w -> xxhash64(w))").alias("h"),
    )
    window = ", ".join(f"h[i + {k}]" for k in range(WINDOW))
    told = told.select("*", F.expr(f"IF(size(h) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, greatest(size(h) - {WINDOW}, 0)), i -> xxhash64({window})))").alias("g")).drop("h")
    told = told.select("*", F.expr("IF(size(array_distinct(g)) = size(g), NULL, sort_array(transform(g, (x, i) -> struct(x, i))))").alias("s")).drop("g")
    told = told.select("*", F.expr("sort_array(filter(transform(s, (e, j) -> IF(e.x = get(s, j - 1).x OR e.x = get(s, j + 1).x, e.i, NULL)), p -> p IS NOT NULL))").alias("p")).drop("s")
    covered = f"aggregate(zip_with(p, slice(p, 2, greatest(size(p), 1)), (a, b) -> IF(b IS NULL, {WINDOW}, least({WINDOW}, b - a))), 0L, (x, y) -> x + y)"
    told = told.select("*", F.expr(f"IF(p IS NULL, 0L, {covered})").alias("n_repeat_words")).drop("p")
    return told.withColumn("base_failed", (F.col("n_words") < WORDS_LEAST) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def host_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """A row per line with a word: doc_id, text_hash, host, pos, line (its hash), words."""
    body = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), whole(text).alias("body"))
    rows = body.select("doc_id", "host", F.xxhash64("body").alias("text_hash"), F.posexplode(F.split(ascii_lower(F.col("body")), "\n", -1)).alias("pos", "line"))
    rows = rows.select("doc_id", "host", "text_hash", "pos", F.btrim(F.regexp_replace("line", _SPACE, " "), F.lit(" ")).alias("line")).filter(F.col("line") != "")
    words = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    return rows.select("doc_id", "text_hash", "host", "pos", F.xxhash64("line").alias("line"), words.cast("long").alias("words"))


def common_lines(lines: DataFrame, share: float = LIMIT_SHARE, least: int = LIMIT_LEAST) -> DataFrame:
    """(host, line, documents, host_documents) of the lines above their host's limit."""
    held = lines.select("host", "line", "text_hash").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") > least)
    hosts = lines.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_documents"))
    return held.join(hosts, "host").filter(F.col("documents") > F.col("host_documents") * F.lit(share))


def _joined(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows left-joined by doc_id and text_hash, where a null doc_id equals a null one."""
    more = more.withColumnsRenamed({"doc_id": "other_id", "text_hash": "other_hash"})
    return rows.join(more, (F.col("text_hash") == F.col("other_hash")) & F.col("doc_id").eqNullSafe(F.col("other_id")), "left").drop("other_id", "other_hash")


def quality(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """Base counts, words lost to common lines, base_failed and kept, per document."""
    lines = materialise(host_lines(docs, text, key, host), "host-lines")
    common = materialise(common_lines(lines), "common-lines")
    lost = lines.join(common.select("host", "line"), ["host", "line"]).dropDuplicates(["doc_id", "text_hash", "host", "pos"]).groupBy("doc_id", "text_hash", "host").agg(F.sum("words").alias("lost"))
    # rows that differ in their host alone lose what their own host removes: the least of it is taken
    lost = lost.groupBy("doc_id", "text_hash").agg(F.min("lost").alias("lost_words"))
    told = _joined(base_counts(docs, text, key), lost)
    gone = F.coalesce("lost_words", F.lit(0))
    return told.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("n_words") - gone >= F.col("n_words") * F.lit(LEAST_KEPT))).alias("kept"),
        gone.alias("lost_words"),
    )


def cleaned(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """doc_id and clean_text: the text without lines above their host's limit."""
    lines = materialise(host_lines(docs, text, key, host), "host-lines")
    marks = lines.join(common_lines(lines).select("host", "line"), ["host", "line"]).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    body = docs.select(F.col(key).alias("doc_id"), whole(text).alias("body")).withColumn("text_hash", F.xxhash64("body"))
    kept = F.array_join(F.filter(F.split("body", "\n", -1), lambda _, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return _joined(body, marks).select("doc_id", F.when(F.col("gone").isNull(), F.col("body")).otherwise(kept).alias("clean_text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
