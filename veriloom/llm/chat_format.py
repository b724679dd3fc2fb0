"""Preference formatting: a prompt rendered once, and paired completions with loss masks.

A preference is two conversations, chosen and rejected, given as turn tables with a shared key.
Their longest common prefix of turns (equal role and text, in turn order) is the prompt; what
follows on either side is that side's completion. A completion's mask lists the stretches that
assistant turns fill, as start:end in code points of the completion, end exclusive; all else
(headers, other roles) is masked out.

A turn is rendered `<|role|>\\ntext<|end|>\\n`.

Scale: one shuffle on the key for either side; everything else is expressions on a row. A
conversation is one record, as it is one training example; groups of equal conversations are never
brought together.

Defined results: null roles and texts count as empty; turns are ordered by turn (null first), role
and text, so that repeated turn numbers have a defined order; equal sides have empty completions and
tie = true; a key that only one side has is paired with an empty conversation, and a null key is
never paired; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def conversations_of(turns: DataFrame, name: str, key: str = "conv_id") -> DataFrame:
    """(key, name): the turns of a conversation as an array of (role, text), in order."""
    turn = F.struct(F.col("turn").alias("t"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy(F.col(key).alias("pair_id")).agg(F.transform(F.sort_array(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias(name))


def preference_format(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """pair_id, n_common, prompt, and per side n turns, completion and mask, from two turn tables."""
    pairs = conversations_of(chosen, "c", key).join(conversations_of(rejected, "r", key), "pair_id", "full")
    return formatted(pairs)


def formatted(pairs: DataFrame) -> DataFrame:
    """The same from (pair_id, c, r): both sides as arrays of (role, text), null as empty."""
    empty = F.expr("cast(array() as array<struct<role: string, text: string>>)")
    pairs = pairs.select("pair_id", F.coalesce("c", empty).alias("c"), F.coalesce("r", empty).alias("r"))
    # a turn counts while all turns before it were equal
    common = F.aggregate(F.zip_with("c", "r", lambda x, y: x.eqNullSafe(y)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("going")), lambda a, same: F.struct((a["n"] + F.when(a["going"] & same, 1).otherwise(0)).alias("n"), (a["going"] & same).alias("going")), lambda a: a["n"])
    pairs = pairs.withColumn("n_common", common)

    def rendered(turn):
        return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))

    def spans(turns):
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("told"))

        def step(acc, turn):
            begin = acc["at"] + F.length(turn["role"]) + 5
            end = begin + F.length(turn["text"])
            told = F.when(turn["role"] == TRAINED_ROLE, F.array_append(acc["told"], F.concat_ws(":", begin, end))).otherwise(acc["told"])
            return F.struct((end + 8).alias("at"), told.alias("told"))

        return F.aggregate(turns, start, step, lambda a: F.array_join(a["told"], ","))

    rest = lambda side: F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))
    pairs = pairs.select("pair_id", "n_common", F.slice("c", 1, F.col("n_common")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    text = lambda side: F.array_join(F.transform(side, rendered), "")
    return pairs.select(
        "pair_id", F.col("n_common").cast("long").alias("n_common"), text("p").alias("prompt"),
        F.size("c").cast("long").alias("n_chosen"), text("c").alias("chosen"), spans(F.col("c")).alias("chosen_mask"),
        F.size("r").cast("long").alias("n_rejected"), text("r").alias("rejected"), spans(F.col("r")).alias("rejected_mask"),
        ((F.size("c") == 0) & (F.size("r") == 0)).alias("tie"),
    )


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """(pair_id, c, r) for conversations (pair_id, c) without a rejected side: the last reply comes
    from the next conversation.

    r ends at the last assistant turn in the order of turns; the next conversation is the one with
    the next pair_id. Without a next one, or a reply in it, the reply is empty; without an assistant
    turn, r is empty; a null pair_id has no next one.
    """
    last = F.size("c") - F.array_position(F.reverse(F.col("c.role")), TRAINED_ROLE) + 1
    told = conversations.withColumn("last", F.when(F.array_contains("c.role", TRAINED_ROLE), last.cast("int")))
    other = told.filter(F.col("last").isNotNull()).select((F.col("pair_id") - 1).alias("pair_id"), F.expr("c[last - 1].text").alias("other"))
    reply = F.array(F.struct(F.lit(TRAINED_ROLE).alias("role"), F.coalesce("other", F.lit("")).alias("text")))
    return told.join(other, "pair_id", "left").select("pair_id", "c", F.when(F.col("last").isNotNull(), F.concat(F.expr("slice(c, 1, last - 1)"), reply)).alias("r"))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with a swapped last reply."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    told = formatted(swapped_replies(conversations_of(turns, "c")))
    digest = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return told.select("pair_id", "n_common", digest("prompt"), "n_chosen", digest("chosen"), "chosen_mask", "n_rejected", digest("rejected"), "rejected_mask", "tie")


OP7_SQL = """
WITH last_reply AS (
  SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS reply FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), sides AS (
  SELECT conv_id, turn, role, text, 'c' AS side FROM conversations
  UNION ALL
  SELECT t.conv_id, t.turn, t.role, CASE WHEN t.turn = l.last_turn THEN coalesce(o.reply, '') ELSE t.text END, 'r'
  FROM conversations t JOIN last_reply l ON l.conv_id = t.conv_id LEFT JOIN last_reply o ON o.conv_id = t.conv_id + 1
  WHERE t.turn <= l.last_turn
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn) AS i FROM sides
), paired AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.i, r.i) AS i,
         coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM (SELECT * FROM placed WHERE side = 'c') c FULL JOIN (SELECT * FROM placed WHERE side = 'r') r ON c.conv_id = r.conv_id AND c.i = r.i
), common AS (
  SELECT conv_id, coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS n FROM paired GROUP BY conv_id
), told AS (
  SELECT p.*, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown,
         sum(length(role) + length(text) + 13) OVER (PARTITION BY p.conv_id, side, p.i <= n ORDER BY p.i) AS upto
  FROM placed p JOIN common USING (conv_id)
)
SELECT conv_id AS pair_id, any_value(n) AS n_common,
  sha256(coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'c' AND i <= n), '')) AS prompt_sha256,
  count(*) FILTER (side = 'c' AND i > n) AS n_chosen,
  sha256(coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'c' AND i > n), '')) AS chosen_sha256,
  coalesce(string_agg((upto - 8 - length(text))::BIGINT || ':' || (upto - 8)::BIGINT, ',' ORDER BY i) FILTER (side = 'c' AND i > n AND role = 'assistant'), '') AS chosen_mask,
  count(*) FILTER (side = 'r' AND i > n) AS n_rejected,
  sha256(coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'r' AND i > n), '')) AS rejected_sha256,
  coalesce(string_agg((upto - 8 - length(text))::BIGINT || ':' || (upto - 8)::BIGINT, ',' ORDER BY i) FILTER (side = 'r' AND i > n AND role = 'assistant'), '') AS rejected_mask,
  count(*) FILTER (i > n) = 0 AS tie
FROM told GROUP BY conv_id
"""
