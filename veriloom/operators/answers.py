"""Answers: deterministic generation, citations, refusal; all as expressions on evidence rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import body

#: Fixed values.
REFUSAL = "知识库中未找到足够依据。"
MOCK_HEAD = "根据知识库正文，"
MOCK_MORE = "……"
SUMMARY_CHARS, EXCERPT_CHARS = 220, 240


def mock_answer(first_text: Column) -> Column:
    """What the deterministic generator says of the first evidence text; refuses without one."""
    whole = body(first_text)
    head = F.regexp_replace(F.substring(whole, 1, SUMMARY_CHARS), r"(?U)\s+$", "")
    more = F.when(F.length(whole) > F.length(head), MOCK_MORE).otherwise("")
    return F.when(first_text.isNull(), REFUSAL).otherwise(F.concat(F.lit(MOCK_HEAD), head, more, F.lit(" [1]")))


def cited(text: Column) -> Column:
    """Distinct citation numbers in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("long")))


def citations_valid(text: Column, n_evidence: Column) -> Column:
    """At least one citation, and all of them name an evidence row."""
    found = cited(text)
    return (F.size(found) > 0) & F.forall(found, lambda i: F.coalesce((i >= 1) & (i <= n_evidence), F.lit(False)))


def repaired(text: Column, n_evidence: Column) -> Column:
    """The deterministic repair: a citation of the first row is appended."""
    return F.when(F.contains(text, F.lit("[1]")) | (n_evidence == 0), text).otherwise(F.concat(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit(" [1]")))


def evidence_prompt(evidence: Column) -> Column:
    """Numbered evidence as a prompt. evidence: ARRAY<STRUCT<title, source_url, text, ...>> in order."""
    return F.array_join(F.transform(evidence, lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(e["title"], F.lit("")), F.lit("\n"), e["text"])), "\n\n")


def gathered(questions: DataFrame, evidence: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    """Each question with its selected evidence as an array in rank order (bounded by the selection)."""
    rows = evidence.filter("selected").select("query_id", "chunk_id", "rank", "score").join(chunks.select("chunk_id", "title", "source_url", "section_path", "text"), "chunk_id")
    held = rows.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "title", "source_url", "section_path", "text"))), 1, limit).alias("evidence"))
    return questions.join(held, "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.expr("cast(array() as array<" + held.schema["evidence"].dataType.elementType.simpleString() + ">)")))


def finished(rows: DataFrame, repairs: int = 1, citation_required: bool = True, draft: Column | None = None, repair: Callable[[Column, Column], Column] = repaired) -> DataFrame:
    """answers: rows with evidence become text, citations, refused and citation_validated.

    Without evidence the refusal text (validated). Drafts with bad citations are repaired at most
    `repairs` times by repair(draft, n_evidence), which sees null where nothing is to be done; still bad ones are refused (not validated, evidence kept). Citations follow
    the evidence's order: the numbers used, or all if none is used and none is required.
    """
    n = F.size("evidence")
    rows = rows.withColumn("draft", mock_answer(F.get("evidence", F.lit(0))["text"]) if draft is None else draft)
    for _ in range(repairs if citation_required else 0):
        bad = F.when((n > 0) & ~citations_valid(F.col("draft"), n), F.col("draft"))
        rows = rows.withColumn("draft", F.coalesce(repair(bad, n), "draft"))
    good = citations_valid(F.col("draft"), n) if citation_required else F.forall(cited(F.col("draft")), lambda i: (i >= 1) & (i <= n))
    rows = rows.withColumn("good", good).withColumn("used", cited(F.col("draft")))
    listed = F.transform("evidence", lambda e, i: F.struct((i + 1).alias("index"), e["chunk_id"].alias("chunk_id"), e["title"].alias("title"), e["source_url"].alias("source_url"), F.substring(body(e["text"]), 1, EXCERPT_CHARS).alias("excerpt")))
    shown = F.filter(listed, lambda c: (F.size("used") == 0) | F.array_contains("used", c["index"].cast("long")))
    refused = (n == 0) | ~F.col("good")
    out = rows.withColumn("refused", refused).withColumn("citation_validated", (n == 0) | F.col("good"))
    return out.withColumn("answer", F.when(refused, REFUSAL).otherwise(F.col("draft"))).withColumn("citations", F.when(refused, F.slice(shown, 1, 0)).otherwise(shown)).drop("good", "used", "draft")


def model_answer(client: Callable[[], Callable[[str, str], str]]):
    """A pandas UDF (question, prompt) over a generator loaded once per worker; a null question asks
    nothing, empty answers raise."""
    held: list = []

    @F.pandas_udf("string")
    def generate(question: pd.Series, prompt: pd.Series) -> pd.Series:
        if not held:
            held.append(client())
        out = [None if q is None else held[0](q, p) for q, p in zip(question, prompt, strict=True)]
        if any(q is not None and not (x or "").strip() for q, x in zip(question, out, strict=True)):
            raise ValueError("generator returned an empty answer")
        return pd.Series(out, dtype=object)

    return generate


#: What a model generator is told, and what it is told when its citations were bad.
RULES = "Answer only from the numbered evidence and cite it as [1], [2].\n\n"
REPAIR = "\n\nYour last answer cited no evidence, or evidence that is not there. Answer again and cite."


def model_drafts(client: Callable[[], Callable[[str, str], str]]) -> tuple[Column, Callable[[Column, Column], Column]]:
    """draft and repair for finished(): rows have text (the question) and evidence."""
    generate = model_answer(client)
    prompt = F.concat(F.lit(RULES), evidence_prompt(F.col("evidence")))
    draft = generate(F.when(F.size("evidence") > 0, F.col("text")), prompt)
    return draft, lambda bad, n: generate(F.when(bad.isNotNull(), F.col("text")), F.concat(prompt, F.lit(REPAIR)))
