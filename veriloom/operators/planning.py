"""Query processors: each turns questions (query_id, text) into plans.

A plan has original_query, text, queries ARRAY<STRING>, fusion_strategy, filters if the questions
have them, and metadata MAP<STRING, STRING>. Blank questions raise.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

STRATEGIES = ("single_query", "rrf", "multi_query")
#: What planners are asked, by processor; answers are JSON objects.
PROMPTS = {
    "rewrite": 'Rewrite the question as one precise search query. Answer as JSON: {{"query": "..."}}\n{question}',
    "hyde": 'Write a short passage that would answer the question. Answer as JSON: {{"hypothetical_document": "..."}}\n{question}',
    "multi_query": 'Write different search queries for the question. Answer as JSON: {{"queries": ["..."]}}\n{question}',
    "decomposition": 'Split the question into sub-questions that can be searched alone. Answer as JSON: {{"queries": ["..."]}}\n{question}',
}
#: JSON keys under which a planner may answer, in the order they are asked for.
KEYS = {"rewrite": ("query", "rewrite", "rewritten_query"), "hyde": ("query", "hypothetical_document", "hyde")}


def _raise_unless(condition: Column, message: str, value: Column) -> Column:
    """value, where the condition holds; else an error when the row is computed."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def _plan(questions: DataFrame, name: str, text: Column, queries: Column | None = None, strategy: str = "single_query", checked: bool = True) -> DataFrame:
    carried = [c for c in ("filters",) if c in questions.columns]
    text = _raise_unless(F.length(text) > 0, "query is empty", text) if checked else text
    told = questions.select("query_id", F.col("text").alias("original_query"), text.alias("text"), *([queries.alias("queries")] if queries is not None else []), *carried)
    told = told if queries is not None else told.withColumn("queries", F.array("text"))
    return told.withColumn("fusion_strategy", F.lit(strategy)).withColumn("metadata", F.create_map(F.lit("processor"), F.lit(name)))


def identity(questions: DataFrame) -> DataFrame:
    return _plan(questions, "identity", T.squeeze(F.col("text")))


def normalize(questions: DataFrame, aliases: dict[str, str] | None = None, unicode_form: bool = True) -> DataFrame:
    return _plan(questions, "normalize", T.aliased(T.normalized(F.col("text"), unicode_form), aliases or {}))


def expansion(questions: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    return _plan(questions, "expansion", T.expanded(T.squeeze(F.col("text")), terms))


def _answered(questions: DataFrame, answer: str) -> DataFrame:
    """Planner answers have to be JSON objects."""
    return questions.withColumn("_json", _raise_unless(F.get_json_object(answer, "$").startswith("{"), "planner answer is not a JSON object", F.col(answer)))


def _single(questions: DataFrame, name: str, answer: str) -> DataFrame:
    rows = _answered(questions, answer)
    value = F.coalesce(*(F.get_json_object("_json", f"$.{k}") for k in KEYS[name]))
    return _plan(rows, name, T.squeeze(value))


def rewrite(questions: DataFrame, answer: str = "answer") -> DataFrame:
    """questions carry the planner's JSON answer."""
    return _single(questions, "rewrite", answer)


def hyde(questions: DataFrame, answer: str = "answer") -> DataFrame:
    return _single(questions, "hyde", answer)


def _several(questions: DataFrame, name: str, most: int, answer: str) -> DataFrame:
    rows = _answered(questions, answer)
    listed = F.from_json(F.get_json_object("_json", "$.queries"), "array<string>")
    # cut first, then cleaned and de-duplicated; a blank entry raises
    clean = F.transform(F.slice(listed, 1, most), T.squeeze)
    rows = rows.withColumn("_queries", F.array_distinct(clean))
    good = (F.size("_queries") > 0) & F.forall("_queries", lambda q: q.isNotNull() & (F.length(q) > 0))
    first = _raise_unless(good, "planner queries are empty or blank", F.get("_queries", F.lit(0)))
    return _plan(rows, name, first, F.col("_queries"), "rrf", checked=False)


def multi_query(questions: DataFrame, most: int = 4, answer: str = "answer") -> DataFrame:
    return _several(questions, "multi_query", most, answer)


def decomposition(questions: DataFrame, most: int = 4, answer: str = "answer") -> DataFrame:
    return _several(questions, "decomposition", most, answer)


def asking(client: Callable[[], Callable[[str], str]]):
    """A pandas UDF (prompt) over a client that is loaded once per worker; a null prompt asks nothing."""
    held: list = []

    @F.pandas_udf("string")
    def ask(prompt: pd.Series) -> pd.Series:
        if not held:
            held.append(client())
        return pd.Series([None if p is None else held[0](p) for p in prompt], dtype=object)

    return ask


def asking_or_error(client: Callable[[], Callable[[str], str]]):
    """asking() that keeps what a prompt raises: (answer, error)."""
    held: list = []

    @F.pandas_udf("answer string, error string")
    def ask(prompt: pd.Series) -> pd.DataFrame:
        out = []
        for p in prompt:
            try:
                if not held:
                    held.append(client())
                out.append((None if p is None else held[0](p), None))
            except Exception as error:
                out.append((None, f"{type(error).__name__}: {str(error)[:500]}"))
        return pd.DataFrame(out, columns=["answer", "error"], dtype=object)

    return ask


def planned(questions: DataFrame, prompt: str, client: Callable[[], Callable[[str], str]], capture: bool = False) -> DataFrame:
    """questions with a planner's answer: client() is called once per worker, its result per question.
    capture: what a question's call raises becomes its error, and the others go on."""
    before, after = prompt.replace("{{", "{").replace("}}", "}").split("{question}")
    asked = F.concat(F.lit(before), "text", F.lit(after))
    if not capture:
        return questions.withColumn("answer", asking(client)(asked))
    return questions.withColumn("_told", asking_or_error(client)(asked)).withColumns({"answer": F.col("_told.answer"), "error": F.col("_told.error")}).drop("_told")


def faults(questions: DataFrame, processor: str, most_chars: int) -> DataFrame:
    """(query_id, error) of questions that a processor cannot take: blank or too long, or with a
    planner's answer (a column) that is no JSON object."""
    text = T.squeeze(F.coalesce("text", F.lit("")))
    error = F.when(F.length(text) == 0, "query is empty").when(F.length("text") > most_chars, f"questions have 1 to {most_chars} characters")
    if processor in PROMPTS and "answer" in questions.columns:
        error = error.when(~F.coalesce(F.startswith(F.get_json_object("answer", "$"), F.lit("{")), F.lit(False)), "planner answer is not a JSON object")
    return questions.select("query_id", error.alias("error")).filter(F.col("error").isNotNull())


def validated(plans: DataFrame) -> DataFrame:
    """Raises for plans that contradict their strategy."""
    n, s = F.size("queries"), F.col("fusion_strategy")
    fault = (
        F.when(~s.isin(*STRATEGIES), F.concat(F.lit("unknown fusion strategy: "), s))
        .when(s == "multi_query", F.lit("multi_query fusion is not implemented"))
        .when((s == "single_query") & (n != 1), F.lit("single_query needs exactly one query"))
        .when((s == "rrf") & (n < 1), F.lit("rrf needs queries"))
    )
    return plans.withColumn("fusion_strategy", F.when(fault.isNull(), s).otherwise(F.raise_error(fault).cast("string")))
