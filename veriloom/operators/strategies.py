"""Answering strategies over batches: vanilla, self-reflective, agentic, graph.

A retriever is a function queries(query_id, text) -> hits(query_id, chunk_id, score, rank).
Controllers are columns or functions over the batch; the defaults retrieve once and then answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import among, shared_folder, written
from . import answers, evidence, fuse
from .planning import asking
from .graph import graph_retrieve

Retriever = Callable[[DataFrame], DataFrame]
ACTIONS = ("retrieve", "answer", "stop")


def coerced_bool(value: str, *names: str, default: bool = False) -> Column:
    """A controller's JSON answer as a verdict: a bare boolean, or the first of the named members
    that is there, by truthiness (false, 0, empty and null are false); anything else is the default."""
    text = F.trim(F.col(value))
    member = F.coalesce(*(F.get_json_object(value, f"$.{n}") for n in names))
    falsy = F.lower(member).isin("false", "0", "0.0", "", "[]", "{}", "null")
    return F.when(text == "true", True).when(text == "false", False).when(F.startswith(text, F.lit("{")) & member.isNotNull(), ~falsy).otherwise(default)


def coerced_action(value: str) -> Column:
    """retrieve, answer or stop: from a bare word or the members action or type; else stop."""
    word = F.when(F.startswith(F.trim(F.col(value)), F.lit("{")), F.coalesce(F.get_json_object(value, "$.action"), F.get_json_object(value, "$.type"))).otherwise(F.trim(F.regexp_replace(F.col(value), '^"|"$', "")))
    return F.when(F.lower(word).isin(*ACTIONS), F.lower(word)).otherwise("stop")


def vanilla(questions: DataFrame, hits: DataFrame, chunks: DataFrame, top_k: int = 3, min_score: float = 0.0, per_topic: int = 2, repairs: int = 1, candidate_k: int = 20, drafts: tuple | None = None, select: Callable = evidence.select_evidence) -> DataFrame:
    """Candidates to evidence to answers. drafts: (draft, repair) of a model generator; select: the evidence selector."""
    hits = written(hits.filter(F.col("rank") <= candidate_k), "candidates")
    chunks = among(chunks, hits, "chunk_id")
    told = hits.join(chunks.select("chunk_id", "topic_id", "content_hash"), "chunk_id")
    chosen = select(told, top_k, min_score, per_topic, candidate_k)
    rows = answers.gathered(questions, chosen, chunks)
    return answers.finished(rows, repairs) if drafts is None else answers.finished(rows, repairs, draft=drafts[0], repair=drafts[1])


def self_reflective(questions: DataFrame, retrieve: Retriever, assess: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """hits after at most one rewrite, and (query_id, rounds, asked) for each question.

    assess(questions, hits) gives (query_id, sufficient, rewritten). Questions judged insufficient
    with a rewrite that is not blank and differs are retrieved again; that replaces their hits.
    """
    hits = written(retrieve(questions), "first-hits")
    judged = assess(questions, hits)
    new = F.trim(F.coalesce("rewritten", F.lit("")))
    again = written(questions.join(judged, "query_id").filter(~F.col("sufficient") & (new != "") & (new != F.trim("text"))).select("query_id", new.alias("text")), "rewritten")
    told = questions.select("query_id", "text").join(again.withColumnRenamed("text", "rewrite"), "query_id", "left")
    rounds = told.select("query_id", F.when(F.col("rewrite").isNull(), 1).otherwise(2).alias("rounds"), F.coalesce("rewrite", "text").alias("asked"))
    return hits.join(again.select("query_id"), "query_id", "left_anti").unionByName(retrieve(again)), rounds


def supported_or_refused(answered: DataFrame, supported: Column) -> DataFrame:
    """Answers whose support check fails become refusals. supported: a verdict, or a controller's answer."""
    answered = answered.withColumn("_told", supported)
    if answered.schema["_told"].dataType.simpleString() == "string":
        answered = answered.withColumn("_told", coerced_bool("_told", "supported", "sufficient"))
    bad = ~F.col("refused") & ~F.coalesce("_told", F.lit(False))
    answered = answered.withColumn("_bad", bad).drop("_told")
    bad = F.col("_bad")
    return answered.withColumn("answer", F.when(bad, answers.REFUSAL).otherwise(F.col("answer"))).withColumn("citations", F.when(bad, F.slice("citations", 1, 0)).otherwise(F.col("citations"))).withColumn("refused", F.col("refused") | bad).drop("_bad")


def agentic(questions: DataFrame, retrieve: Retriever, act: Callable[[DataFrame, DataFrame | None, int], DataFrame], max_steps: int = 4) -> DataFrame:
    """hits merged over at most max_steps rounds, not truncated.

    act(questions, candidates, step) gives (query_id, action, query). A question leaves the loop
    with answer or stop; each round retrieves for those that ask for it.
    """
    if max_steps <= 0:
        raise ValueError("max_steps must be positive")
    live, held = questions, None
    for step in range(max_steps):
        asked = live.join(act(live, held, step), "query_id").filter(F.col("action") == "retrieve").select("query_id", F.coalesce("query", "text").alias("asked"), "text")
        live = asked.select("query_id", "text")
        found = retrieve(asked.select("query_id", F.col("asked").alias("text")))
        # earlier rounds win ties, so rounds are merged one after the other
        held = fuse.merge_best(found) if held is None else fuse.merge_best(held, found)
        if step + 1 < max_steps:
            shared_folder(questions.sparkSession)
            live, held = live.checkpoint(), held.checkpoint()  # cuts the growing lineage
            if live.isEmpty():
                break
    return held


class Heuristic:
    """Controllers without a model: retrieve once and then answer; any candidate suffices."""

    def assess(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        has = hits.select("query_id").distinct().withColumn("sufficient", F.lit(True))
        return questions.select("query_id", F.col("text").alias("rewritten")).join(has, "query_id", "left").select("query_id", F.coalesce("sufficient", F.lit(False)).alias("sufficient"), "rewritten")

    def act(self, questions: DataFrame, candidates: DataFrame | None, step: int) -> DataFrame:
        nothing = F.lit(None).cast("string").alias("query")
        if candidates is None:
            return questions.select("query_id", F.lit("retrieve").alias("action"), nothing)
        has = candidates.select("query_id").distinct().withColumn("has", F.lit(True))
        return questions.select("query_id").join(has, "query_id", "left").select("query_id", F.when(F.col("has"), "answer").otherwise("retrieve").alias("action"), nothing)

    def supported(self) -> Column:
        return F.lit(True)


#: Candidates that a controller is shown, and characters of each.
SHOWN, SHOWN_CHARS = 6, 400
CONTROL = {
    "assess": 'Does the evidence suffice to answer the question? Answer as JSON: {"sufficient": true or false, "rewritten_query": "..."}',
    "act": 'What is to be done next? Answer as JSON: {"action": "retrieve" or "answer" or "stop", "query": "..."}',
    "support": 'Does the evidence support the answer? Answer as JSON: {"supported": true or false}',
}


class Asked:
    """Controllers that ask a model, with the first SHOWN candidates as its context."""

    def __init__(self, client: Callable[[], Callable[[str], str]], chunks: DataFrame):
        self.ask, self.chunks = asking(client), chunks

    def _told(self, questions: DataFrame, hits: DataFrame | None, task: str) -> DataFrame:
        """(query_id, text, told): the model's answer per question."""
        rows = questions.select("query_id", "text")
        shown = F.lit("")
        if hits is not None:
            near = written(hits.filter(F.col("rank") <= SHOWN).select("query_id", "chunk_id", "rank"), "shown-hits")
            near = near.join(among(self.chunks, near, "chunk_id").select("chunk_id", F.substring("text", 1, SHOWN_CHARS).alias("shown")), "chunk_id")
            rows = rows.join(near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "shown"))).alias("near")), "query_id", "left")
            shown = F.coalesce(F.array_join(F.transform("near", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["shown"])), "\n"), F.lit(""))
        prompt = F.concat(F.lit(CONTROL[task] + "\nQuestion: "), "text", F.lit("\nEvidence:\n"), shown)
        return rows.select("query_id", "text", self.ask(prompt).alias("told"))

    def assess(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        rewritten = F.coalesce(*(F.get_json_object("told", f"$.{n}") for n in ("rewritten_query", "rewrite", "query")))
        return self._told(questions, hits, "assess").select("query_id", coerced_bool("told", "sufficient", "enough").alias("sufficient"), rewritten.alias("rewritten"))

    def act(self, questions: DataFrame, candidates: DataFrame | None, step: int) -> DataFrame:
        return self._told(questions, candidates, "act").select("query_id", coerced_action("told").alias("action"), F.get_json_object("told", "$.query").alias("query"))

    def supported(self) -> Column:
        """For answered rows: text, evidence, answer, refused. Refusals are not asked about."""
        prompt = F.concat(F.lit(CONTROL["support"] + "\nQuestion: "), "text", F.lit("\nAnswer: "), "answer", F.lit("\nEvidence:\n"), answers.evidence_prompt(F.col("evidence")))
        return self.ask(F.when(~F.col("refused"), prompt))


def graph(questions: DataFrame, chunks: DataFrame, k: int = 10, **options) -> DataFrame:
    """Graph retrieval: neither query processors nor rerankers apply."""
    return graph_retrieve(chunks, questions, k, **options)
