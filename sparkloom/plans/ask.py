"""From a question to a cited, checked answer; models are callables that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import grounding, retrieval
from sparkloom.operators.words import Index


@dataclass(frozen=True)
class AgentSpec:
    """Parameters of a run."""

    id: str = "analyst"
    k: int = 6
    synthesize: bool = False
    focus: str = ""


def evidence(points: DataFrame, index: Index, question: str, query_vector: Sequence[float] | Column, as_of: Column, spec: AgentSpec = AgentSpec()) -> DataFrame:
    """The hits for a question; a focus adds its terms to the search only."""
    return retrieval.retrieve(points, index, f"{question} {spec.focus}".strip(), query_vector, as_of, spec.k)


class ModelOffline(Exception):
    """What a model callable raises if its model cannot be reached."""


def answer(hits: DataFrame, synthesize: Callable[[DataFrame], str | None] | None = None, judge: Callable[[str, DataFrame], DataFrame | None] | None = None, egress: bool = True,
           revise: Callable[[DataFrame, list[str]], str | None] | None = None) -> tuple[str, DataFrame]:
    """(answer_kind, verdicts): the written answer if all its claims are borne out by the hits, else the extractive one.

    verdicts: sentence_index, claim, overlap, grounded, chunk_id. synthesize(hits) writes, then revise(hits, the claims
    that failed) if it is given, or synthesize(hits) once more; judge(text, hits) gives its verdicts or None if it is offline; without a judge
    claims are checked by their words. egress: whether the hits may leave for the writing model. Only k hits and one answer's
    claims are looked at.
    """
    spark = hits.sparkSession
    hits = hits.withColumn("run", F.lit(0)).cache()
    try:
        if hits.isEmpty():
            return "empty", spark.createDataFrame([], "run int, sentence_index int, claim string, overlap double, grounded boolean, chunk_id long")
        kind = "extractive" if egress or not synthesize else "egress-blocked"
        failed: list[str] = []
        for _ in range(2 if synthesize and egress else 0):
            kind = "validator-degraded"
            try:
                text = revise(hits, failed) if failed and revise else synthesize(hits)
            except ModelOffline:
                kind = "executor-offline"
                break
            if not text:
                break
            verdicts = judge(text, hits) if judge else _verdicts(spark.createDataFrame([(0, text)], "run int, answer string"), hits)
            if verdicts is None:
                kind = "unvalidated_offline"
                break
            failed = [r["claim"] for r in verdicts.where("not grounded").select("claim").collect()]  # of one answer
            if not failed:
                return "synthesized", verdicts
        best = retrieval.extractive_answer(hits).select(F.lit(0).alias("run"), "answer")
        return kind, _verdicts(best, hits)
    finally:
        hits.unpersist()


def _verdicts(answers: DataFrame, hits: DataFrame) -> DataFrame:
    return grounding.ground(grounding.claims(answers, "run", "answer"), hits.select("run", "point_id", "text"), "run", "point_id", "text")
