"""Grading of completions: correctness, rewards, agreement, calculator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.answers import extract_answer
from millrace.functions.arithmetic import error_count, with_checks
from millrace.functions.cleaning import clean_solution
from millrace.functions.symbolic import with_equivalence


def grade(df: DataFrame, completion: str, gold: str, name: str = "is_correct") -> DataFrame:
    """df with `answer` (extracted, in place of a column of that name) and the boolean `name`; null completions are wrong."""
    read = df.withColumn("_gold", F.col(gold)).withColumn("answer", extract_answer(F.col(completion)))
    return with_equivalence(read, "answer", "_gold", name).drop("_gold")


def reward(answer: Column, right: Column, correct: float = 1.0, incorrect: float = -1.0, no_answer: float = -1.0) -> Column:
    return F.when(answer.isNull(), F.lit(no_answer)).when(right, F.lit(correct)).otherwise(F.lit(incorrect))


def reward_function(spark: SparkSession, correct: float = 1.0, incorrect: float = -1.0, no_answer: float = -1.0) -> Callable[[list, list[str]], list[float]]:
    """What a trainer calls with a batch of completions (strings, or lists of messages) and as many gold answers: their rewards, in order."""

    def call(completions: list, answer: list[str]) -> list[float]:
        texts = [c if c is None or isinstance(c, str) else (c[-1].get("content") or "") if c else "" for c in completions]
        rows = spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate(zip(texts, answer, strict=True))], "i int, completion string, gold string")
        found = grade(rows, "completion", "gold").select("i", reward(F.col("answer"), F.col("is_correct"), correct, incorrect, no_answer).alias("reward"))
        return [r.reward for r in found.orderBy("i").collect()]

    return call


def completion_text(column: Column, nested: bool) -> Column:
    """The text of a completion that is a string, or the content of the last of its messages ('' without one)."""
    return F.coalesce(F.try_element_at(column, F.lit(-1))["content"], F.lit("")) if nested else column


def agreement(df: DataFrame, right: str, *by: str, least: float | None = None) -> DataFrame:
    """Share of right rows by group, 1.0 for an empty table without groups; with `least`, a lower share raises."""
    out = df.groupBy(*by).agg(F.coalesce(F.avg(F.col(right).cast("double")), F.lit(1.0)).alias("agreement"), F.count(F.lit(1)).alias("n"))
    if least is not None and (low := out.where(F.col("agreement") < least).limit(5).collect()):
        raise ValueError(f"agreement below {least}: {low}")
    return out


def solve(df: DataFrame, completion: str, calculator: bool = True) -> DataFrame:
    """df with `solution` (cleaned), `raw_answer`, `answer` (put right by the calculator), `checked`, `errors` and `corrected`."""
    cleaned = df.withColumn("solution", clean_solution(F.col(completion))).withColumn("raw_answer", extract_answer(F.col("solution")))
    if not calculator:
        return cleaned.withColumn("answer", F.col("raw_answer"))
    found = with_checks(cleaned, F.col("solution"), F.col("raw_answer"))
    return (
        found.withColumn("answer", F.coalesce("corrected_answer", "raw_answer"))
        .withColumn("checked", F.size("checks"))
        .withColumn("errors", error_count(F.col("checks")))
        .withColumn("corrected", F.col("corrected_answer").isNotNull())
        .drop("checks", "corrected_answer")
    )
