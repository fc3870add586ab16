"""Scores of evaluation runs and of sampled groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import positions


def share(right: Column) -> Column:
    """Share of true values, 0.0 without any."""
    return F.coalesce(F.avg(right.cast("double")), F.lit(0.0))


def accuracy(df: DataFrame, by: list[str], right: str = "correct") -> DataFrame:
    hits = F.coalesce(F.sum(F.col(right).cast("long")), F.lit(0))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), hits.alias("correct"), share(F.coalesce(F.col(right), F.lit(False))).alias("accuracy"))


def pass_at_k(df: DataFrame, by: list[str], problem: str, sample: str, k: int, right: str = "correct") -> DataFrame:
    """Share of problems of which one of the first k samples is right."""
    solved = df.where(F.col(sample) < k).groupBy(*by, problem).agg(F.max(F.coalesce(F.col(right), F.lit(False))).alias("solved"))
    return solved.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("solved").cast("long")).alias("n_solved"), share(F.col("solved")).alias("pass_rate"))


def first_records(df: DataFrame, by: list[str], sample: str, columns: list[str], right: str = "correct") -> DataFrame:
    """Each problem's columns of its first sample, and whether any sample is right."""
    first = F.min_by(F.struct(*columns), F.col(sample)).alias("first")
    out = df.groupBy(*by).agg(first, F.max(F.coalesce(F.col(right), F.lit(False))).alias("any_correct"))
    return out.select(*by, *[F.col(f"first.{c}").alias(c) for c in columns], "any_correct")


def running_accuracy(df: DataFrame, order: list[str], right: str = "correct", batch: int = 64) -> DataFrame:
    """Accuracy after each batch of `batch` rows: `batch`, `n`, `accuracy`."""
    placed = positions(df.select(*order, F.coalesce(F.col(right), F.lit(False)).cast("long").alias("hit")), order, None)
    batches = placed.groupBy(F.ceil(F.col("seq") / F.lit(batch)).cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("rows"), F.sum("hit").alias("hits"))
    # A row for each batch from here on: the running sums need the batches only.
    both = positions(batches, ["batch"], "rows", "_i", "rows_before").select("batch", "rows", "hits", "rows_before")
    both = positions(both, ["batch"], "hits", "_i", "hits_before")
    n, hits = F.col("rows") + F.col("rows_before"), F.col("hits") + F.col("hits_before")
    return both.select("batch", n.cast("long").alias("n"), (hits / n).alias("accuracy"))


def expand_k(df: DataFrame, k: int) -> DataFrame:
    """Each row k times with `sample_idx` from 0."""
    if k < 1:
        raise ValueError("k must be positive")
    return df.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def report(df: DataFrame, task: str, level: str = "level", right: str = "correct", facts: dict[str, object] | None = None) -> DataFrame:
    """One row a task: `task`, `n`, `correct`, `accuracy`, and `report`, all of it as JSON.

    The JSON holds the `facts` (model, adapter, k, limit, backend and the like) in their order, then the figures, then `by_level`: levels as
    names, each with its correct and total number, null levels left out.
    """
    levels = accuracy(df.where(F.col(level).isNotNull()), [task, level], right)
    pairs = F.sort_array(F.collect_list(F.struct(F.col(level).alias("level"), F.col("correct"), F.col("n"))))
    named = F.transform(pairs, lambda p: F.struct(p["level"].cast("string").alias("key"), F.struct(p["correct"].alias("correct"), p["n"].alias("total")).alias("value")))
    maps = levels.groupBy(task).agg(F.map_from_entries(named).alias("by_level"))
    rows = accuracy(df, [task], right).join(maps, task, "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<correct:bigint,total:bigint>>"))
    known = [F.lit(v).alias(k) for k, v in (facts or {}).items()]
    whole = F.struct(*known, F.col(task).alias("task"), "n", "correct", F.round("accuracy", 4).alias("accuracy"), F.coalesce("by_level", empty).alias("by_level"))
    return rows.select(task, "n", "correct", "accuracy", F.to_json(whole, {"ignoreNullFields": "false"}).alias("report"))


def bits_per_byte(df: DataFrame, by: list[str], loss: str, tokens: str, text: str) -> DataFrame:
    """`bits_per_byte` and `perplexity` of texts by group, from the summed loss (in nats) and the number of tokens of each; null without bytes or tokens."""
    total, size = F.sum(F.col(loss).cast("double")), F.sum(F.octet_length(F.encode(text, "UTF-8")).cast("double"))
    return df.groupBy(*by).agg(F.try_divide(total, size * F.lit(math.log(2))).alias("bits_per_byte"), F.exp(F.try_divide(total, F.sum(F.col(tokens).cast("double")))).alias("perplexity"))


def model_diff(df: DataFrame, group: str, a: str, b: str, problem: str, right: str = "correct") -> DataFrame:
    """Problems that a fails in all samples and b solves in one."""
    solved = df.where(F.col(group).isin(a, b)).groupBy(problem).agg(
        F.max(F.when(F.col(group) == a, F.coalesce(F.col(right), F.lit(False)))).alias("a"), F.max(F.when(F.col(group) == b, F.coalesce(F.col(right), F.lit(False)))).alias("b")
    )
    return solved.where(~F.col("a") & F.col("b")).select(problem)


def progression(df: DataFrame, stage: str, task: str, tasks: list[str], right: str = "correct") -> DataFrame:
    """Accuracy of each stage, one column a task."""
    return df.groupBy(stage).pivot(task, tasks).agg(F.avg(F.coalesce(F.col(right), F.lit(False)).cast("double")))


def advantages(df: DataFrame, group: list[str], reward: str, epsilon: float = 1e-6) -> DataFrame:
    """df with `advantage` (reward less its group's mean) and `advantage_std` (that over the population deviation)."""
    stats = df.groupBy(*group).agg(F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_std"))
    out = df.join(stats, group)
    gap = F.col(reward) - F.col("_mean")
    return out.withColumn("advantage", gap).withColumn("advantage_std", gap / (F.col("_std") + F.lit(epsilon))).drop("_mean", "_std")


def reward_groups(df: DataFrame, by: list[str], group: list[str], reward: str) -> DataFrame:
    """Number of groups, and of groups whose rewards are all alike."""
    spans = df.groupBy(*by, *group).agg((F.max(reward) == F.min(reward)).alias("flat"))
    return spans.groupBy(*by).agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("flat").cast("long")).alias("n_flat"))

