"""Profiles of text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a sampled profile.
SAMPLED = 500


def _histogram(df: DataFrame, value: str) -> DataFrame:
    """`value`, `n`, `upto` (rows up to it): as many rows as there are different values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy(F.lit("all")).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("upto", F.sum("n").over(running)).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit("all"))))


def percentiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """`share`, `value`: the value at place min(n - 1, floor(share * n)) of the sorted ones, counted from 0."""
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("share")
    counted = _histogram(df, value).select("*", wanted)
    place = F.least(F.col("total") - 1, F.floor(F.col("share") * F.col("total")).cast("long"))
    return counted.where(F.col("upto") > place).groupBy("share").agg(F.min("value").alias("value"))


def length_stats(df: DataFrame, value: str) -> DataFrame:
    """One row `n, min, p50, mean, p95, max` (mean cut to an integer); none of an empty table."""
    counted = _histogram(df, value)

    def at(q: float) -> Column:
        place = F.least(F.col("total") - 1, F.floor(F.lit(q) * F.col("total")).cast("long"))
        return F.min(F.when(F.col("upto") > place, F.col("value")))

    out = counted.agg(
        F.max("total").alias("n"), F.min("value").alias("min"), at(0.5).alias("p50"), F.floor(F.sum(F.col("value") * F.col("n")) / F.sum("n")).cast("long").alias("mean"),
        at(0.95).alias("p95"), F.max("value").alias("max"),
    )
    return out.where(F.col("n").isNotNull())


def preview(df: DataFrame, order: str, text: str, rows: int = 2, chars: int = 150) -> DataFrame:
    """The first rows with their text on one line, cut."""
    return df.orderBy(order).limit(rows).select(order, F.substring(F.replace(F.col(text), F.lit("\n"), F.lit(" ")), 1, chars).alias(text))


def _count_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The characters of a task's texts, a row each; a character has one of 1,114,112 codes."""
    total = np.zeros(0x110000, np.int64)
    waiting: list[str] = []

    def count() -> None:
        held = np.bincount(np.frombuffer("".join(waiting).encode("utf-32-le", "surrogatepass"), np.uint32))
        total[: len(held)] += held
        waiting.clear()

    chars = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            waiting.append(text or "")
            chars += len(waiting[-1])
            if chars > 4_000_000:
                count()
                chars = 0
    count()
    codes = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in codes.tolist()], pa.string()), pa.array(total[codes])], names=["character", "n"])


def characters(df: DataFrame, text: str) -> DataFrame:
    """`character`, `n`: every character of the texts and how often it occurs."""
    counted = df.select(F.col(text).cast("string").alias("text")).mapInArrow(_count_characters, "character string, n long")
    return counted.groupBy("character").agg(F.sum("n").alias("n"))


def latex_commands(df: DataFrame, text: str) -> DataFrame:
    r"""`command`, `n`: the \commands of the texts and how often they occur."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"\\[a-zA-Z]+"), F.lit(0))
    return df.select(F.explode(found).alias("command")).groupBy("command").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: Column, width: int) -> DataFrame:
    """`bucket` (its lower end), `n`."""
    return df.where(value.isNotNull()).groupBy((F.floor(value / F.lit(width)) * width).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
