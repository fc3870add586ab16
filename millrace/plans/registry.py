"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import answers, chat, corpus, evaluation, planted
from millrace.shipping import shipped

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (corpus, answers, chat, evaluation, planted)


def queries() -> dict[str, Query]:
    return {q.__name__: shipped(q) for part in _PARTS for q in part.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
