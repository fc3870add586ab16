"""Corpus operators: filters, source-balanced order, budgets and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.strings import strip
from millrace.operators.ordering import positions, rank_in_groups

#: Shortest document kept, longest text kept of one, documents in a shard, characters for a token.
MIN_CHARS, MAX_CHARS, SHARD_DOCS, CHARS_PER_TOKEN = 200, 100_000, 20_000, 4.0


def clean(df: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Rows whose stripped text has `min_chars` characters or more, with it cut to `max_chars`; null texts go."""
    return df.withColumn(text, strip(F.col(text))).where(F.length(text) >= min_chars).withColumn(text, F.substring(text, 1, max_chars))


def in_subsets(df: DataFrame, wanted: list[str] | None, subset: str = "subset") -> DataFrame:
    """Rows of the wanted subsets; all without a list, and none of a missing subset with one."""
    return df if wanted is None else df.where(F.coalesce(F.col(subset).isin(wanted), F.lit(False)))


def tokens_of(chars: Column) -> Column:
    return F.floor(chars / F.lit(CHARS_PER_TOKEN)).cast("long")


def balanced_order(df: DataFrame, source: str, order: list[str], extra: list[str] = ()) -> DataFrame:
    """`source`, the order columns, `extra`, `round`, and `seq`: one document of each source a round, sources in the order of their name (those without one first)."""
    ranked = rank_in_groups(df.select(source, *order, *extra), [source], order, "round")
    return positions(ranked, ["round", source], None)


def budget_cut(df: DataFrame, order: list[str], size: str, target: float) -> DataFrame:
    """The rows until the target is reached: the crossing row stays and the first is always kept. Adds `seq` and `before`."""
    return positions(df, order, size).where((F.col("seq") == 1) | (F.col("before") < F.lit(target)))


def balanced_budget(df: DataFrame, source: str, order: list[str], size: str, target: float, least: int = MIN_CHARS, extra: list[str] = ()) -> DataFrame:
    """Balanced order and budget cut in one: `source`, the order columns, `size`, `extra`, `round`, `seq`, `before`.

    A document has `least` characters or more, so no source reaches past round target / least + 1; later rounds are dropped
    before the rows are ordered again.
    """
    ranked = rank_in_groups(df.select(source, *order, size, *extra), [source], order, "round")
    likely = ranked.where(F.col("round") <= F.lit(int(target // max(1, least)) + 2))
    return budget_cut(likely, ["round", source], size, target)


def shard_of(seq: Column, docs: int = SHARD_DOCS, start: int = 0) -> Column:
    return (F.lit(start) + F.floor((seq - 1) / F.lit(docs))).cast("long")


def shard_stats(kept: DataFrame, size: str, start: int = 0, docs: int = SHARD_DOCS) -> DataFrame:
    """One row: `docs`, `chars`, `approx_tokens`, `shards` and the `next_index` after them."""
    shards = F.ceil(F.count(F.lit(1)) / F.lit(docs)).cast("long")
    chars = F.coalesce(F.sum(size), F.lit(0)).cast("long")
    return kept.agg(F.count(F.lit(1)).alias("docs"), chars.alias("chars"), tokens_of(chars).alias("approx_tokens"), shards.alias("shards"), (shards + start).alias("next_index"))


def limit_per_source(df: DataFrame, source: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each source; n must be positive."""
    if n < 1:
        raise ValueError("n must be positive")
    place = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def trim_bibliography(text: Column) -> Column:
    r"""LaTeX text before its bibliography; other text as it is."""
    start = r"\\(?:begin\{thebibliography\}|bibliography\{|bibliographystyle\{)"
    return F.when(F.contains(text, F.lit("\\")), F.split(text, start, 2)[0]).otherwise(text)
