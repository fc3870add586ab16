"""A stated query set in blocks of bounded size, each of which may be broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import keyed
from millrace.storage import materialise

#: Characters of query texts in a block: what the driver holds and every executor gets at once.
BLOCK_CHARS = 4_000_000


def query_blocks(queries: DataFrame, most_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Lists of (id, text) of at most `most_chars` characters, or of one longer text; ids once each, without nulls."""
    held, chars, last = [], 0, None
    for row in queries.select("id", "text").dropna().orderBy("id", "text").toLocalIterator(prefetchPartitions=False):
        if row.id == last:
            continue
        last = row.id
        if held and chars + len(row.text) > most_chars:
            yield held
            held, chars = [], 0
        held.append((row.id, row.text))
        chars += len(row.text)
    if held:
        yield held


def over_blocks(queries: DataFrame, run: Callable[[list[tuple[int, str]]], DataFrame], empty: Callable[[], DataFrame], most_chars: int = BLOCK_CHARS) -> DataFrame:
    """The union of run(block); with several blocks each result is written before the next block is read."""
    found = []
    blocks = query_blocks(queries, most_chars)
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        result = run(block)
        found.append(materialise(result, "block") if found or following else result)
        block = following
    return reduce(DataFrame.unionByName, found) if found else empty()


def nothing(queries: DataFrame, schema: str) -> DataFrame:
    return queries.sparkSession.createDataFrame([], schema)


def usable(df: DataFrame) -> DataFrame:
    return keyed(df).where(F.col("id").isNotNull() & F.col("text").isNotNull())
