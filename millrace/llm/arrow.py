"""Arrow batches in pieces of bounded text, for mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that an operator turns into Python or NumPy objects at once.
PIECE_BYTES = 4_000_000


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose `column` holds about `most` bytes (of lists: values) at the most; a longer single one is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held_by = batch.column(batch.schema.get_field_index(column))
        length = pc.list_value_length if pa.types.is_list(held_by.type) or pa.types.is_large_list(held_by.type) else pc.binary_length
        sizes = pc.fill_null(length(held_by), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def values(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def keyed(records: DataFrame, *others: str) -> DataFrame:
    """`id` as long, the other columns, and `text` as string: what the operators read of a table."""
    return records.select(F.col("id").cast("long").alias("id"), *others, F.col("text").cast("string").alias("text"))
