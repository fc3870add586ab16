"""Positions, ranks and running sums over a total order, without one task for the whole table.

The narrow order columns are range-partitioned once and written; totals of the partitions give every partition its offset, and
a window inside each partition does the rest. Only partitions x groups rows are summed at one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import materialise


#: Rows of a partition, at the least and at the most.
FEWEST, MOST = 20_000, 2_000_000


def _partitioned(df: DataFrame, order: list[str]) -> DataFrame:
    """df in written range partitions `_pid`. It is written as it comes first, for sorting by range reads its input twice."""
    narrow = materialise(df, "narrow")
    n = narrow.count()
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-n // MOST), min(usual, -(-n // FEWEST)), 1)
    if parts == 1:
        return narrow.withColumn("_pid", F.lit(0))
    return materialise(narrow.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id()), "ordered")


def _offsets(ranged: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    totals = ranged.groupBy("_pid", *keys).agg(F.sum(amount).alias("_amount"))
    before = Window.partitionBy(*(keys or [F.lit("all")])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_pid", *keys, F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias("_before"))


def rank_in_groups(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with the 1-based rank of each row in its group of `keys`, in the order of `order` (unique in a group); nulls are a group."""
    ranged = _partitioned(df, [*keys, *order])
    inside = F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order))
    offsets = _offsets(ranged, keys, F.lit(1))
    renamed = offsets.select(F.col("_pid").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    on = [F.col("_pid") == F.col("_p")] + [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    ranked = ranged.withColumn("_inside", inside).join(renamed, on)
    return ranked.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_pid", "_before", "_inside", "_p", *[f"_k{i}" for i in range(len(keys))])


def positions(df: DataFrame, order: list[str], size: str | None, seq: str = "seq", before: str = "before") -> DataFrame:
    """df with each row's 1-based place in the order and the sum of `size` over the rows before it."""
    ranged = _partitioned(df, order)
    window = Window.partitionBy("_pid").orderBy(*order)
    out = ranged.withColumn("_n", F.row_number().over(window))
    out = out.join(_offsets(ranged, [], F.lit(1)).withColumnRenamed("_before", "_rows"), "_pid").withColumn(seq, (F.col("_rows") + F.col("_n")).cast("long"))
    if size:
        running = F.coalesce(F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn("_sum", running).join(_offsets(ranged, [], F.col(size)), "_pid").withColumn(before, (F.col("_before") + F.col("_sum")).cast("long"))
    return out.drop("_pid", "_n", "_rows", "_sum", "_before")
