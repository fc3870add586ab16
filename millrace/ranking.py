"""Ranks inside groups of any size, without a task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salted_rank(df: DataFrame, keys: list[str], order: Column, tie: list[str], name: str, buckets: int | None = None) -> DataFrame:
    """Adds `name`: the 1-based position of a row in its group, in the order of `order` (a long that spreads evenly) and `tie`.

    A group is cut into `buckets` ranges of `order` (by default twice the shuffle partitions, 64 at the least), so that a hot group is sorted by
    many tasks; the position inside a range is added to the number of rows in the ranges before it, which come from a table of at most
    groups x buckets rows.
    """
    buckets = buckets or max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    width = 2**63 // buckets
    tagged = df.withColumn("_order", order).withColumn("_range", F.floor(F.shiftrightunsigned("_order", 1) / F.lit(float(width))).cast("int"))
    tagged = tagged.withColumn("_order", F.shiftrightunsigned("_order", 1))
    sizes = tagged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_order", *tie)
    ranked = tagged.withColumn("_inside", F.row_number().over(inside))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_range") == F.col("_r")]
    return (
        ranked.join(offsets, on, "inner")
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_order", "_range", "_inside", "_before", "_r", *[f"_k{i}" for i in range(len(keys))])
    )
