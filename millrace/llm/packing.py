"""Problem 7: items packed into containers of fixed capacity by minimum bin slack.

Only the number of items of each length matters for the plan: at most `capacity` rows, however large the data. A bitset
subset-sum fills one container at a time as near to capacity as the remaining lengths allow, around the longest of them, and the
same filling is used as often as the counts permit. Items are then dealt to the planned places by their rank in their length.

Defined results: an item longer than the capacity fills whole containers and leaves one shorter rest; an item of no length
(null or empty text) stands in no container (null); a null id is left out and a repeated id is one item (of its largest size); ties are broken by a seeded hash and the id; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.ranking import salted_rank
from millrace.storage import materialise

PLAN = "length int, first long, last long, per int, pattern int, container long, times long, fill int"


def fill_one(lengths: Iterable[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as near to `room` as can be, without passing it.

    One bitset holds the sums reached so far; the bitset before each length is kept, from which the counts are traced back. Lengths are
    read only until the room is filled.
    """
    reached, mask = 1, (1 << (room + 1)) - 1
    layers = []
    for length in lengths:
        if length > room:
            continue
        left, part, before = min(counts[length], room // length), 1, reached
        while left > 0:  # multiples of a length in powers of two
            part = min(part, left)
            reached |= (reached << (part * length)) & mask
            left -= part
            part *= 2
        if reached != before:
            layers.append((length, before))
        if reached >> room & 1:
            break
    at = reached.bit_length() - 1
    taken: dict[int, int] = {}
    for length, before in reversed(layers):
        while not before >> at & 1:
            taken[length] = taken.get(length, 0) + 1
            at -= length
    return taken


def plan(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """(lengths in a container and how many of each, number of containers filled so) until no item is left."""
    left = {length: n for length, n in counts.items() if n > 0}
    order, live = sorted(left, reverse=True), len(left)
    begin = 0
    while live:
        while not left[order[begin]]:
            begin += 1
        if len(order) - begin > 2 * live:  # used-up lengths are dropped now and then
            order, begin = [x for x in order[begin:] if left[x]], 0
        longest = order[begin]
        left[longest] -= 1
        taken = fill_one((x for x in islice(order, begin, None) if left[x]), left, capacity - longest)
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[x] // n for x, n in taken.items())
        for x, n in taken.items():
            left[x] -= n * times
            live -= not left[x]
        yield taken, times


def _plan_table(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(group["length"].tolist(), group["n"].tolist(), strict=True))
        used = dict.fromkeys(counts, 0)
        rows, container = [], 0
        for i, (taken, times) in enumerate(plan(counts, capacity)):
            fill = sum(x * n for x, n in taken.items())
            for x, n in taken.items():
                rows.append((x, used[x] + 1, used[x] + n * times, n, i, container, times, fill))
                used[x] += n * times
            container += times
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PLAN.split(", ")])

    return run


def pack(items: DataFrame, capacity: int, seed: int = 7) -> DataFrame:
    """One row for each part of an item (columns `id`, `size`): `id`, `part`, `size`, `container`, `fill` of that container.

    Containers of whole parts of oversized items follow the planned ones in number.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = items.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long").alias("size"))
    items = materialise(items.groupBy("id").agg(F.max("size").alias("size")), "items")
    full = F.floor(F.col("size") / F.lit(capacity)).cast("long")
    rest = (F.col("size") % capacity).cast("int")
    rests = items.select("id", full.cast("int").alias("part"), rest.alias("length")).where("length > 0")
    histogram = rests.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    planned = materialise(histogram.groupBy(F.lit("all")).applyInPandas(_plan_table(capacity), PLAN), "plan")
    places = salted_rank(rests, ["length"], F.xxhash64(F.lit(seed), "id"), ["id", "part"], "place")
    dealt = _deal(places, planned)
    base = planned.agg(F.coalesce(F.max(F.col("container") + F.col("times")), F.lit(0)).alias("base"))
    wholes = items.where(full > 0).withColumn("full", full)
    wholes = salted_offsets(wholes, seed).crossJoin(F.broadcast(base))
    wholes = wholes.select("id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"), "base", "before")
    wholes = wholes.select("id", F.col("part").cast("int").alias("part"), F.lit(capacity).cast("long").alias("size"), (F.col("base") + F.col("before") + F.col("part")).alias("container"), F.lit(capacity).cast("long").alias("fill"))
    none = items.where("size = 0").select("id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("container"), F.lit(None).cast("long").alias("fill"))
    return dealt.unionByName(wholes).unionByName(none)


def _deal(places: DataFrame, planned: DataFrame, most: int = 4_000_000) -> DataFrame:
    """`id`, `part`, `size`, `container`, `fill` of items by `length` and `place`: a place belongs to the last range of its length that begins at or before it.

    The plan has a row for each filling and length in it, whatever the number of items; its count is checked before it is sent to all tasks.
    """
    rows = planned.select("length", "first", "per", "container", "fill").limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"a plan of more than {most} rows")
    table = {c: rows.column(c).to_numpy().astype(np.int64) for c in rows.column_names}
    order = np.lexsort((table["first"], table["length"]))
    shared = places.sparkSession.sparkContext.broadcast({c: v[order] for c, v in table.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        starts = np.flatnonzero(np.diff(held["length"], prepend=-1))
        known = held["length"][starts]
        ends = np.append(starts[1:], len(held["length"]))
        for batch in batches:
            length, place = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "place"))
            group = np.searchsorted(known, length)
            at = np.zeros(len(length), np.int64)
            for g in np.unique(group):
                rows_of = np.flatnonzero(group == g)
                at[rows_of] = starts[g] + np.searchsorted(held["first"][starts[g] : ends[g]], place[rows_of], "right") - 1
            inside = (place - held["first"][at]) // held["per"][at]
            columns = [batch.column(batch.schema.get_field_index("id")), batch.column(batch.schema.get_field_index("part")), pa.array(length), pa.array(held["container"][at] + inside), pa.array(held["fill"][at])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "size", "container", "fill"])

    return places.select("id", "part", "length", "place").mapInArrow(run, "id long, part int, size long, container long, fill long")


def salted_offsets(df: DataFrame, seed: int, buckets: int = 256) -> DataFrame:
    """Adds `before`: the sum of `full` over the rows before, in the order of hash ranges that are summed apart."""
    tagged = df.withColumn("_h", F.xxhash64(F.lit(seed), "id")).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    totals = tagged.groupBy("_b").agg(F.sum("full").alias("_n"))
    earlier = Window.partitionBy(F.lit("all")).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_b").orderBy("_h", "id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = tagged.withColumn("_in", F.coalesce(F.sum("full").over(inside), F.lit(0)))
    return ranked.join(F.broadcast(offsets), "_b").withColumn("before", (F.col("_offset") + F.col("_in")).cast("long")).drop("_h", "_b", "_in", "_offset")
