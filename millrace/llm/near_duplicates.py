"""Problem 3: records that repeat most of another record with small edits.

HyperMinHash registers are banded; records that share a band are candidates, whose collision-corrected Jaccard estimate
decides whether their shingles are compared exactly.

A band that more than HOT different texts share is a hot one. `links` compares all its members, in blocks of HOT at a time, so that no task holds
the band. `groups` needs no links inside a group: it compares the members of a hot band with the least of them, and then, across the
whole table, only those that still lie in other groups than the bulk of their band with the members of that band.

Defined results: null and blank texts, and texts of fewer words than a shingle, are in no group. A repeated id counts once, with one of
its texts if these differ. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import hyperminhash as hmh
from millrace.llm.arrow import keyed, pieces, values
from millrace.llm.components import label_components
from millrace.llm.text import distinct_shingles, remix
from millrace.sizing import broadcast_if_small
from millrace.storage import materialise

SKETCHES = "id long, class long, check long, n int, registers binary, least array<long>"
#: Sets of up to so many shingles are compared exactly with all that could be like them; their registers depend on each other too much.
SMALL = 12
#: Members from which a band is hot, and members compared with each other by one task at a time.
HOT = 200


def _signature(hashes: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit value for each set: a sum of remixed hashes, remixed with the size."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(remix(hashes + np.uint64(seed)), dtype=np.uint64)))
    return remix((total[starts[1:]] - total[starts[:-1]]) ^ np.diff(starts).astype(np.uint64)).view(np.int64)


def _sketch_scan(size: int, buckets: int, threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes, starts = distinct_shingles(values(batch, "text"), size)
            count = np.diff(starts)
            keep = np.flatnonzero(count > 0)
            registers = hmh.sketch(hashes, starts, buckets)[keep]
            ids = batch.column(0).take(pa.array(keep))
            # Two sets as like as the threshold share one of each other's least hashes, as many as the other cannot lack.
            width = np.where(count <= SMALL / threshold, count - np.ceil(count * threshold - 1e-9).astype(np.int64) + 1, 0)[keep]
            at = np.repeat(starts[keep] - np.cumsum(width) + width, width) + np.arange(width.sum())
            least = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(width))).astype(np.int32)), pa.array(hashes[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(_signature(hashes, starts, x)[keep]) for x in (0x2545F4914F6CDD1D, 0x61C8864680B583EB)), pa.array(count[keep].astype(np.int32)), pa.array([r.tobytes() for r in registers], pa.binary()), least],
                names=["id", "class", "check", "n", "registers", "least"],
            )

    return scan


def sketches(records: DataFrame, size: int, buckets: int, threshold: float) -> DataFrame:
    """One row for each record with a shingle: its id, class of equal shingle sets (128 bits in two columns), number of shingles, registers, and the least hashes of a small set."""
    return records.where(F.col("id").isNotNull() & F.col("text").isNotNull()).mapInArrow(_sketch_scan(size, buckets, threshold), SKETCHES)


def _estimates(buckets: int):
    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, b = (np.frombuffer(b"".join(values(batch, c)), np.uint16).reshape(-1, buckets) for c in ("registers_a", "registers_b"))
            n_a, n_b = (np.array(values(batch, c)) for c in ("n_a", "n_b"))
            found = hmh.corrected_jaccard((a == b).sum(axis=1), n_a, n_b, buckets)
            found[np.minimum(n_a, n_b) <= SMALL] = 1.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["a", "b", "estimate"])

    return estimate


def _shingle_scan(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes, starts = distinct_shingles(values(batch, "text"), size)
            sets = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["id", "shingles"])

    return scan


class Prepared:
    """Records of one shape for both operators: sketches, members of equal sets, and the bands that several sets share."""

    def __init__(self, records: DataFrame, size: int, threshold: float, bands: int, rows: int, slack: float) -> None:
        self.size, self.threshold, self.buckets = size, threshold, bands * rows
        self.margin = slack * (threshold * (1 - threshold) / self.buckets) ** 0.5
        self.records = keyed(records)
        table = materialise(sketches(self.records, size, self.buckets, threshold), "sketches")
        # Registers stay where they are: repeated ids and copies are found by narrow columns.
        versions = materialise(table.groupBy("id").agg(F.min(F.struct("class", "check")).alias("set"), F.max(F.struct("class", "check")).alias("other")), "versions")
        known = versions.select("id", "set.class", "set.check")
        copied = known.groupBy("class", "check").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("class", "check", "rep")
        self.members = materialise(known.join(broadcast_if_small(copied), ["class", "check"], "left").select("id", F.coalesce("rep", "id").alias("rep")), "members")
        others = self.members.where("id <> rep").select("id")
        stale = versions.where("set <> other").select("id", F.col("set.class").alias("kept"))
        reps = table.join(broadcast_if_small(others), "id", "left_anti")
        self.reps = reps.join(broadcast_if_small(stale), "id", "left").where("kept IS NULL OR class = kept").drop("kept")
        width = 2 * rows
        keys = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", width * i + 1, width)) for i in range(bands)])
        least = F.transform("least", lambda x: F.xxhash64(F.lit(-1), x))
        banded = self.reps.select("id", F.explode(F.concat(keys, least)).alias("key"))
        counts = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        self.shared = materialise(banded.join(counts, "key").distinct(), "bands")

    def cold(self) -> DataFrame:
        """All pairs `a` < `b` inside bands that are not hot."""
        cold = self.shared.where(F.col("n") <= HOT).select("id", "key")
        left, right = cold.alias("l"), cold.alias("r")
        return left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))

    def hot(self) -> DataFrame:
        """All pairs inside hot bands: members fall into blocks of about HOT, and each pair of blocks is a join key of its own."""
        blocks = F.ceil(F.col("n") / F.lit(HOT)).cast("int")
        own = F.pmod(F.xxhash64(F.lit(5), "id"), blocks).cast("int")
        cells = self.shared.where(F.col("n") > HOT).select("id", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        cells = cells.select("id", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "i", "j")] + [F.col("l.own") == F.col("l.i"), F.col("r.own") == F.col("r.j"), F.col("l.id") != F.col("r.id")]
        met = cells.alias("l").join(cells.alias("r"), on)
        return met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))

    def stars(self) -> DataFrame:
        """Each member of a hot band with the least of it."""
        hot = self.shared.where(F.col("n") > HOT)
        least = hot.groupBy("key").agg(F.min("id").alias("a"))
        return hot.join(least, "key").where("a < id").select("a", F.col("id").alias("b"))

    def across(self, labels: DataFrame) -> DataFrame:
        """The members of hot bands that lie in other groups than most of their band, with all members of the band.

        Where a band holds one group, as copies of one template do, nothing is left to compare.
        """
        hot = self.shared.where(F.col("n") > HOT).select("id", "key")
        hot = materialise(hot.join(labels, "id", "left").select("id", "key", F.coalesce("label", "id").alias("label")), "hot")
        sizes = hot.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"))
        bulk = sizes.groupBy("key").agg(F.max(F.struct("k", "label")).alias("m"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("key", F.col("m.label").alias("bulk"))
        rest = hot.join(bulk, "key").where("label <> bulk").select("key", F.col("id").alias("x"), F.col("label").alias("mine"))
        met = rest.join(hot, "key").where("mine <> label")
        return met.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))

    def verified(self, candidates: DataFrame) -> DataFrame:
        """`a`, `b`, `jaccard` of the candidates whose shingle sets overlap by the threshold or more, compared exactly."""
        candidates = materialise(candidates.distinct(), "candidates")
        ends = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        picked = self.reps.select("id", "n", "registers").join(broadcast_if_small(ends), "id", "left_semi")

        def side(df: DataFrame, name: str, *columns: str) -> DataFrame:
            return df.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

        both = candidates.join(side(picked, "a", "n", "registers"), "a").join(side(picked, "b", "n", "registers"), "b")
        likely = both.select("a", "b", "n_a", "n_b", "registers_a", "registers_b").mapInArrow(_estimates(self.buckets), "a long, b long, estimate double")
        likely = materialise(likely.where(F.col("estimate") >= self.threshold - self.margin).select("a", "b").distinct(), "likely")
        ends = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts = self.records.where(F.col("text").isNotNull()).join(broadcast_if_small(ends), "id", "left_semi")
        sets = texts.mapInArrow(_shingle_scan(self.size), "id long, shingles array<long>")
        met = likely.join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b")
        shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
        met = met.select("a", "b", (shared / (F.size("shingles_a") + F.size("shingles_b") - shared)).alias("jaccard"))
        # Rows repeated under one id meet again; of differing texts under one id the best counts.
        return met.where(F.col("jaccard") >= self.threshold).groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def links(
    records: DataFrame, *, size: int = 5, threshold: float = 0.8, bands: int = 48, rows: int = 4, slack: float = 4.0
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of records with columns `id` (long) and `text`.

    members: `id`, `rep` - each record with the least id among the records of the same shingle set.
    links: `a` < `b`, `jaccard` - pairs of such least ids whose shingle sets overlap by `threshold` or more.

    A pair of Jaccard similarity s shares a band with probability 1 - (1 - s ** rows) ** bands: with 48 bands of 4 rows
    0.955 at 0.5, 0.999 at 0.6. A candidate is compared exactly unless its estimate lies `slack` standard errors under the
    threshold. Sets of up to SMALL shingles are also joined by their least hashes and compared exactly in any case. Records of one shingle set enter the bands once, so copies make no pairs however many they are.
    """
    ready = Prepared(records, size, threshold, bands, rows, slack)
    return ready.members, ready.verified(ready.cold().unionByName(ready.hot()))


def groups(records: DataFrame, *, size: int = 5, threshold: float = 0.8, bands: int = 48, rows: int = 4, slack: float = 4.0) -> DataFrame:
    """`id`, `rep` (least id of the same shingle set) and `group_id` (least id of the connected records) of each record.

    The groups are those of `links`, but links inside a group that hot bands would add are not worked out: see above.
    """
    ready = Prepared(records, size, threshold, bands, rows, slack)
    linked = materialise(ready.verified(ready.cold().unionByName(ready.stars())).select("a", "b"), "links")
    labels = materialise(label_components(linked), "labels")
    if not ready.shared.where(F.col("n") > HOT).isEmpty():
        more = ready.verified(ready.across(labels)).select("a", "b")
        labels = label_components(linked.unionByName(more))
    out = ready.members.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
    return out.select("id", "rep", F.coalesce("label", "rep").alias("group_id"))


def pairs(members: DataFrame, linked: DataFrame) -> DataFrame:
    """All pairs `id_a` < `id_b` of different ids: of records of one shingle set and of records of linked sets."""
    m = members.select("id", "rep")
    size = m.groupBy("rep").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("rep")
    several = m.join(size, "rep", "left_semi")
    within = several.alias("l").join(several.alias("r"), (F.col("l.rep") == F.col("r.rep")) & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("id_a"), F.col("r.id").alias("id_b"))
    first = m.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    second = m.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = linked.select("a", "b").join(first, "a").join(second, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return within.unionByName(across)


def chat_text(messages: Column) -> Column:
    """All contents but those of system turns, joined by line breaks."""
    said = F.filter(messages, lambda m: F.coalesce(F.lower(F.trim(m["role"])), F.lit("")) != "system")
    return F.array_join(F.transform(said, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
