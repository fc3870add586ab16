"""Problem 5: records of several sources mixed to target shares of the total size.

Documents are counted by source and exact length. A source's budget is met by whole passes over it and one partial pass. If the
knapsack can't take in the whole partial pass, each length first gives the share of its documents that the budget leaves; a bounded-knapsack
subset sum then chooses (further) documents by length so that what remains is filled as exactly as can be. Which documents of a
length are used is decided by a seeded rank.

Defined results: null and empty texts have no size and are used never; a source without a target, or a target without
documents, takes no part (the other shares are kept relative to each other); a repeated id or target counts once; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.ranking import salted_rank
from millrace.storage import materialise

CHOICE = "key string, length int, passes long, extra long"
#: Characters that the knapsack fills exactly at the least, and at the most; and steps of its table that it may take for more than the least.
WINDOW, EXACT, STEPS = 400_000, 40_000_000, 4_000_000_000
#: Documents of which all sums are formed.
FEW = 18


def clean_key(column: Column) -> Column:
    """A spelling without case, outer and repeated white space."""
    return F.lower(F.trim(F.regexp_replace(column, r"\s+", " ")))


def subset_sum(lengths: np.ndarray, counts: np.ndarray, target: int) -> dict[int, int]:
    """How many documents of each length to take for the sum nearest to `target` from below.

    One bitset of reachable sums; for each sum the place of the length that reached it first is kept, so memory follows the
    target and not the number of lengths.
    """
    reached = np.zeros(target + 1, bool)
    reached[0] = True
    by = np.full(target + 1, -1, np.int32)
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        if length > target:
            continue
        left, part = min(count, target // length), 1
        while left > 0:
            part = min(part, left)
            shift = part * length
            fresh = np.flatnonzero(reached[: target + 1 - shift] & ~reached[shift:]) + shift
            reached[fresh] = True
            by[fresh] = i
            left -= part
            part *= 2
        if reached[target]:
            break
    at = int(np.flatnonzero(reached)[-1])
    taken: dict[int, int] = {}
    while at:
        length = int(lengths[by[at]])
        taken[length] = taken.get(length, 0) + 1
        at -= length
    return taken


def _spread(lengths: np.ndarray, spare: np.ndarray, rest: int, window: int, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents of each length that bring `rest` down towards `window`, and what then remains.

    Each round takes up to a tenth of the spare documents of a length, so that the mix of lengths stays as it is; the last ones
    are left to the subset sum.
    """
    taken = np.zeros(len(lengths), np.int64)
    moved = True
    while rest > window and moved:
        moved = False
        for i in order.tolist():
            n = int(min(-(-(spare[i] - taken[i]) // 10), (rest - window // 2) // lengths[i]))
            if n > 0:
                taken[i] += n
                rest -= n * int(lengths[i])
                moved = True
            if rest <= window:
                break
    return taken, rest


def few_sums(lengths: np.ndarray, counts: np.ndarray, target: int) -> dict[int, int]:
    """As subset_sum, by all sums of a few documents of any length."""
    reached: dict[int, dict[int, int]] = {0: {}}
    for length, count in zip(lengths.tolist(), counts.tolist(), strict=True):
        for held, taken in list(reached.items()):
            for n in range(1, min(count, (target - held) // length) + 1):
                reached.setdefault(held + n * length, taken | {length: n})
    return reached[max(reached)]


def choose(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int, window: int = WINDOW, exact: int = EXACT) -> tuple[int, np.ndarray]:
    """(whole passes, documents of each length in the partial pass) for a budget in characters.

    A rest of up to `window` characters (more where few lengths are left, up to `exact`) is filled as nearly as the documents left allow; a
    larger one is brought down first, or, with up to FEW documents, all of their sums are formed. So a rest can stay open only if more than FEW
    documents remain that are longer than `exact` allows for. `lengths` are in ascending order.
    """
    total = int((lengths * counts).sum())
    passes, rest = divmod(budget, total)
    if not rest:
        return passes, np.zeros(len(lengths), np.int64)
    extra = np.zeros(len(lengths), np.int64)
    parts = int(np.log2(counts + 1).sum()) + len(lengths)
    window = min(exact, max(window, STEPS // parts))
    fits = lengths <= rest
    if rest > exact and counts[fits].sum() <= FEW:
        for length, n in few_sums(lengths[fits], counts[fits], rest).items():
            extra[int(np.searchsorted(lengths, length))] = n
        return passes, extra
    if rest > window:
        extra = np.array([int(c) * rest // total for c in counts.tolist()], np.int64)
        rest -= int((lengths * extra).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    taken, rest = _spread(lengths, counts - extra, rest, window, order)
    extra += taken
    some = order[(counts - extra)[order] > 0]
    place = {int(x): i for i, x in enumerate(lengths.tolist())}
    if rest > 0 and len(some):
        for length, n in subset_sum(lengths[some], (counts - extra)[some], min(rest, exact)).items():
            extra[place[length]] += n
    return passes, extra


def _choices(seed: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("length")
        lengths, counts = group["length"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        passes, extra = choose(lengths, counts, int(group["budget"].iloc[0]), seed)
        return pd.DataFrame({"key": group["key"], "length": group["length"], "passes": passes, "extra": extra})

    return run


def mix(records: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(uses, report) of records (`id`, `text`, `subset`) under targets (`subset`, `target_share`, `max_repeat`).

    uses: `id`, `subset` (the target's spelling), `length`, `uses` of each document used.
    report: each target's `subset`, `target_share`, `actual_share`, `n_docs` used, `n_uses`, `n_chars`, `most_uses`.
    total: characters wanted; by default the most that all shares and repeat limits allow.
    """
    goals = targets.where(F.col("subset").isNotNull() & (F.col("target_share") > 0)).select(
        clean_key(F.col("subset")).alias("key"), F.trim("subset").alias("subset"), "target_share", F.greatest(F.coalesce("max_repeat", F.lit(1)), F.lit(1)).alias("max_repeat")
    )
    goals = goals.groupBy("key").agg(F.min("subset").alias("subset"), F.max("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"))
    sized = records.where(F.col("id").isNotNull() & (F.length("text") > 0)).select(F.col("id").cast("long").alias("id"), clean_key(F.col("subset").cast("string")).alias("key"), F.length("text").alias("length"))
    sized = materialise(sized.groupBy("id").agg(F.min_by("key", "length").alias("key"), F.min("length").alias("length")).where(F.col("key").isNotNull()), "sized")
    histogram = sized.groupBy("key", "length").agg(F.count(F.lit(1)).alias("n"))
    held = histogram.groupBy("key").agg(F.sum(F.col("n") * F.col("length")).alias("chars"))
    # A row for each target: a few, read once to find the total that every share can meet.
    rows = goals.join(held, "key").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 targets")
    share = sum(r.target_share for r in rows)
    most = min((r.chars * r.max_repeat * share / r.target_share for r in rows), default=0)
    wanted = most if total is None else min(total, most)
    spark = records.sparkSession
    budgets = spark.createDataFrame([(r.key, min(int(wanted * r.target_share / share), r.chars * r.max_repeat)) for r in rows], "key string, budget long")
    choice = materialise(histogram.join(F.broadcast(budgets), "key").groupBy("key").applyInPandas(_choices(seed), CHOICE), "choice")
    ranked = salted_rank(sized.join(F.broadcast(budgets.select("key")), "key"), ["key", "length"], F.xxhash64(F.lit(seed), "id"), ["id"], "place")
    used = ranked.join(choice, ["key", "length"]).select("id", "key", "length", (F.col("passes") + (F.col("place") <= F.col("extra")).cast("long")).alias("uses")).where("uses > 0")
    used = materialise(used.join(F.broadcast(goals.select("key", "subset")), "key").select("id", "subset", "key", "length", "uses"), "uses")
    sums = used.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("uses").alias("n_uses"), F.sum(F.col("uses") * F.col("length")).alias("n_chars"), F.max("uses").alias("most_uses")
    )
    report = goals.join(sums, "key", "left").crossJoin(F.broadcast(sums.agg(F.sum("n_chars").alias("all_chars"))))
    report = report.select(
        "subset", "target_share", F.coalesce(F.col("n_chars") / F.col("all_chars"), F.lit(0.0)).alias("actual_share"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_docs", "n_uses", "n_chars", "most_uses")],
    )
    return used.select("id", "subset", "length", "uses"), report
