import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, packing, tokens

MERGES = [("a", "b"), ("ab", "ab"), ("b", "a"), (" ", "a"), (" a", "b"), ("c", "c"), ("cc", "c"), ("ab", "c"), ("1", "2"), ("a", "a"), ("aa", "a"), ("abc", "cc")]


def slow_tokens(piece):
    rank, found = {p: i for i, p in enumerate(MERGES)}, list(piece)
    while True:
        best = min((rank.get((a, b), 99), i) for i, (a, b) in enumerate(zip(found, found[1:], strict=False))) if len(found) > 1 else (99, 0)
        if best[0] == 99:
            return found
        found[best[1] : best[1] + 2] = [found[best[1]] + found[best[1] + 1]]


def test_trie_counts_equal_plain_merging():
    rng = random.Random(1)
    of = tokens.Counts(tokens.Tokenizer(MERGES, most_nodes=500), most=100)
    for _ in range(5000):
        piece = "".join(rng.choices("aabbcc 12x", k=rng.randint(1, 24)))
        assert of[piece] == len(slow_tokens(piece)), piece
    long = "".join(rng.choices("abc", k=2000))
    assert of[long] == tokens.long_count(of.tokenizer, long) == len(of.tokenizer.tokens(long))


def test_runs():
    text = " ab12345 _x--é你 \n  b"
    assert tokens.RUN.findall(text) == [" ab", "123", "45", " ", "_", "x", "--", "é你", " \n  ", "b"]
    assert "".join(tokens.RUN.findall(text)) == text


def test_count_tokens(spark):
    rows = [(1, "ab ab", "s"), (2, None, None), (3, "", "s"), (4, "ab" * 300_000, "s"), (None, "a", "s")]
    df = spark.createDataFrame(rows, "id long, text string, source string").withColumn("n_tokens", F.lit(9))
    found = {r.id: (r.source, r.n_tokens) for r in tokens.count_tokens(df, MERGES, ["source"]).collect()}
    assert found == {1: ("s", 3), 2: (None, 0), 3: ("s", 0), 4: ("s", 150_000), None: ("s", 1)}
    assert tokens.count_tokens(df.limit(0), MERGES).count() == 0
    table = spark.createDataFrame([(1, "c", "d"), (0, "a", "b"), (None, "x", "y")], "merge_rank int, left_piece string, right_piece string")
    assert tokens.read_merges(table) == [("a", "b"), ("c", "d")]


def test_counts_by_distinct_pieces_are_the_same(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("aabbcc 12x_\n", k=rng.randint(0, 300)))) for i in range(80)] + [(100, None), (101, ""), (102, "ab" * 400 + " c")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("piece", F.lit("x"))
    want = {r.id: r.n_tokens for r in tokens.count_tokens(df, MERGES).collect()}
    assert {r.id: r.n_tokens for r in tokens.count_pieces(df, MERGES).collect()} == want and len(want) == 83
    assert tokens.count_pieces(df.limit(0), MERGES).count() == 0


def best_fill(items, room):
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


def test_fill_one_is_best():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 60)
        taken = packing.fill_one(sorted(counts, reverse=True), dict(counts), room)
        total = sum(x * n for x, n in taken.items())
        assert all(n <= counts[x] for x, n in taken.items())
        assert total == best_fill([x for x, n in counts.items() for _ in range(n)], room)


@pytest.mark.parametrize("seed", [1, 2])
def test_pack(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, None, 7, 7, 7, rng.randint(1, 260)]), "x") for i in range(600)] + [(5, 7, "x"), (None, 3, "x")]
    df = spark.createDataFrame(rows, "id long, size int, length string").withColumn("fill", F.lit(1))
    found = packing.pack(df, 100).collect()
    want = {}
    for i, s, _ in rows:
        if i is not None:
            want[i] = max(want.get(i, 0), s or 0)
    total, fills = {}, {}
    for r in found:
        total[r.id] = total.get(r.id, 0) + r.size
        if r.container is not None:
            fills.setdefault(r.container, []).append(r)
    assert total == want and len({(r.id, r.part) for r in found}) == len(found)
    assert all(sum(r.size for r in c) == c[0].fill <= 100 and len({r.fill for r in c}) == 1 for c in fills.values())
    assert sorted(fills) == list(range(len(fills)))
    assert len(fills) <= sum(want.values()) / 100 * 1.02 + 2
    assert all(r.container is None for r in found if want[r.id] == 0)


def test_pack_edges(spark):
    assert packing.pack(spark.createDataFrame([], "id long, size long"), 10).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 0)], "id long, size long"), 10).first().container is None
    hot = packing.pack(spark.range(1000).withColumn("size", F.lit(5)), 10).groupBy("container").count().collect()
    assert len(hot) == 500 and {r["count"] for r in hot} == {2}
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 1)], "id long, size long"), 0)


def test_subset_sum_is_best():
    rng = random.Random(3)
    for _ in range(200):
        lengths = np.array(sorted({rng.randint(1, 25) for _ in range(5)}))
        counts = np.array([rng.randint(1, 3) for _ in lengths])
        target = rng.randint(0, 90)
        taken = mixing.subset_sum(lengths, counts, target)
        limit = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        assert all(n <= limit[x] for x, n in taken.items())
        assert sum(x * n for x, n in taken.items()) == best_fill([x for x, n in limit.items() for _ in range(n)], target)


@pytest.mark.parametrize("window", [60, 10**6])
def test_choose_meets_the_budget(window):
    rng = np.random.default_rng(1)
    lengths = np.arange(1, 200)
    counts = rng.integers(1, 9, 199)
    total = int((lengths * counts).sum())
    for budget in (0, 1, total // 3, total, int(2.4 * total)):
        passes, extra = mixing.choose(lengths, counts, budget, 1, window)
        assert (extra >= 0).all() and (extra <= counts).all()
        assert budget - 200 < passes * total + int((lengths * extra).sum()) <= budget


@pytest.mark.parametrize("scale", [1, 50])
def test_long_documents_fill_the_budget(scale):
    """Of 3.0 and 4.9 million characters, 4.9 fit into 5.0; also beyond the width of the knapsack."""
    passes, extra = mixing.choose(np.array([3_000_000 * scale, 4_900_000 * scale]), np.array([1, 1]), 5_000_000 * scale, 1)
    assert passes == 0 and extra.tolist() == [0, 1]


def test_small_knapsacks_are_exact():
    rng = random.Random(8)
    for _ in range(60):
        lengths = np.array(sorted({rng.randint(1, 40) for _ in range(6)}))
        counts = np.array([rng.randint(1, 2) for _ in lengths])
        budget = rng.randint(1, int((lengths * counts).sum()))
        want = best_fill([x for x, n in zip(lengths.tolist(), counts.tolist(), strict=True) for _ in range(n)], budget)
        for exact in (10**6, 0):
            passes, extra = mixing.choose(lengths, counts, budget, 3, 10, exact)
            got = passes * int((lengths * counts).sum()) + int((lengths * extra).sum())
            assert got == want or exact == 0 and counts.sum() > mixing.FEW


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(1, 40), rng.choice(["A", " a", "B", "b ", None, "other"])) for i in range(900)] + [(0, "x" * 20, "A"), (1000, None, "A"), (1001, "", "B"), (None, "x", "A")]
    df = spark.createDataFrame(rows, "id long, text string, subset string").withColumn("length", F.lit("z"))
    targets = spark.createDataFrame([("A", 0.75, 3), ("A", 0.75, 3), ("B", 0.25, 1), ("C", 0.0, 1), (None, 0.5, 1)], "subset string, target_share double, max_repeat int")
    uses, report = mixing.mix(df, targets)
    shares = {r.subset: r for r in report.collect()}
    assert set(shares) == {"A", "B"}
    assert abs(shares["A"].actual_share - 0.75) < 0.005 and shares["A"].most_uses <= 3 and shares["B"].most_uses == 1
    assert sum(r.uses * r.length for r in uses.collect()) == shares["A"].n_chars + shares["B"].n_chars
    small, _ = mixing.mix(df, targets, total=100)
    assert 60 < sum(r.uses * r.length for r in small.collect()) <= 100
    assert mixing.mix(df.limit(0), targets)[0].count() == 0
