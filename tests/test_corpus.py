import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import corpus as C
from millrace.operators import profiling as P
from millrace.ranking import salted_rank


def documents(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaaabbc"), rng.randint(1, 60)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, size long")


def interleave(rows, target):
    """One document of each source a round, until the target is reached; the crossing one stays."""
    by = {}
    for doc, source, size in rows:
        by.setdefault(source, []).append((doc, size))
    queues, kept, total = [by[s] for s in sorted(by)], [], 0
    while any(queues):
        for q in queues:
            if not q:
                continue
            doc, size = q.pop(0)
            kept.append(doc)
            total += size
            if total >= target:
                return kept
    return kept


@pytest.mark.parametrize("target", [0, 1, 500, 3000, 10**9])
@pytest.mark.parametrize("parts", [1, 7])
def test_balanced_budget(spark, target, parts):
    rows, df = documents(spark)
    found = C.balanced_budget(df.repartition(parts), "source", ["doc_id"], "size", target, least=1).orderBy("seq").collect()
    assert [r.doc_id for r in found] == interleave(rows, target)
    assert [r.seq for r in found] == list(range(1, len(found) + 1))


def test_documents_without_a_source_are_a_source(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "a", 5), (3, None, 5), (4, "b", 5)], "doc_id long, source string, size long")
    assert [(r.doc_id, r.round, r.seq) for r in C.balanced_order(df, "source", ["doc_id"]).orderBy("seq").collect()] == [(1, 1, 1), (2, 1, 2), (4, 1, 3), (3, 2, 4)]
    assert C.balanced_budget(df, "source", ["doc_id"], "size", 10**6, least=1).count() == 4


def test_characters(spark):
    df = spark.createDataFrame([("aab",), (None,), ("",), ("é\U0001f600a\x00",)], "t string").repartition(3)
    assert {r.character: r.n for r in P.characters(df, "t").collect()} == {"a": 3, "b": 1, "é": 1, "\U0001f600": 1, "\x00": 1}
    assert P.characters(df.limit(0), "t").count() == 0


def test_budget_of_nothing(spark):
    _, df = documents(spark)
    assert C.budget_cut(df.limit(0), ["doc_id"], "size", 10).count() == 0


def test_clean(spark):
    df = spark.createDataFrame([(1, " \t" + "x" * 5 + "\n"), (2, "x" * 4), (3, None), (4, ""), (5, "\u3000" + "y" * 9)], "i int, text string")
    assert [tuple(r) for r in C.clean(df, min_chars=5, max_chars=6).orderBy("i").collect()] == [(1, "xxxxx"), (5, "yyyyyy")]


def test_subsets(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, subset string")
    assert [r.i for r in C.in_subsets(df, ["a"]).collect()] == [1]
    assert C.in_subsets(df, None).count() == 3


def test_shards(spark):
    _, df = documents(spark, 45)
    kept = C.budget_cut(df, ["doc_id"], "size", 10**9)
    assert kept.groupBy(C.shard_of(F.col("seq"), 20).alias("s")).count().orderBy("s").collect()[-1]["count"] == 5
    stats = C.shard_stats(kept, "size", start=3, docs=20).first()
    assert (stats.docs, stats.shards, stats.next_index) == (45, 3, 6)
    empty = C.shard_stats(kept.limit(0), "size").first()
    assert (empty.docs, empty.chars, empty.shards) == (0, 0, 0)


def test_limit_per_source(spark):
    _, df = documents(spark)
    found = C.limit_per_source(df, "source", ["doc_id"], 3).groupBy("source").count().collect()
    assert {r["count"] for r in found} == {3}
    with pytest.raises(ValueError):
        C.limit_per_source(df, "source", ["doc_id"], 0)


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11])
def test_percentile_rule(spark, n):
    df = spark.createDataFrame([(i,) for i in range(n)], "v long")
    found = {r.share: r.value for r in P.percentiles(df, "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert found == {q: sorted(range(n))[min(n - 1, int(q * n))] for q in (0.0, 0.5, 0.95, 1.0)}
    row = P.length_stats(df, "v").first()
    assert (row.n, row.min, row.max, row.mean) == (n, 0, n - 1, (n - 1) // 2)


def test_stats_of_nothing(spark):
    assert P.length_stats(spark.createDataFrame([], "v long"), "v").count() == 0


def test_trim_bibliography(spark):
    df = spark.createDataFrame([(r"a \bibliography{x} b",), ("plain bibliography",), (None,)], "t string")
    assert [r[0] for r in df.select(C.trim_bibliography(F.col("t"))).collect()] == ["a ", "plain bibliography", None]


def test_salted_rank_is_a_rank(spark):
    rows = [(i, "hot" if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string")
    found = salted_rank(df, ["k"], F.xxhash64("id"), ["id"], "place").collect()
    assert sorted(r.place for r in found if r.k == "hot") == list(range(1, 201))
    assert sorted(r.place for r in found if r.k is None) == list(range(1, 101))
