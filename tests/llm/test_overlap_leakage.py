import random

import numpy as np
import pytest

from millrace.llm import leakage, overlap
from millrace.llm.text import words


def triples(text):
    w = words(text)
    return set(zip(w, w[1:], w[2:], strict=False))


def world(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    queries = {i: " ".join(rng.choices(vocabulary, k=rng.randint(3, 30))) for i in range(40)}
    texts = {}
    for j in range(200):
        filler = " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))
        passage = queries[rng.randrange(40)].split() if j % 2 else []
        for _ in range(rng.randint(0, 6) if passage else 0):
            passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
        texts[100 + j] = f"{filler if j % 4 else ''} {' '.join(passage).upper()}, {filler[:40]}"
    return queries, texts


def frames(spark, queries, texts):
    return spark.createDataFrame(list(queries.items()), "id long, text string"), spark.createDataFrame(list(texts.items()), "id long, text string")


@pytest.mark.parametrize("chars", [10**6, 300])
def test_overlaps_against_brute_force(spark, chars):
    queries, texts = world()
    q, t = frames(spark, queries, texts)
    got = {(r.query_id, r.id): (r.overlap, r.coverage) for r in overlap.overlaps(q, t, threshold=0.2, block_chars=chars).collect()}
    want = {}
    for a, x in queries.items():
        for b, y in texts.items():
            s, u = triples(x), triples(y)
            if s | u and len(s & u) / len(s | u) >= 0.2:
                want[a, b] = len(s & u) / len(s | u)
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want) and len(want) > 10
    assert all(0 < v[1] <= 1 for v in got.values())


@pytest.mark.parametrize("chars", [10**6, 300])
def test_leaks_against_brute_force(spark, chars):
    queries, texts = world(6)
    q, t = frames(spark, queries, texts)
    got = {(r.query_id, r.id): r.coverage for r in leakage.leaks(q, t, aligned=2, block_chars=chars).collect()}
    want = {(a, b): len(triples(x) & triples(y)) / len(triples(x)) for a, x in queries.items() for b, y in texts.items() if triples(x) and len(triples(x) & triples(y)) >= 0.5 * len(triples(x))}
    assert got == pytest.approx(want) and len(want) > 20


def test_alignment_decides_on_paraphrases(spark):
    """Copies with every fourth word changed keep under half of the triples; only their alignment shows them."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    queries = {i: " ".join(rng.choices(vocabulary, k=24)) for i in range(30)}
    texts = {}
    for i, q in queries.items():
        w = [x if k % 4 != 2 or k == 2 else rng.choice(vocabulary) for k, x in enumerate(q.split())]
        texts[100 + i] = " ".join(rng.choices(vocabulary, k=50) + w + rng.choices(vocabulary, k=50))
        texts[200 + i] = " ".join(rng.choices(vocabulary, k=60) + q.split()[:3] + rng.choices(vocabulary, k=60))
    q, t = frames(spark, queries, texts)
    found = {(r.query_id, r.id): r for r in leakage.leaks(q, t).collect()}
    assert set(found) == {(i, 100 + i) for i in queries} and all(r.coverage < 0.5 <= r.aligned for r in found.values())
    assert leakage.leaks(q, t, aligned=2).count() == 0


def test_alignments_grow_with_hits_not_with_passages():
    item, place, length, cuts = np.array([0, 0, 1, 0]), np.array([5, 8, 5, 95]), np.array([10, 10, 4, 10]), np.array([40, 60])
    who, begin, end = leakage._windows(item, place, length, cuts, 3)
    assert who.tolist() == [0, 0, 1] and begin.tolist() == [0, 77, 0] and end.tolist() == [29, 100, 20]


def test_alignment_against_a_table():
    rng = random.Random(1)
    items = [np.array(rng.choices(range(1, 6), k=rng.randint(1, 12)), np.int32) for _ in range(60)]
    passages = [np.array(rng.choices(range(0, 6), k=rng.randint(1, 20)), np.int32) for _ in range(60)]

    def table(a, b):
        h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                step = leakage.MATCH if a[i - 1] == b[j - 1] else leakage.MISMATCH
                h[i, j] = max(0, h[i - 1, j - 1] + step, h[i - 1, j] - leakage.SPACE, h[i, j - 1] - leakage.SPACE)
                best = max(best, h[i, j])
        return best

    score, same = leakage.align(items, passages)
    assert score.tolist() == [table(a, b) for a, b in zip(items, passages, strict=True)]
    assert same.tolist() == [sum(x in set(b.tolist()) for x in a.tolist()) for a, b in zip(items, passages, strict=True)]


@pytest.mark.parametrize("run", [overlap.overlaps, leakage.leaks])
def test_edges(spark, run):
    schema = "id long, text string, query_id string, hits int"
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "two words", "x", 1), (4, "the cat sat on the mat", "x", 1), (4, "the cat sat on the mat", "x", 1), (None, "the cat sat", "x", 1)]
    long = [(9, "The cat sat on the mat. " + "filler " * 200_000, "x", 1)]
    q, t = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + long, schema)
    found = [(r.query_id, r.id) for r in run(q, t).collect()]
    assert len(found) == len(set(found)) and (4, 4) in found and {a for a, _ in found} == {4}
    assert run(q.limit(0), t).count() == 0 and run(q, t.limit(0)).count() == 0 and run(q.where("text is null"), t).count() == 0
