import random

import numpy as np
import pytest

from millrace.llm import splitting as S


def greedy(text, capacity, overlap, fill=0.5):
    """The cuts one after the other, straight from the rules."""
    n, step, ends, at = len(text), capacity - overlap, [], overlap
    places, ranks, _ = S.boundaries(text)
    places, ranks = places.tolist(), ranks.tolist()
    while True:
        limit = at + step
        if limit >= n:
            return [*ends, n]
        for level, least in ((1, int(step * fill)), (2, int(step * fill)), (3, 0)):
            some = [p for p, r in zip(places, ranks, strict=True) if r <= level and at + least < p <= limit and p < n]
            if some:
                at = some[-1]
                break
        else:
            at = limit
        ends.append(at)


def make(rng, n):
    parts = [" ", "\n", "\n\n", ". ", ", ", "。", "word", "x" * rng.randint(1, 60), "\U0001d53d"]
    text = ""
    while len(text) < n:
        text += rng.choice(parts)
    return text


@pytest.mark.parametrize("capacity, overlap", [(50, 10), (20, 0), (31, 30)])
def test_cuts_equal_the_greedy_walk(capacity, overlap):
    rng = random.Random(capacity)
    for _ in range(150):
        text = make(rng, rng.randint(capacity + 1, 600))
        stops, _, _ = S.cuts(text, capacity, overlap)
        assert stops.tolist() == greedy(text, capacity, overlap)


def test_round_trip(spark):
    rng = random.Random(8)
    rows = [(i, make(rng, rng.randint(1, 900)), "e") for i in range(60)] + [(100, None, "e"), (101, "", "e"), (102, "y" * 5000, "e"), (103, "a b " * 100_000, "e")]
    df = spark.createDataFrame(rows, "id long, text string, ends string")
    held = {}
    for r in S.split_texts(df, 100, 20).orderBy("id", "piece_no").collect():
        held.setdefault(r.id, []).append(r)
    texts = {r[0]: r[1] for r in rows}
    assert set(held) == {i for i, t in texts.items() if t and len(t) > 100}
    for i, found in held.items():
        assert [p.piece_no for p in found] == list(range(len(found))) and all(len(p.text) <= 100 for p in found)
        assert found[0].text + "".join(p.text[20:] for p in found[1:]) == texts[i]
        assert all(a.text[-20:] == b.text[:20] for a, b in zip(found, found[1:], strict=False))


def test_forced_cuts_show_long_stretches():
    rng = random.Random(9)
    for _ in range(300):
        text = make(rng, rng.randint(60, 300)) + "z" * rng.choice([0, 20, 45, 70]) + make(rng, rng.randint(0, 100))
        if len(text) > 50:
            _, kinds, run = S.cuts(text, 50, 10)
            assert run <= 50 or (kinds == 4).any()


def test_longest_run():
    for text in ("", "abc", "a b", "x" * 9 + "　" + "y" * 4, " ", "；" * 3):
        want = max(map(len, __import__("re").split(r"[\s.!?;:,。！？；：，]", text)))
        assert S.boundaries(text)[2] == want


def test_limits(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert S.piece_spans(df, 10, 2).count() == 0
    with pytest.raises(ValueError):
        S.piece_spans(df, 10, 10)


def test_surrogates():
    assert S.cuts("a\ud800 " * 50, 40, 5)[0][-1] == 150 and isinstance(np.int64(1), np.integer)
