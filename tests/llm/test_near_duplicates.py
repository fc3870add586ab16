import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hyperminhash as hmh
from millrace.llm import near_duplicates as nd
from millrace.llm.components import label_components
from millrace.llm.text import distinct_shingles, words


def shingles(text, size):
    w = words(text)
    return set(zip(*(w[i:] for i in range(size)), strict=False))


def overlap(a, b, size=3):
    x, y = shingles(a, size), shingles(b, size)
    return len(x & y) / len(x | y) if x | y else 0.0


def texts(seed=1, n=150):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choices(names, k=rng.randint(30, 120))) for _ in range(n)]
    out = dict(enumerate(base))
    for i in range(0, n, 3):
        w = base[i].split()
        for k in range(rng.randint(1, 2)):
            edited = list(w)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = rng.choice(names)
            out[1000 + 10 * i + k] = " ".join(edited)
    return out


def test_links_against_brute_force(spark):
    held = texts()
    df = spark.createDataFrame(list(held.items()), "id long, text string")
    members, linked = nd.links(df, size=3, threshold=0.6)
    got = {(r.id_a, r.id_b) for r in nd.pairs(members, linked).collect()}
    ids = sorted(held)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if overlap(held[a], held[b]) >= 0.6}
    assert got <= want and len(got) >= 0.98 * len(want) > 20
    groups = {r.id: r.group_id for r in nd.groups(df, size=3, threshold=0.6).collect()}
    assert all(groups[a] == groups[b] for a, b in got) and set(groups) == set(held)


def test_edge_rows(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, "one two", "x"), (4, "a b c d e", "x"), (4, "a b c d e", "x"), (5, "A b, c d e!", "x"), (None, "a b c d e", "x"), (6, long, "x"), (7, long + " more", "x"), (8, "a b c", "x")]
    df = spark.createDataFrame(rows, "id long, text string, class string").withColumn("rep", F.lit(1))
    members, linked = nd.links(df, size=3, threshold=0.5)
    assert {(r.id_a, r.id_b) for r in nd.pairs(members, linked).collect()} == {(4, 5), (6, 7)}
    assert {r.id for r in members.collect()} == {4, 5, 6, 7, 8}


def test_hot_group_of_copies(spark):
    rows = [(i, "the same text of some words again" if i % 3 == 0 else f"text number {i} of its own {i * 7} words {i * 13}") for i in range(300)]
    members, linked = nd.links(spark.createDataFrame(rows, "id long, text string"), size=3, threshold=0.8)
    assert linked.count() == 0
    assert members.groupBy("rep").count().where("count = 100").count() == 1


def test_hot_bands(spark, monkeypatch):
    """Near copies of a template share hot bands: all links come out, and groups find every member with few candidates."""
    monkeypatch.setattr(nd, "HOT", 8)
    rng = random.Random(5)
    template = [f"t{i}" for i in range(120)]
    held = {}
    for i in range(90):
        w = list(template)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        held[i] = " ".join(w)
    # Half of the template with words of their own: near each other, far from the rest, though they share its bands.
    other = [f"o{i}" for i in range(90)]
    for i in range(90, 120):
        w = template[:40] + other
        w[100 + rng.randrange(20)] = f"x{rng.randrange(10**6)}"
        held[i] = " ".join(w)
    df = spark.createDataFrame(list(held.items()), "id long, text string")
    ready = nd.Prepared(df, 3, 0.6, 48, 4, 4.0)
    assert ready.shared.where("n > 8").select("key").distinct().count() > 10
    want = {(a, b) for a in held for b in held if a < b and overlap(held[a], held[b]) >= 0.6}
    got = {(r.a, r.b) for r in nd.links(df, size=3, threshold=0.6)[1].collect()}
    assert got <= want and len(got) >= 0.99 * len(want)
    found = {r.id: r.group_id for r in nd.groups(df, size=3, threshold=0.6).collect()}
    assert set(found.values()) == {0, 90} and all(found[i] == (0 if i < 90 else 90) for i in held)
    few = ready.cold().unionByName(ready.stars()).distinct().count()
    assert few < 0.7 * ready.cold().unionByName(ready.hot()).distinct().count()


def test_small_sets_lose_no_pair(spark):
    rng = random.Random(2)
    held = {}
    for i in range(120):  # each text beside one whose first or last word is another, or that lacks it
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 14))]
        held[2 * i] = " ".join(w)
        held[2 * i + 1] = " ".join(rng.choice([w[1:], w[:-1], ["x", *w[1:]], [*w[:-1], "x"], [*w, f"y{i}"]]))
    df = spark.createDataFrame(list(held.items()), "id long, text string")
    got = {(r.id_a, r.id_b) for r in nd.pairs(*nd.links(df, size=3, threshold=0.5)).collect()}
    want = {(a, b) for a in held for b in held if a < b and overlap(held[a], held[b]) >= 0.5}
    assert got == want and len(want) > 15


def test_repeated_ids_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "id long, text string")
    found = {r.id: r.group_id for r in nd.groups(df, size=3, threshold=0.6).collect()}
    assert set(found) == {1, 2, 3} and sorted(found.values()) in ([1, 1, 2], [1, 1, 3])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id long, text string")
    members, linked = nd.links(empty, size=3, threshold=0.5)
    assert nd.pairs(members, linked).count() == 0 and nd.groups(empty, size=3, threshold=0.5).count() == 0


def test_estimates_follow_jaccard():
    rng = np.random.default_rng(0)
    for shared in (0, 300, 600, 900):
        common = rng.integers(0, 2**48, shared, dtype=np.uint64)
        a, b = (np.sort(np.concatenate((common, rng.integers(0, 2**48, 1000 - shared, dtype=np.uint64)))) for _ in range(2))
        registers = hmh.sketch(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 512)
        equal = np.array([(registers[0] == registers[1]).sum()])
        found = hmh.corrected_jaccard(equal, np.array([1000]), np.array([1000]), 512)[0]
        assert abs(found - shared / (2000 - shared)) < 0.09


def test_small_sets_are_comparable():
    hashes, starts = distinct_shingles(["a b c", "a b c", "x y z", ""], 3)
    r = hmh.sketch(hashes, starts, 64)
    assert (r[0] == r[1]).all() and (r[0] == r[2]).mean() < 0.2 and (r[3] == 0).all()


def test_chat_text(spark):
    df = spark.createDataFrame([([("System", "s"), ("user", "a"), (None, None), ("assistant", "b")],), (None,)], "m array<struct<role:string,content:string>>")
    assert [r[0] for r in df.select(nd.chat_text(F.col("m"))).collect()] == ["a\n\nb", None]


@pytest.mark.parametrize("shape", ["chain", "star", "mixed"])
def test_components(spark, shape):
    rng = random.Random(3)
    links = {"chain": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 60)], "mixed": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]}[shape]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r.id: r.label for r in label_components(spark.createDataFrame(links, "a long, b long")).collect()}
    inside = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: find(x) for x in inside}
