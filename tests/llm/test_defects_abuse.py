import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import abuse
from millrace.llm import defect_examples as E
from millrace.llm import pair_defects as P
from millrace.llm.crf import Chains, Field

NAMES = "Mira Tomas Odile Henk Priya Sanna Luca Wanda Bako Ines".split()
THINGS = "lamps boxes coins plants books chairs bottles stamps ropes cards".split()
STEPS = ["First, {a} {o} {b} = {c}.", "Now {a} {o} {b} = {c} {t}.", "Then we find {a} {o} {b} = {c}.", "{n} now has {a} {o} {b} = {c}."]
ENDS = ["The final answer is $\\boxed{{{c}}}$.", "Answer: {c}", "#### {c}", "So the result is {c}.", "{c}", "\\boxed{{{c}}}"]
GERMAN = ("Bei {n} liegen {a} Kisten. Dann kommen {b} dazu. Wie viele Kisten sind es jetzt?", "Zuerst rechnen wir {a} + {b} = {c}.\nDas Ergebnis ist also {c}.")


def sound(rng):
    """A question with a worked solution, or with a bare result."""
    a, b, n, t = rng.randint(20, 900), rng.randint(2, 19), rng.choice(NAMES), rng.choice(THINGS)
    if rng.random() < 0.06:
        return GERMAN[0].format(a=a, b=b, n=n), GERMAN[1].format(a=a, b=b, c=a + b), False
    question = f"{n} keeps {a} {rng.choice(['red', 'old', 'round'])} {t} at the {rng.choice(['shop', 'mill', 'school'])}. {rng.choice(['Then', 'Later'])} {b} were {rng.choice(['sold', 'lost'])}, and {b + 1} more came. How many {t} does {n} have now?"
    if rng.random() < 0.5:
        return question, rng.choice(["{}", "{}", "${}$", "\\boxed{{{}}}", "{} " + t]).format(a + 1), True
    c = a - b
    said = [rng.choice(STEPS).format(a=a, o="-", b=b, c=c, t=t, n=n), rng.choice(STEPS).format(a=c, o="+", b=b + 1, c=a + 1, t=t, n=n), rng.choice(ENDS).format(c=a + 1)]
    return question, rng.choice(["\n", "\n"]).join(said[:2]) + "\n" + said[2], False


def world(n, seed):
    rng = random.Random(seed)
    return [sound(rng) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return P.fit(world(2500, 1))


QUESTION = "Mira keeps 12 red lamps at the shop. Then 5 were sold, and 6 more came. How many lamps does Mira have now?"
CASES = [
    (QUESTION, "First, 12 - 5 = 7.\nThen we find 7 + 6 = 13.\nThe final answer is $\\boxed{13}$.", False, None),
    (QUESTION, "13", False, None),
    (QUESTION, QUESTION + "\nFirst, 12 - 5 = 7.\nNow 7 + 6 = 13 lamps.\nSo the result is 13.", False, None),
    (QUESTION, None, False, "empty"),
    (QUESTION, " ​\n", False, "empty"),
    (QUESTION, "\\boxed{}", True, "empty"),
    (QUESTION, "N/A", False, "empty"),
    (QUESTION, "The final answer is $\\boxed{}$.", False, "empty"),
    (QUESTION, "First, 12 - 5 = 7. Now, using the", False, "truncated"),
    (QUESTION, "First, 12 - 5 = 7.\nThen we find 7 +", False, "truncated"),
    (QUESTION, "\\frac{3}{", True, "truncated"),
    (QUESTION, "I'm sorry, but I can't help with that.", False, "refusal"),
    (QUESTION, "Question: " + QUESTION.upper(), False, "copy"),
    (QUESTION, QUESTION, True, "copy"),
    (QUESTION, "Zuerst rechnen wir 12 - 5 = 7.\nDaraus folgt 7 + 6 = 13.\nDas Ergebnis ist also 13.", False, "language"),
    (QUESTION, "四十二", True, "language"),
    (QUESTION, "siebenundzwanzig Kisten", True, "language"),
    (QUESTION, "no real solution", True, None),
    (None, "5", True, None),
    (GERMAN[0].format(n="Mira", a=12, b=5), GERMAN[1].format(a=12, b=5, c=17), False, None),
]


def test_defects(spark, model):
    rows = [("t", i, q, r, s) for i, (q, r, s, _) in enumerate(CASES)] * 2 + [("t", 99, "q " * 100_000, "12 = " * 50_000, False)]
    df = spark.createDataFrame(rows, "table_name string, id long, question string, response string, short boolean").withColumn("defect", F.lit("x"))
    found = P.find_defects(df, model).collect()
    assert len(found) == len({r.id for r in found})
    assert {r.id: r.defect for r in found if r.id < 99} == {i: c[3] for i, c in enumerate(CASES) if c[3]}
    empty = df.limit(0)
    assert P.find_defects(empty, P.train(empty)).count() == 0
    few = P.find_defects(df, P.train(df)).collect()
    assert {r.id for r in few} >= {i for i, c in enumerate(CASES) if c[3] == "empty"}


def test_tags(model):
    assert model.tags(QUESTION, CASES[0][1]) == ["answer"] * 3
    assert set(model.tags(QUESTION, "First, 12 - 5 = 7.\nThen we find 7 +")) == {"unfinished"}
    assert model.tags(QUESTION, QUESTION + "\nFirst, 12 - 5 = 7.\nNow 7 + 6 = 13 lamps.\nSo the result is 13.") == ["echo"] * 3 + ["answer"] * 3
    assert model.tags(QUESTION, "The final answer is 13.\nThen we", False)[-1] == "unfinished"
    assert model.tags(QUESTION, None) == []


def rates(model, rows):
    """(share of defective pairs found with their defect, share of sound pairs among those flagged)."""
    found = model.defects([r[:3] for r in rows])
    bad = [i for i, r in enumerate(rows) if r[3]]
    flagged = [i for i, f in enumerate(found) if f]
    return sum(found[i] == rows[i][3] for i in bad) / len(bad), sum(rows[i][3] is None for i in flagged) / max(1, len(flagged))


def test_refusals_of_wordings_that_fitting_never_saw():
    """Each third of the wordings is judged by a model that was fitted on the other two."""
    found = []
    for fold in range(3):
        kept = {k: [x for i, x in enumerate(v) if i % 3 != fold] for k, v in E.REFUSALS.items()}
        model = P.fit(world(1500, 1), kept)
        held = [x.replace("*", "lamps") for i, x in enumerate(E.REFUSALS["en"]) if i % 3 == fold]
        rows = [(*sound(random.Random(i))[:1], x, False, "refusal") for i, x in enumerate(held * 4)] + [(*r, None) for r in world(500, 7)]
        found.append(rates(model, rows))
    recall, wrong = np.mean(found, axis=0)
    assert recall >= 0.9 and wrong <= 0.05, found


def test_held_out_defects(model):
    rng = random.Random(12)
    rows = []
    for q, r, short in world(1500, 13):
        kind = rng.randrange(8)
        if kind == 0 and not short:
            r = r[: rng.randint(4, r.rfind("\n"))].rstrip()
            rows.append((q, r + (" and then" if r[-1] in ".0123456789" else ""), short, "truncated"))
        elif kind == 1:
            w = q.split()
            del w[rng.randrange(len(w))]
            rows.append((q, rng.choice(["", "Given: "]) + " ".join(w), short, "copy"))
        elif kind == 2 and not short and q.isascii() and "Kisten" not in q:
            rows.append((q, GERMAN[1].format(a=5, b=7, c=12).replace("Zuerst rechnen wir", "Als Nächstes haben wir dann"), short, "language"))
        else:
            rows.append((q, r, short, None))
    recall, wrong = rates(model, rows)
    assert recall >= 0.95 and wrong <= 0.05, (recall, wrong)


def test_chat_pair(spark):
    schema = "i int, m array<struct<role:string,content:string>>"
    rows = [(1, [("User", "q1"), ("assistant", "a1"), ("user", "q2"), ("Assistant", "a2")]), (2, [("user", "q")]), (3, None), (4, [("user", "q"), ("assistant", None)]), (5, [])]
    q, r = P.chat_pair(F.col("m"))
    found = spark.createDataFrame(rows, schema).orderBy("i").select(q, r).collect()
    assert [tuple(x) for x in found] == [("q2", "a2"), ("q", None), (None, None), ("q", None), (None, None)]


def test_field_decodes_the_best_path_and_learns():
    rng = np.random.default_rng(0)
    field = Field(6, 3)
    field.weights, field.moves = rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    sequences = [[[int(x)] for x in rng.integers(0, 6, n)] for n in (1, 4, 3, 5)]
    chains = Chains.of(sequences)
    found = field.decode(chains)
    for s, first in zip(sequences, chains.first, strict=True):
        def score(path, s=s):
            return sum(field.weights[c[0], y] for c, y in zip(s, path, strict=True)) + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False))

        paths = [tuple(np.unravel_index(i, (3,) * len(s))) for i in range(3 ** len(s))]
        assert tuple(found[first : first + len(s)]) == max(paths, key=score)
    labels = np.array([c[0] % 3 for s in sequences for c in s])
    fresh = Field(6, 3)
    fresh.fit(chains, labels, 80)
    assert (fresh.decode(chains) == labels).all()


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(1)
    chains = Chains.of([[[0, 1], [2]], [[1], [0], [2, 1]]])
    labels, weight = np.array([0, 1, 1, 0, 1]), np.array([1.0, 1.0])
    field = Field(3, 2)
    field.weights, field.moves = rng.normal(size=(3, 2)), rng.normal(size=(2, 2))

    def likelihood():
        emit, total = field.emissions(chains), 0.0
        for first, n in zip(chains.first, chains.lengths, strict=True):
            def path_score(path, first=first):
                return sum(emit[first + i, y] for i, y in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False))

            every = [path_score(np.unravel_index(i, (2,) * n)) for i in range(2**n)]
            total += path_score(labels[first : first + n]) - np.log(np.exp(every).sum())
        return total / 2

    gains = field.gradient(chains, labels, weight)
    for parameter, gain in zip((field.weights, field.moves), gains, strict=True):
        for at in np.ndindex(parameter.shape):
            parameter[at] += 1e-5
            up = likelihood()
            parameter[at] -= 2e-5
            down = likelihood()
            parameter[at] += 1e-5
            assert gain[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def corpus(seed=3, n=500):
    rng = random.Random(seed)
    nouns, verbs = ["graph", "ring", "field", "lattice", "module", "kernel"], ["bounds", "covers", "splits", "extends", "lifts"]
    insults = ["{} you stupid worthless clown", "what a pathetic brainless idiot", "shut your mouth you filthy idiot {}", "i hope you stupid clown rot"]

    def calm():
        return f"The {rng.choice(nouns)} {rng.choice(verbs)} every {rng.choice(nouns)} of degree {rng.randint(1, 99)}."

    rows = []
    for i in range(n):
        bad = rng.random() < 0.2
        parts = [calm() for _ in range(rng.randint(3, 9))]
        if bad:
            parts.insert(rng.randrange(len(parts)), rng.choice(insults).format(rng.choice(nouns)).replace("idiot", rng.choice(["idiot", "1d10t", "id​iot", "IDIOT"])) + "!")
        rows.append((i, rng.choice([" ", "\n"]).join(parts), bad))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    records = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "id long, text string, bad string")
    rng = random.Random(1)
    labels = [(i, rng.choice(["none", "abusive"]) if rng.random() < 0.03 else "Abusive " if bad else "none", "r") for i, _, bad in rows[:250]] + [(0, None, "r"), (None, "none", "r"), (1, "what", "r")]
    model = abuse.train(records, spark.createDataFrame(labels, "id long, category string, text string"))
    found = {r.id: r.score >= 0.5 for r in abuse.score(records, model, ["bad"]).collect()}
    held = rows[250:]
    hits = sum(found[i] and bad for i, _, bad in held)
    assert hits >= 0.9 * sum(bad for *_, bad in held) and hits >= 0.9 * sum(found[i] for i, *_ in held)


def test_abuse_edges(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "calm " * 30), (3, "calm " * 30), (4, "x" * 9000), (None, "a")]
    records = spark.createDataFrame(rows, "id long, text string")
    labels = spark.createDataFrame([(3, "none")], "id long, category string")
    found = abuse.score(records, abuse.train(records, labels)).collect()
    assert len(found) == 6 and all(r.score < 0.5 for r in found) and {r.score for r in found if r.id in (1, 2)} == {0.0}
    assert abuse.score(records.limit(0), abuse.train(records.limit(0), labels.limit(0))).count() == 0
    monkeypatch.setattr(abuse, "SLICE", 100)
    text = "one two three\n" * 40 + "y" * 350
    assert "".join(abuse.sliced(text)) == text and max(map(len, abuse.sliced(text))) <= 100 and abuse.sliced(None) == [""]
