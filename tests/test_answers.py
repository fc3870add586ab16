import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import answers as A


def one(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_last_boxed_cases(spark):
    cases = {
        r"so \boxed{7}": "7",
        r"\boxed{1} then \boxed{ \frac{3}{4} }": r"\frac{3}{4}",
        r"\boxed{a}b \boxed{un": None,
        r"\fbox{9} and \boxed{open": "9",
        r"\boxed{}": "",
        r"\boxed {x}": "x",
        "no box": None,
        "": None,
        "\\boxed{" + "{" * 12 + "z" + "}" * 12 + "}": "{" * 12 + "z" + "}" * 12,
    }
    assert one(spark, list(cases), A.last_boxed) == list(cases.values())


def scan(text):
    """Independent scanner: last mark, next brace, balanced close."""
    for mark in ("\\boxed", "\\fbox"):
        if mark not in text:
            continue
        tail = text.split(mark)[-1]
        if "{" not in tail:
            continue
        inner, depth = tail[tail.index("{") + 1 :], 1
        for i, c in enumerate(inner):
            depth += (c == "{") - (c == "}")
            if depth == 0:
                return inner[:i].strip()
    return None


def test_last_boxed_against_a_scanner(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["\\boxed", "\\fbox", "{", "}", "a", " ", "{{", "}}", "1"], k=rng.randint(0, 14))) for _ in range(4000)]
    assert one(spark, texts, A.last_boxed) == [scan(t) for t in texts]


@pytest.mark.parametrize(
    "text, answer",
    [
        ("steps\n#### 1,250", "1,250"),
        ("#### 12. end", "12."),
        ("#### 3 then #### 4", "3"),
        ("The answer is 42 or 43", "42"),
        ("Final answer: seven cats.\nBye", "seven cats"),
        ("answer is 5. No, the answer = \\fbox{6}", "6"),
        ("x = 3 = 9 .", "9"),
        ("3 and then -4.5%", "-4.5%"),
        ("nothing here", None),
        ("", None),
        (None, None),
        ("my answers", "s"),
        ("\u0664\u0662", "\u0664\u0662"),
    ],
)
def test_extract_answer(spark, text, answer):
    assert one(spark, [text], A.extract_answer) == [answer]


def test_gsm_parts(spark):
    text = "2 + 3 = <<2+3=5>>5\n#### 1,005"
    assert one(spark, [text], A.gsm_final) == ["1005"]
    assert one(spark, [text], A.gsm_steps) == ["2 + 3 = 5"]
