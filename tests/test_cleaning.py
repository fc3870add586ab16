import pytest
from pyspark.sql import functions as F

from millrace.functions import cleaning as X


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    "text, want",
    [
        ("a <|im_end|> b", "a"), ("a\nuser: b<|im_end|>", "a"), ("x \\boxed{1} y\nmore", "x \\boxed{1} y"), ("tail \u4f60\u597d\u3002\ufffd ", "tail"), ("plain", "plain"), ("", ""), (None, None), ("\\boxed{1}", "\\boxed{1}"),
    ],
)
def test_clean(spark, text, want):
    assert one(spark, text, X.clean_solution) == want


def test_chunks(spark):
    text = "abcdefg" * 9
    found = one(spark, text, lambda c: X.chunks(c, 10))
    assert "".join(found) == text and [len(x) for x in found] == [10] * 6 + [3]
    assert one(spark, "", lambda c: X.chunks(c, 10)) == []
    assert one(spark, None, lambda c: X.chunks(c, 10)) in (None, [])
    with pytest.raises(ValueError):
        X.chunks(F.lit("a"), 0)


def test_truncate_at_box(spark):
    assert one(spark, r"a \boxed{\frac{1}{2}} b", X.truncate_at_box) == r"a \boxed{\frac{1}"
    assert one(spark, r"\boxed{1", X.truncate_at_box) == r"\boxed{1"


@pytest.mark.parametrize(
    "text, want",
    [
        (r"a \boxed{\frac{1}{2}} b", r"a \boxed{\frac{1}{2}}"), (r"\boxed{1", r"\boxed{1"), ("none", "none"), (None, None), ("", ""), (r"\boxed{}x", r"\boxed{}"),
        (r"\boxed{" + "{" * 9 + "}" * 9 + "} more", r"\boxed{" + "{" * 9 + "}" * 9 + "}"),
    ],
)
def test_truncate_at_the_brace_that_closes_the_box(spark, text, want):
    assert one(spark, text, lambda c: X.truncate_at_box(c, balanced=True)) == want
