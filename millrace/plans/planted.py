"""Queries over planted texts, which are rendered from the numbers of `eval_row`; their SQL works on those numbers and never reads a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arithmetic as M
from millrace.functions import comparison as N
from millrace.functions.answers import extract_answer
from millrace.functions.symbolic import with_comparison, with_equivalence
from millrace.operators import evaluation as E
from millrace.operators import grading as G
from millrace.tables import table

# The numbers behind every text: an id's remainders, stated once for both engines.
NUMBERS = {"a": "CAST(eval_id % 89 + 11 AS BIGINT)", "b": "CAST(eval_id % 13 + 2 AS BIGINT)", "c": "CAST(eval_id % 7 + 3 AS BIGINT)"}
_SELECT = ", ".join(f"{sql} AS {name}" for name, sql in NUMBERS.items())
_ROWS = f"rows AS (SELECT eval_id, {_SELECT} FROM eval_row)"


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_row").selectExpr("eval_id", *[f"{sql} AS {name}" for name, sql in NUMBERS.items()])


def _text(form: str) -> Column:
    """A text with the numbers put in for {a}, {b} and {c}."""
    out = F.lit(form)
    for name in NUMBERS:
        out = F.replace(out, F.lit("{" + name + "}"), F.col(name).cast("string"))
    return out


def _variants(df: DataFrame, forms: list[str]) -> DataFrame:
    """Each row with each form: `kind` and `text`."""
    return df.withColumn("v", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), _text(f).alias("text")) for i, f in enumerate(forms)]))).select(*df.columns, "v.kind", "v.text")


def _cases(values: list[str], key: str = "kind") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


#: Expressions and their values as SQL over whole numbers; // and % round down, as all operands are positive or made so.
EXPRESSIONS = [
    ("({a} + {b}) * {c}", "(a + b) * c"), ("{a} // {b}", "a // b"), ("{a} % {b}", "a % b"), ("{b} ** 2 + {c} ** 3", "b * b + c * c * c"), ("-({a} - {b} * {c})", "b * c - a"),
    ("{a} * {b} / {b}", "a"), ("(({a}))", "a"), ("2 ** 3 ** 2 - {a}", "512 - a"), ("{a}.50 * 4 - 2", "4 * a"), ("- {a} // {b}", "-((a + b - 1) // b)"), ("-{a} % {b}", "(b - a % b) % b"), ("1_000 + {a}", "1000 + a"),
    ("{a} + ", "NULL"), ("{a} / 0", "NULL"), ("{a} ** 99", "NULL"), ("2000000 ** 2", "NULL"), ("0{b}", "NULL"), ("({a} + {b}", "NULL"),
]


def planted_arith(spark: SparkSession, sf: str) -> DataFrame:
    rows = _variants(_numbers(spark, sf), [text for text, _ in EXPRESSIONS])
    return M.with_value(rows.select("eval_id", "kind", "text"), F.col("text")).select("eval_id", "kind", "value")


#: Solutions; what is stated in them is right or wrong by a known amount.
SOLUTIONS = [
    "We start with {a} + {b} = {s}.\nThen {s} * {c} = {p}.\nThe answer is {p}",
    "We start with {a} + {b} = {s}.\nThen {s} * {c} = {w}.\nThe answer is {w}",
    "({a} + {b}) * {c} = {p} = {s} * {c}\nSo \\boxed{{p}}",
    "Half of {d} is {d} / 2 = {a}.\n{a} \\times {b} &= {t} \\\\ {t} - {t} = 0\n#### {t}",
    "It is {w} = {s} * {c}.\nThe answer is {w}",
]


def _solutions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _numbers(spark, sf).withColumn("s", F.expr("a + b")).withColumn("p", F.expr("(a + b) * c")).withColumn("w", F.expr("(a + b) * c + b")).withColumn("d", F.expr("2 * a")).withColumn("t", F.expr("a * b"))
    out = []
    for i, form in enumerate(SOLUTIONS):
        text = F.lit(form)
        for name in ("a", "b", "c", "s", "p", "w", "d", "t"):
            text = F.replace(text, F.lit("{" + name + "}"), F.col(name).cast("string"))
        out.append(F.struct(F.lit(i).alias("kind"), text.alias("text")))
    return rows.select("eval_id", F.explode(F.array(*out)).alias("v")).select("eval_id", "v.kind", "v.text")


def planted_checks(spark: SparkSession, sf: str) -> DataFrame:
    found = M.with_checks(_solutions(spark, sf), F.col("text"), extract_answer(F.col("text")))
    return found.select("eval_id", "kind", F.size("checks").alias("n_checked"), M.error_count(F.col("checks")).alias("n_errors"), "corrected_answer")


#: Answers, the gold answer that each is held against, and whether they are equivalent (SQL).
ANSWERS = [
    ("${a}$", "{a}", "true"), ("\\text{{a} km}", "{a}", "true"), ("{a},000", "{a}000", "true"), ("{a}.0", "{a}", "true"), ("\\dfrac{{a}}{{b}}", "{a}/{b}", "true"), ("{a}", "{b}", "a = b"), ("{a}%", "{a}", "true"),
    ("{a}/{b}", "{b}/{a}", "a = b"), ("{b}", "{b}.001", "b >= 10"), ("x = {a}", "x = {b}", "a = b"), ("nan", "nan", "true"), ("{a} dollars.", "{a}", "true"),
    ("{a}x + {b}", "{b} + x*{a}", "true"), ("(x+{a})^2", "x^2 + 2*{a}*x + {a}^2", "true"), ("(x+{a})^2", "x^2 + {a}^2", "false"), ("\\sqrt{{a}}\\cdot\\sqrt{{a}}", "{a}", "true"),
    ("\\frac{x^2-{a}^2}{x-{a}}", "x+{a}", "true"), ("{b}x^{{c}}", "x^{{c}}*{b}", "true"),
]


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    pairs = [F.struct(F.lit(i).alias("kind"), _text(p).alias("pred"), _text(g).alias("gold")) for i, (p, g, _) in enumerate(ANSWERS)]
    return _numbers(spark, sf).select("eval_id", F.explode(F.array(*pairs)).alias("v")).select("eval_id", "v.*")


def planted_equivalent(spark: SparkSession, sf: str) -> DataFrame:
    return with_equivalence(_answers(spark, sf), "pred", "gold").select("eval_id", "kind", "equivalent")


def planted_reward(spark: SparkSession, sf: str) -> DataFrame:
    rows = _answers(spark, sf).withColumn("text", F.concat(F.lit("We work it out.\n\\boxed{"), F.col("pred"), F.lit("}")))
    rows = rows.unionByName(rows.select("eval_id", (F.col("kind") + 100).alias("kind"), "pred", "gold", F.lit("no result here").alias("text")))
    graded = G.grade(rows, "text", "gold")
    return graded.select("eval_id", "kind", G.reward(F.when(F.col("kind") < 100, F.col("answer")), F.col("is_correct"), no_answer=-1.5).alias("reward"))


#: Symbolic pairs and whether they are the same expression (SQL).
SYMBOLIC = [
    ("(x+{a})(x-{a})", "x^2-{a}^2", "true"), ("({a}+y)^2", "y^2+{a}^2+2y*{a}", "true"), ("\\sqrt{{a}}\\sqrt{{b}}", "\\sqrt{{a}*{b}}", "true"), ("\\frac{1}{\\sqrt{{b}}}", "\\frac{\\sqrt{{b}}}{{b}}", "true"),
    ("{a}x", "{b}x", "a = b"), ("x^{{a}}", "x^{{b}}", "a = b"), ("\\sin({a}x)", "\\sin(x*{a})", "true"), ("\\sin({a}x)", "{a}\\sin(x)", "false"), ("2\\pi*{a}", "\\pi*{a}*2", "true"), ("({a}, {b})", "({a}, {b})", "false"),
    ("(x+y)^{{a}}*(x+y)", "(y+x)^{{a}+1}", "true"), ("x^{-{c}}", "1/x^{c}", "true"),
]


def symbolic_equal(spark: SparkSession, sf: str) -> DataFrame:
    pairs = [F.struct(F.lit(i).alias("kind"), _text(p).alias("p"), _text(g).alias("g")) for i, (p, g, _) in enumerate(SYMBOLIC)]
    rows = _numbers(spark, sf).select("eval_id", F.explode(F.array(*pairs)).alias("v")).select("eval_id", "v.*")
    return with_comparison(rows, "p", "g", "equal").select("eval_id", "kind", "equal")


def planted_numbers(spark: SparkSession, sf: str) -> DataFrame:
    forms = ["{a}", "-{a}.5", "{a}/{b}", "\\frac{{a}}{{b}}", "{a}%", "{a}/0", "{a}d", "1_{a}", "{a}/-{b}", ".{a}"]
    return _variants(_numbers(spark, sf), forms).select("eval_id", "kind", N.to_number(F.col("text")).alias("value"))


def planted_bits(spark: SparkSession, sf: str) -> DataFrame:
    """Bits per byte and perplexity by task, with planted losses: a tenth of `a` for each of `b` tokens."""
    rows = table(spark, sf, "eval_row").selectExpr("task", "problem", *[f"{sql} AS {name}" for name, sql in NUMBERS.items()]).withColumn("loss", F.expr("a * b / 10.0D"))
    found = E.bits_per_byte(rows, ["task"], "loss", "b", "problem")
    return found.select("task", F.round("bits_per_byte", 9).alias("bits_per_byte"), F.round("perplexity", 6).alias("perplexity"))


QUERIES = [planted_arith, planted_checks, planted_equivalent, planted_reward, planted_numbers, planted_bits, symbolic_equal]


def _kinds(n: int) -> str:
    return f"kinds AS (SELECT unnest(range({n}))::INTEGER AS kind)"


ORACLES = {
    "planted_arith": f"WITH {_ROWS}, {_kinds(len(EXPRESSIONS))} SELECT eval_id, kind, ({_cases([v for _, v in EXPRESSIONS])})::VARCHAR AS value FROM rows, kinds",
    "planted_checks": f"""WITH {_ROWS}, {_kinds(len(SOLUTIONS))} SELECT eval_id, kind, ({_cases(['2', '2', '2', '3', '1'])})::INTEGER AS n_checked, ({_cases(['0', '1', '0', '0', '1'])})::INTEGER AS n_errors,
        CASE WHEN kind IN (1, 4) THEN ((a + b) * c)::VARCHAR END AS corrected_answer FROM rows, kinds""",
    "planted_equivalent": f"WITH {_ROWS}, {_kinds(len(ANSWERS))} SELECT eval_id, kind, {_cases([v for *_, v in ANSWERS])} AS equivalent FROM rows, kinds",
    "planted_reward": f"""WITH {_ROWS}, {_kinds(len(ANSWERS))} SELECT eval_id, kind, CASE WHEN {_cases([v for *_, v in ANSWERS])} THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS reward FROM rows, kinds
        UNION ALL SELECT eval_id, kind + 100, -1.5::DOUBLE FROM rows, kinds""",
    "planted_numbers": f"WITH {_ROWS}, {_kinds(10)} SELECT eval_id, kind, {_cases(['a::DOUBLE', '-(a + 0.5::DOUBLE)', 'a::DOUBLE / b', 'a::DOUBLE / b', 'a::DOUBLE', 'NULL', 'NULL', '(100 + a)::DOUBLE', 'NULL', 'a::DOUBLE / 100'])} AS value FROM rows, kinds",
    "planted_bits": f"""WITH rows AS (SELECT task, strlen(problem) AS size, {_SELECT} FROM eval_row)
        SELECT task, round(sum(a * b / 10.0::DOUBLE) / ln(2) / sum(size), 9) AS bits_per_byte, round(exp(sum(a * b / 10.0::DOUBLE) / sum(b)), 6) AS perplexity FROM rows GROUP BY task""",
    "symbolic_equal": f"WITH {_ROWS}, {_kinds(len(SYMBOLIC))} SELECT eval_id, kind, {_cases([v for *_, v in SYMBOLIC])} AS equal FROM rows, kinds",
}
