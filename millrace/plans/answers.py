"""Answer, grading, arithmetic and cleaning queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.functions import arithmetic as M
from millrace.functions import cleaning as X
from millrace.functions import comparison as N
from millrace.functions.symbolic import with_comparison, with_equivalence
from millrace.operators import chat as D
from millrace.operators import grading as G
from millrace.plans import sqltext as Q
from millrace.tables import table

#: Length of the pieces in which a solution is streamed.
CHUNK = 24


def _records(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The rows as they are: repeated ones are dropped from the results, which are narrower than the texts."""
    return table(spark, sf, "eval_record").select("record_id", *columns)


def _completions(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf, "completion")


def _chats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sft").select("sft_id", "messages", "source")


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    return _chats(spark, sf).select("sft_id", D.source_name(F.col("source")).alias("source"), D.last_turn(F.col("messages"), "assistant").alias("reply"))


def _forms(spark: SparkSession, sf: str) -> DataFrame:
    """All answers as they are written in the tables."""
    some = [table(spark, sf, "grpo").select("answer"), table(spark, sf, "eval_record").select(F.col("gold").alias("answer")), table(spark, sf, "eval_record").select(F.col("predicted").alias("answer"))]
    return some[0].union(some[1]).union(some[2]).where(F.col("answer").isNotNull()).distinct()


def last_boxed(spark: SparkSession, sf: str) -> DataFrame:
    return _replies(spark, sf).select("sft_id", A.last_boxed(F.col("reply")).alias("boxed")).distinct()


def marker_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _replies(spark, sf).select("sft_id", A.marker_answer(F.col("reply")).alias("marker")).distinct()


def phrase_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _replies(spark, sf).select("sft_id", A.phrase_answer(F.col("reply")).alias("phrase")).distinct()


def trailing_equation(spark: SparkSession, sf: str) -> DataFrame:
    return _replies(spark, sf).select("sft_id", A.trailing_equation(F.col("reply")).alias("equation")).distinct()


def last_number(spark: SparkSession, sf: str) -> DataFrame:
    return _replies(spark, sf).select("sft_id", A.last_number(F.col("reply")).alias("number")).distinct()


def extract_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _completions(spark, sf).select("record_id", A.extract_answer(F.col("completion")).alias("answer")).distinct()


def extractable_rate(spark: SparkSession, sf: str) -> DataFrame:
    found = A.extract_answer(F.col("reply")).isNotNull()
    rows = _replies(spark, sf).where(F.col("reply").isNotNull()).select("sft_id", "source", found.alias("found")).distinct()
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("found").cast("double")).alias("rate"))


def drop_unextractable(spark: SparkSession, sf: str) -> DataFrame:
    return _replies(spark, sf).where(A.extract_answer(F.col("reply")).isNotNull()).select("sft_id").distinct()


def normalise_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _forms(spark, sf).select("answer", N.normalise(F.col("answer")).alias("normal"))


def thousands_commas(spark: SparkSession, sf: str) -> DataFrame:
    return _forms(spark, sf).select("answer", N.thousands(F.col("answer")).alias("plain"))


def to_number(spark: SparkSession, sf: str) -> DataFrame:
    return _forms(spark, sf).select("answer", N.to_number(N.normalise(F.col("answer"))).alias("value"))


def numeric_equal(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf, "predicted", "gold").where("predicted IS NOT NULL AND gold IS NOT NULL")
    values = rows.select("record_id", *[N.to_number(N.normalise(F.col(c))).alias(n) for c, n in (("predicted", "x"), ("gold", "y"))])
    return values.select("record_id", N.numeric_equal(F.col("x"), F.col("y")).alias("equal")).distinct()


def answers_equivalent(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf, "predicted", "gold")
    return with_equivalence(rows, "predicted", "gold").select("record_id", "equivalent").distinct()


def symbolic_open(spark: SparkSession, sf: str) -> DataFrame:
    """The predicted/gold pairs that text and numbers leave open, and what symbolic comparison says of them."""
    left = _records(spark, sf, "predicted", "gold").select(N.verdict(F.col("predicted"), F.col("gold")).alias("v")).select("v.p", "v.g")
    return with_comparison(left.where("p IS NOT NULL AND g IS NOT NULL").distinct(), "p", "g", "equal")


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    return G.grade(_records(spark, sf, "run_id", "eval_id", "completion", "gold"), "completion", "gold")


def is_correct(spark: SparkSession, sf: str) -> DataFrame:
    return _graded(spark, sf).select("record_id", "is_correct").distinct()


def math_reward(spark: SparkSession, sf: str) -> DataFrame:
    return _graded(spark, sf).select("record_id", G.reward(F.col("answer"), F.col("is_correct"), no_answer=-1.5).alias("reward")).distinct()


def reward_batch(spark: SparkSession, sf: str) -> DataFrame:
    turns = F.array(F.struct(F.lit("assistant").alias("role"), F.col("completion").alias("content")))
    rows = _records(spark, sf, "completion", "gold").select("record_id", "gold", turns.alias("turns"))
    rows = rows.withColumn("text", G.completion_text(F.col("turns"), nested=True))
    graded = G.grade(rows, "text", "gold")
    return graded.select("record_id", G.reward(F.col("answer"), F.col("is_correct")).alias("reward")).distinct()


def agreement_rate(spark: SparkSession, sf: str) -> DataFrame:
    return G.agreement(_graded(spark, sf).select("record_id", "run_id", "is_correct").distinct(), "is_correct", "run_id")


def arith_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return _replies(spark, sf).where(F.col("reply").isNotNull()).select("sft_id", M.plain_arithmetic(F.col("reply")).alias("plain")).distinct()


def arith_candidate(spark: SparkSession, sf: str) -> DataFrame:
    lines = _replies(spark, sf).where(F.col("reply").isNotNull()).select("sft_id", F.posexplode(F.split(M.plain_arithmetic(F.col("reply")), "\n")).alias("line_no", "line"))
    parts = lines.where(F.contains("line", F.lit("="))).select("sft_id", "line_no", F.posexplode(F.split("line", "=")).alias("part_no", "part"))
    return parts.select("sft_id", "line_no", "part_no", M.arithmetic_tail(F.col("part")).alias("expression")).distinct()


def safe_arith(spark: SparkSession, sf: str) -> DataFrame:
    some = arith_candidate(spark, sf).where(F.col("expression").isNotNull()).select("expression").distinct()
    return M.with_value(some, F.col("expression"))


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    rows = _replies(spark, sf).where(F.col("reply").isNotNull()).select("sft_id", "reply")
    return M.with_checks(rows, F.col("reply"), A.extract_answer(F.col("reply")))


def check_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf).select("sft_id", F.posexplode("checks").alias("check_no", "c")).select("sft_id", "check_no", "c.expr", "c.computed", "c.stated", "c.ok").distinct()


def arith_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf).select("sft_id", F.size("checks").alias("n_checked"), M.error_count(F.col("checks")).alias("n_errors")).distinct()


def corrected_answer(spark: SparkSession, sf: str) -> DataFrame:
    rows = _completions(spark, sf).where(F.col("completion").isNotNull())
    found = M.with_checks(rows, F.col("completion"), A.extract_answer(F.col("completion")))
    return found.where(F.col("corrected_answer").isNotNull()).select("record_id", "corrected_answer").distinct()


def solve_result(spark: SparkSession, sf: str) -> DataFrame:
    return G.solve(_completions(spark, sf).where(F.col("completion").isNotNull()), "completion").drop("completion").distinct()


def clean_solution(spark: SparkSession, sf: str) -> DataFrame:
    return _completions(spark, sf).select("record_id", X.clean_solution(F.col("completion")).alias("solution")).distinct()


def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    pieces = F.posexplode(X.chunks(F.col("completion"), CHUNK)).alias("piece_no", "piece")
    return _completions(spark, sf).select("record_id", pieces).distinct()


def truncate_at_box(spark: SparkSession, sf: str) -> DataFrame:
    return _completions(spark, sf).select("record_id", X.truncate_at_box(F.col("completion")).alias("text")).distinct()


def truncate_balanced(spark: SparkSession, sf: str) -> DataFrame:
    return _completions(spark, sf).select("record_id", X.truncate_at_box(F.col("completion"), balanced=True).alias("text")).distinct()


QUERIES = [
    last_boxed, marker_answer, phrase_answer, trailing_equation, last_number, extract_answer, extractable_rate, drop_unextractable, normalise_answer, thousands_commas, to_number,
    numeric_equal, answers_equivalent, symbolic_open, is_correct, math_reward, reward_batch, agreement_rate, arith_normalise, arith_candidate, safe_arith, check_arithmetic,
    arith_errors, corrected_answer, solve_result, clean_solution, chunk_text, truncate_at_box, truncate_balanced,
]

_REPLIES = f"replies AS (SELECT sft_id, {Q.source('source')} AS source, {Q.turn('messages', 'assistant')} AS reply FROM {Q.CHATS})"
_FORMS = "forms AS (SELECT DISTINCT answer FROM (SELECT answer FROM grpo UNION ALL SELECT gold FROM eval_record UNION ALL SELECT predicted FROM eval_record) WHERE answer IS NOT NULL)"
_GRADED = f"WITH {Q.graded(Q.RECORDS, 'completion', 'gold', 'record_id, run_id, eval_id')}"
_PAIRS = f"pairs AS (SELECT DISTINCT record_id, predicted, gold FROM eval_record), normal AS (SELECT *, {Q.normal('predicted')} AS p, {Q.normal('gold')} AS g FROM pairs), valued AS (SELECT *, {Q.number('p')} AS x, {Q.number('g')} AS y FROM normal)"
_TAIL = Q.strip(rf"regexp_extract(part, '[0-9.\s\x0b\x{{85}}\p{{Z}}()+\-*/%]+$')")


def _parts(rows: str, key: str, text: str) -> str:
    """CTEs to `candidates(key, line_no, part_no, expression)`: the arithmetic that each part between equals signs ends in."""
    return rf"""lines AS (SELECT {key}, string_split({Q.arithmetic(text)}, chr(10)) AS l FROM {rows} WHERE {text} IS NOT NULL),
    numbered AS (SELECT {key}, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM lines),
    parts AS (SELECT {key}, line_no, generate_subscripts(string_split(line, '='), 1) - 1 AS part_no, unnest(string_split(line, '=')) AS part FROM numbered WHERE contains(line, '=')),
    candidates AS MATERIALIZED (SELECT {key}, line_no::INTEGER AS line_no, part_no::INTEGER AS part_no, CASE WHEN regexp_matches({_TAIL}, '\d') AND left({_TAIL}, 1) NOT IN ('+', '*', '/', '%') THEN {_TAIL} END AS expression FROM parts)"""


def _value(x: str) -> str:
    """The value of the forms of expressions that the tables hold: a number, or two of them and + - *."""
    n = [f"regexp_extract({x}, '^(-?)[ \\t]*(\\d+)\\.?(?:[ \\t]*([-+*])[ \\t]*(\\d+)\\.?)?$', {i})" for i in range(1, 5)]
    first = f"(CASE WHEN {n[0]} = '-' THEN -1 ELSE 1 END * try_cast({n[1]} AS BIGINT))"
    second = f"try_cast({n[3]} AS BIGINT)"
    return f"CASE {n[2]} WHEN '+' THEN {first} + {second} WHEN '-' THEN {first} - {second} WHEN '*' THEN {first} * {second} ELSE {first} END"


def _checks(rows: str, key: str, text: str) -> str:
    """CTEs to `checks(key, check_no, expr, computed, stated, ok)`."""
    return rf"""{_parts(rows, key, text)}, valued AS (SELECT *, {_value('expression')} AS v, regexp_matches(expression, '[-+*/%]') AS worked FROM candidates),
    pairs AS (SELECT a.{key}, a.line_no, a.part_no, CASE WHEN a.worked THEN a.expression ELSE b.expression END AS expr, CASE WHEN a.worked THEN a.v ELSE b.v END AS c, CASE WHEN a.worked THEN b.v ELSE a.v END AS s
        FROM valued a JOIN valued b ON a.{key} = b.{key} AND a.line_no = b.line_no AND b.part_no = a.part_no + 1 WHERE a.v IS NOT NULL AND b.v IS NOT NULL AND (a.worked OR b.worked)),
    checks AS (SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY line_no, part_no) - 1)::INTEGER AS check_no, expr, c::VARCHAR AS computed, s::VARCHAR AS stated, c = s AS ok FROM pairs)"""


_TOLD = f"WITH {_REPLIES}, told AS (SELECT sft_id, reply FROM replies WHERE reply IS NOT NULL)"
_SAID = f"WITH said AS (SELECT record_id, completion, {Q.clean('completion')} AS solution FROM {Q.RECORDS} WHERE completion IS NOT NULL)"


def _fixed(text: str) -> str:
    """`fixed(record_id, corrected_answer)` from `said` and `checks`."""
    return f"""answers AS (SELECT record_id, {Q.extracted(text)} AS answer FROM said), stated AS (SELECT record_id, answer, {_value('answer')} AS v FROM answers),
    fixed AS (SELECT record_id, min_by(computed, check_no) AS corrected_answer FROM checks JOIN stated USING (record_id) WHERE NOT ok AND stated = v::VARCHAR GROUP BY record_id)"""


def _of_reply(sql: str, name: str) -> str:
    return f"WITH {_REPLIES} SELECT sft_id, {sql} AS {name} FROM replies"


ORACLES = {
    "last_boxed": _of_reply(Q.boxed("reply"), "boxed"),
    "marker_answer": _of_reply(Q.marker("reply"), "marker"),
    "phrase_answer": _of_reply(Q.phrase("reply"), "phrase"),
    "trailing_equation": _of_reply(Q.equation("reply"), "equation"),
    "last_number": _of_reply(Q.last_number("reply"), "number"),
    "extract_answer": f"SELECT record_id, {Q.extracted('completion')} AS answer FROM {Q.RECORDS}",
    "extractable_rate": f"WITH {_REPLIES} SELECT source, count(*) AS n, avg(({Q.extracted('reply')} IS NOT NULL)::INTEGER) AS rate FROM replies WHERE reply IS NOT NULL GROUP BY source",
    "drop_unextractable": f"WITH {_REPLIES} SELECT sft_id FROM replies WHERE {Q.extracted('reply')} IS NOT NULL",
    "normalise_answer": f"WITH {_FORMS} SELECT answer, {Q.normal('answer')} AS normal FROM forms",
    "thousands_commas": f"WITH {_FORMS} SELECT answer, {Q.thousands('answer')} AS plain FROM forms",
    "to_number": f"WITH {_FORMS}, n AS (SELECT answer, {Q.normal('answer')} AS f FROM forms) SELECT answer, {Q.number('f')} AS value FROM n",
    "numeric_equal": f"WITH {_PAIRS} SELECT record_id, {Q.near('x', 'y')} AS equal FROM valued WHERE predicted IS NOT NULL AND gold IS NOT NULL",
    "answers_equivalent": f"WITH {_PAIRS} SELECT record_id, CASE WHEN predicted IS NULL THEN false WHEN p = g THEN true WHEN x IS NOT NULL AND y IS NOT NULL THEN {Q.near('x', 'y')} ELSE false END AS equivalent FROM valued",
    "is_correct": f"{_GRADED} SELECT record_id, ok AS is_correct FROM graded",
    "math_reward": f"{_GRADED} SELECT record_id, CASE WHEN answer IS NULL THEN -1.5::DOUBLE WHEN ok THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS reward FROM graded",
    "reward_batch": f"{_GRADED} SELECT record_id, CASE WHEN ok THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS reward FROM graded",
    "agreement_rate": f"{_GRADED} SELECT run_id, avg(ok::INTEGER) AS agreement, count(*) AS n FROM graded GROUP BY run_id",
    "arith_normalise": f"WITH {_REPLIES} SELECT sft_id, {Q.arithmetic('reply')} AS plain FROM replies WHERE reply IS NOT NULL",
    "arith_candidate": f"{_TOLD}, {_parts('told', 'sft_id', 'reply')} SELECT * FROM candidates",
    "safe_arith": f"{_TOLD}, {_parts('told', 'sft_id', 'reply')} SELECT DISTINCT expression, ({_value('expression')})::VARCHAR AS value FROM candidates WHERE expression IS NOT NULL",
    "check_arithmetic": f"{_TOLD}, {_checks('told', 'sft_id', 'reply')} SELECT * FROM checks",
    "arith_errors": f"{_TOLD}, {_checks('told', 'sft_id', 'reply')} SELECT sft_id, count(check_no)::INTEGER AS n_checked, coalesce(sum((NOT ok)::INTEGER), 0)::INTEGER AS n_errors FROM told LEFT JOIN checks USING (sft_id) GROUP BY sft_id",
    "corrected_answer": f"{_SAID}, {_checks('said', 'record_id', 'completion')}, {_fixed('completion')} SELECT * FROM fixed",
    "solve_result": f"""{_SAID}, {_checks('said', 'record_id', 'solution')}, {_fixed('solution')}, counted AS (SELECT record_id, count(*) AS n, sum((NOT ok)::INTEGER) AS e FROM checks GROUP BY record_id)
        SELECT record_id, solution, answers.answer AS raw_answer, coalesce(corrected_answer, answers.answer) AS answer, coalesce(n, 0)::INTEGER AS checked, coalesce(e, 0)::INTEGER AS errors, corrected_answer IS NOT NULL AS corrected
        FROM said JOIN answers USING (record_id) LEFT JOIN fixed USING (record_id) LEFT JOIN counted USING (record_id)""",
    "clean_solution": f"SELECT record_id, {Q.clean('completion')} AS solution FROM {Q.RECORDS}",
    "chunk_text": f"SELECT record_id, (i // {CHUNK})::INTEGER AS piece_no, substring(completion, (i + 1)::BIGINT, {CHUNK}) AS piece FROM (SELECT record_id, completion, unnest(range(0, length(completion), {CHUNK})) AS i FROM {Q.RECORDS})",
    "truncate_balanced": rf"SELECT record_id, CASE WHEN regexp_matches(completion, '{Q.FIRST_BOX}') THEN regexp_extract(completion, '{Q.FIRST_BOX}') ELSE completion END AS text FROM {Q.RECORDS}",
    "truncate_at_box": rf"SELECT record_id, CASE WHEN regexp_matches(completion, '\\boxed\{{[^}}]*\}}') THEN regexp_extract(completion, '(?s)^.*?\\boxed\{{[^}}]*\}}') ELSE completion END AS text FROM {Q.RECORDS}",
}
