"""Chat and problem-set queries over `sft`, `grpo`, `eval_row` and `eval_record`, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.functions.strings import strip
from millrace.operators import chat as D
from millrace.operators.corpus import limit_per_source
from millrace.plans import sqltext as Q
from millrace.sources.jsonl import head
from millrace.tables import table

#: Records of the large source, and of each source in the limited mix.
OMI_ROWS, PER_SOURCE = 100_000, 100
#: Records whose answers are tried.
EXTRACTED = 300


def _chats(spark: SparkSession, sf: str) -> DataFrame:
    """The rows as they are: repeated ones are dropped from the results."""
    return table(spark, sf, "sft").select("sft_id", "messages", "source")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("messages")
    return _chats(spark, sf).select("sft_id", D.source_name(F.col("source")).alias("source"), D.last_turn(m, "user").alias("problem"), D.last_turn(m, "assistant").alias("solution"))


def _problems(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "grpo").select("problem_id", "problem", "answer", D.source_name(F.col("source")).alias("source"), "level")


def _first(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of the n least ids. Only ids are ordered: the n-th one is a bound, so that no text travels."""
    bound = head(rows.select(key).distinct(), [key], n).agg(F.max(key).alias("_bound"))
    return rows.join(F.broadcast(bound), F.col(key) <= F.col("_bound")).drop("_bound")


def last_user_turn(spark: SparkSession, sf: str) -> DataFrame:
    return _chats(spark, sf).select("sft_id", F.coalesce(D.last_turn(F.col("messages"), "user"), F.lit("Ask a question.")).alias("problem")).distinct()


def render_chat(spark: SparkSession, sf: str) -> DataFrame:
    return _chats(spark, sf).select("sft_id", D.render(F.col("messages")).alias("rendered")).distinct()


def gsm8k_clean(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf).where(F.col("solution").isNotNull())
    return rows.select("sft_id", A.gsm_steps(F.col("solution")).alias("steps"), A.gsm_final(F.col("solution")).alias("final")).distinct()


def sft_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf).where("problem IS NOT NULL AND solution IS NOT NULL")
    return rows.select("sft_id", F.explode(D.message_record(F.col("problem"), F.col("solution"))).alias("m")).select("sft_id", "m.role", "m.content").distinct()


def _solved(spark: SparkSession, sf: str, source: str) -> DataFrame:
    """Pairs of a source with their final answer."""
    rows = _pairs(spark, sf).where((F.col("source") == source) & F.col("problem").isNotNull() & F.col("solution").isNotNull())
    return rows.withColumn("answer", A.extract_answer(F.col("solution")))


def _gsm(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf).where((F.col("source") == "gsm8k") & F.col("problem").isNotNull())
    rows = rows.select("sft_id", "problem", A.gsm_steps(F.col("solution")).alias("solution"), A.gsm_final(F.col("solution")).alias("answer"))
    return D.with_answer(rows, "answer")


def _boxed(rows: DataFrame) -> DataFrame:
    return D.with_boxed(rows, "solution", "answer").select("sft_id", "problem", F.col("boxed").alias("solution"))


def sft_gsm8k(spark: SparkSession, sf: str) -> DataFrame:
    return _boxed(_gsm(spark, sf)).select("sft_id", strip(F.col("problem")).alias("problem"), strip(F.col("solution")).alias("solution")).distinct()


def sft_math(spark: SparkSession, sf: str) -> DataFrame:
    return _boxed(D.with_answer(_solved(spark, sf, "math"), "answer")).select("sft_id", strip(F.col("problem")).alias("problem"), strip(F.col("solution")).alias("solution")).distinct()


def sft_omi(spark: SparkSession, sf: str) -> DataFrame:
    rows = _first(D.with_answer(_solved(spark, sf, "omi"), "answer"), "sft_id", OMI_ROWS)
    return _boxed(rows).select("sft_id", strip(F.col("problem")).alias("problem"), strip(F.col("solution")).alias("solution")).distinct()


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    """All three sources; the boxed ending is made once, over their union."""
    others = D.with_answer(_pairs(spark, sf).where("source IN ('math', 'omi') AND problem IS NOT NULL AND solution IS NOT NULL").withColumn("answer", A.extract_answer(F.col("solution"))), "answer")
    columns = ["sft_id", "problem", "solution", "answer"]
    omi = _first(others.where("source = 'omi'").select(*columns), "sft_id", OMI_ROWS)
    raw = D.mix({"gsm8k": _gsm(spark, sf).select(*columns), "math": others.where("source = 'math'").select(*columns), "omi": omi})
    return D.with_boxed(raw, "solution", "answer").select("sft_id", "source", "source_rank", strip(F.col("problem")).alias("problem"), strip(F.col("boxed")).alias("solution"))


def sft_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf).select("sft_id", "source", "source_rank").distinct()


def counts_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return sft_mix(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def sft_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    rows = _mixed(spark, sf).withColumn("messages", D.message_record(F.col("problem"), F.col("solution")))
    return rows.select("sft_id", D.to_jsonl("messages").alias("line")).distinct()


def with_boxed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "eval_record").select("record_id", "completion", "gold").where("completion IS NOT NULL AND gold IS NOT NULL")
    return D.with_boxed(rows, "completion", "gold").select("record_id", "boxed").distinct()


def drop_empty_answers(spark: SparkSession, sf: str) -> DataFrame:
    return D.with_answer(_problems(spark, sf), "answer").select("problem_id", "answer").distinct()


def omi_subset(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.with_answer(_problems(spark, sf), "answer").where(F.col("source") == "omi")
    return _first(rows.select("problem_id", "problem", "answer"), "problem_id", OMI_ROWS).distinct()


def grpo_problems(spark: SparkSession, sf: str) -> DataFrame:
    """gsm8k answers are extracted (those without one go), math answers are stripped."""
    return D.problem_set(_problems(spark, sf)).select("problem_id", "problem", "answer", "source", "level").distinct()


def grpo_prompt(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.with_answer(_problems(spark, sf), "answer")
    turns = rows.select("problem_id", "answer", F.posexplode(D.prompt(F.col("problem"))).alias("turn", "m"))
    return turns.select("problem_id", "answer", "turn", "m.role", "m.content").distinct()


def grpo_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    rows = grpo_problems(spark, sf)
    return rows.select("problem_id", D.to_jsonl("problem", "answer", "source", "level").alias("line")).distinct()


def level_cast(spark: SparkSession, sf: str) -> DataFrame:
    written = _problems(spark, sf).select("problem_id", F.concat(F.lit("Level "), F.col("level").cast("string")).alias("written"))
    return written.select("problem_id", F.regexp_replace("written", "^Level ", "").try_cast("int").alias("level")).distinct()


def _tasks(spark: SparkSession, sf: str) -> dict[str, Callable[[], DataFrame]]:
    """A loader for each task; gsm8k answers are extracted, math answers stripped."""
    rows = table(spark, sf, "eval_row").where(F.col("split") == "test").select("eval_id", "task", "problem", "answer", "level")
    return {
        "gsm8k": lambda: rows.where("task = 'gsm8k'").withColumn("answer", A.extract_answer(F.col("answer"))).where(F.col("answer").isNotNull()),
        "math": lambda: D.with_answer(rows.where("task = 'math'"), "answer"),
    }


def eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    tasks = _tasks(spark, sf)
    return D.load_task("gsm8k", tasks).unionByName(D.load_task("math", tasks))


def extractable_head(spark: SparkSession, sf: str) -> DataFrame:
    """Share of extractable answers among the first records over the sources in their order: gsm8k, math, then omi."""
    rows = _mixed(spark, sf).select("source_rank", "sft_id", A.extract_answer(F.col("solution")).isNotNull().alias("found")).distinct()
    first = head(rows, ["source_rank", "sft_id"], EXTRACTED)
    return first.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("found").cast("double")).alias("rate"))


def nested_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of the chats as rows of their own, in no order, put together again."""
    turns = _chats(spark, sf).select("sft_id", F.posexplode("messages").alias("turn", "m")).select("sft_id", "turn", "m.role", "m.content").repartition("content")
    return D.nested(turns, ["sft_id"], "turn").select("sft_id", F.size("messages").alias("n_turns"), D.render(F.col("messages")).alias("rendered"))


def eval_rows_limited(spark: SparkSession, sf: str) -> DataFrame:
    return limit_per_source(eval_rows(spark, sf).select("eval_id", "task"), "task", ["eval_id"], PER_SOURCE)


QUERIES = [
    last_user_turn, render_chat, gsm8k_clean, sft_messages, sft_gsm8k, sft_math, sft_omi, sft_mix, counts_by_source, sft_jsonl, with_boxed, drop_empty_answers, omi_subset,
    grpo_problems, grpo_prompt, grpo_jsonl, level_cast, eval_rows, eval_rows_limited, extractable_head, nested_turns,
]

_PAIRS = f"pairs AS (SELECT sft_id, {Q.source('source')} AS source, {Q.turn('messages', 'user')} AS problem, {Q.turn('messages', 'assistant')} AS solution FROM {Q.CHATS})"
_STEPS = Q.strip(rf"regexp_replace(regexp_replace(solution, '####{Q.W}*(-?[0-9][0-9,.]*)', '', 'g'), '<<[^>]*>>', '', 'g')")
_FINAL = f"replace({Q.marker('solution')}, ',', '')"
_PROBLEMS = f"""problems AS (SELECT problem_id, problem, {Q.strip('answer')} AS answer, {Q.source('source')} AS source, level FROM {Q.PROBLEMS}), answered AS (SELECT * FROM problems WHERE answer <> ''),
    taken AS (SELECT problem_id, problem, CASE source WHEN 'gsm8k' THEN {Q.extracted('answer')} ELSE answer END AS answer, source, level FROM problems WHERE source IN ('gsm8k', 'math')),
    trained AS (SELECT * FROM taken WHERE answer <> '' OR source = 'gsm8k' AND answer IS NOT NULL)"""
_RAW = f"""{_PAIRS}, gsm AS (SELECT sft_id, 'gsm8k' AS source, 0 AS source_rank, problem, {_STEPS} AS solution, {_FINAL} AS answer FROM pairs WHERE source = 'gsm8k' AND problem IS NOT NULL),
    others AS (SELECT sft_id, source, CASE source WHEN 'math' THEN 1 ELSE 2 END AS source_rank, problem, solution, {Q.strip(Q.extracted('solution'))} AS answer FROM pairs WHERE source IN ('math', 'omi') AND problem IS NOT NULL AND solution IS NOT NULL),
    raw AS (SELECT * FROM (SELECT * FROM gsm UNION ALL SELECT * FROM others) WHERE answer <> ''),
    ended AS (SELECT sft_id, source, source_rank, problem, answer AS wanted, rtrim(solution, {Q.WS}) AS solution FROM raw)"""


def _boxing(rows: str, key: str) -> str:
    """Rows (key, problem, solution, wanted) to `boxed(key, text)`."""
    kept = f"{key}, solution"
    line = r"solution || chr(10) || 'The final answer is $\boxed{' || gold_ || '}$.'"
    return rf"{Q.graded(rows, 'solution', 'wanted', kept)}, boxed AS (SELECT {key}, CASE WHEN ok AND contains(string_split(solution, chr(10))[-1], '\boxed') THEN solution ELSE {line} END AS text FROM graded)"


_EVAL = f"""tests AS (SELECT eval_id, task, problem, CASE task WHEN 'gsm8k' THEN {Q.extracted('answer')} ELSE {Q.strip('answer')} END AS answer, level FROM eval_row WHERE split = 'test'),
    loaded AS (SELECT * FROM tests WHERE answer <> '' OR task = 'gsm8k' AND answer IS NOT NULL)"""
_MIX = f"WITH {_RAW}, {_boxing('ended', 'sft_id, source, source_rank, problem')}"
_RECORD_ENDS = f"ends AS (SELECT record_id, rtrim(completion, {Q.WS}) AS solution, gold AS wanted FROM {Q.RECORDS} WHERE completion IS NOT NULL AND gold IS NOT NULL)"
_SYSTEM = f"'{D.SYSTEM_PROMPT}'"


def _of_source(name: str) -> str:
    return f"{_MIX} SELECT sft_id, {Q.strip('problem')} AS problem, {Q.strip('text')} AS solution FROM boxed WHERE source = '{name}'"


ORACLES = {
    "last_user_turn": f"SELECT sft_id, coalesce({Q.turn('messages', 'user')}, 'Ask a question.') AS problem FROM {Q.CHATS}",
    "render_chat": f"SELECT sft_id, array_to_string(list_transform(messages, lambda m: '<|im_start|>' || lower(trim(coalesce(m.role, ''))) || chr(10) || coalesce(m.content, '') || '<|im_end|>' || chr(10)), '') || '<|im_start|>assistant' || chr(10) AS rendered FROM {Q.CHATS}",
    "gsm8k_clean": f"WITH {_PAIRS} SELECT sft_id, {_STEPS} AS steps, {_FINAL} AS final FROM pairs WHERE solution IS NOT NULL",
    "sft_messages": f"""WITH {_PAIRS}, kept AS (SELECT * FROM pairs WHERE problem IS NOT NULL AND solution IS NOT NULL)
        SELECT sft_id, 'system' AS role, {_SYSTEM} AS content FROM kept UNION ALL SELECT sft_id, 'user', {Q.strip('problem')} FROM kept UNION ALL SELECT sft_id, 'assistant', {Q.strip('solution')} FROM kept""",
    "sft_gsm8k": _of_source("gsm8k"),
    "sft_math": _of_source("math"),
    "sft_omi": _of_source("omi"),
    "sft_mix": f"{_MIX} SELECT sft_id, source, source_rank FROM boxed",
    "counts_by_source": f"{_MIX} SELECT source, count(*) AS n FROM boxed GROUP BY source",
    "sft_jsonl": f"""{_MIX} SELECT sft_id, to_json({{'messages': [{{'role': 'system', 'content': {_SYSTEM}}}, {{'role': 'user', 'content': {Q.strip('problem')}}}, {{'role': 'assistant', 'content': {Q.strip('text')}}}]}})::VARCHAR AS line FROM boxed""",
    "grpo_jsonl": f"WITH {_PROBLEMS} SELECT problem_id, to_json({{'problem': problem, 'answer': answer, 'source': source, 'level': level}})::VARCHAR AS line FROM trained",
    "with_boxed": f"WITH {_RECORD_ENDS}, {_boxing('ends', 'record_id')} SELECT record_id, text AS boxed FROM boxed",
    "drop_empty_answers": f"WITH {_PROBLEMS} SELECT problem_id, answer FROM answered",
    "omi_subset": f"WITH {_PROBLEMS} SELECT problem_id, problem, answer FROM answered WHERE source = 'omi' ORDER BY problem_id LIMIT {OMI_ROWS}",
    "grpo_problems": f"WITH {_PROBLEMS} SELECT problem_id, problem, answer, source, level FROM trained",
    "grpo_prompt": f"WITH {_PROBLEMS} SELECT problem_id, answer, 0 AS turn, 'system' AS role, {_SYSTEM} AS content FROM answered UNION ALL SELECT problem_id, answer, 1, 'user', problem FROM answered",
    "level_cast": f"SELECT problem_id, level FROM {Q.PROBLEMS}",
    "eval_rows": f"WITH {_EVAL} SELECT * FROM loaded",
    "extractable_head": f"{_MIX}, firsts AS (SELECT {Q.extracted(Q.strip('text'))} IS NOT NULL AS found FROM boxed ORDER BY source_rank, sft_id LIMIT {EXTRACTED}) SELECT count(*) AS n, avg(found::INTEGER) AS rate FROM firsts",
    "nested_turns": f"SELECT sft_id, len(messages)::INTEGER AS n_turns, array_to_string(list_transform(messages, lambda m: '<|im_start|>' || lower(trim(coalesce(m.role, ''))) || chr(10) || coalesce(m.content, '') || '<|im_end|>' || chr(10)), '') || '<|im_start|>assistant' || chr(10) AS rendered FROM {Q.CHATS} WHERE len(messages) > 0",
    "eval_rows_limited": f"WITH {_EVAL} SELECT eval_id, task FROM loaded QUALIFY row_number() OVER (PARTITION BY task ORDER BY eval_id) <= {PER_SOURCE}",
}
