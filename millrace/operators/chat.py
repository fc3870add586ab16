"""Chat records, problem sets and prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.answers import extract_answer
from millrace.functions.strings import rstrip, strip
from millrace.functions.symbolic import with_equivalence

#: The system turn of built records; a parameter of message_record.
SYSTEM_PROMPT = "Work through the problem in steps and put the final answer in \\boxed{}."
MESSAGE = "array<struct<role:string,content:string>>"


def role(message: Column) -> Column:
    return F.lower(F.trim(F.coalesce(message["role"], F.lit(""))))


def message(name: str, content: Column) -> Column:
    return F.struct(F.lit(name).alias("role"), content.alias("content"))


def message_record(problem: Column, solution: Column, system: str = SYSTEM_PROMPT) -> Column:
    """System, user and assistant turn, the last two stripped."""
    return F.array(message("system", F.lit(system)), message("user", strip(problem)), message("assistant", strip(solution))).cast(MESSAGE)


def prompt(problem: Column, system: str = SYSTEM_PROMPT) -> Column:
    return F.array(message("system", F.lit(system)), message("user", problem)).cast(MESSAGE)


def last_turn(messages: Column, name: str) -> Column:
    """Content of the last turn of a role, in any case; null without one."""
    return F.try_element_at(F.filter(messages, lambda m: role(m) == name), F.lit(-1))["content"]


def render(messages: Column) -> Column:
    """The turns between <|im_start|> and <|im_end|>, and an open assistant turn."""
    said = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), role(m), F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(said, ""), F.lit("<|im_start|>assistant\n"))


def with_boxed(df: DataFrame, solution: str, answer: str, name: str = "boxed") -> DataFrame:
    """df with a solution that ends in a boxed line: as it is if it is right and its last line has a box, else with a line added."""
    base = df.withColumn("_solution", rstrip(F.coalesce(F.col(solution), F.lit("")))).withColumn("_answer", extract_answer(F.col("_solution")))
    graded = with_equivalence(base, "_answer", answer, "_right")
    last = F.element_at(F.split(F.col("_solution"), "\n"), -1)
    line = F.concat(F.col("_solution"), F.lit("\nThe final answer is $\\boxed{"), F.coalesce(F.col(answer), F.lit("")), F.lit("}$."))
    kept = F.col("_right") & F.contains(last, F.lit("\\boxed"))
    return graded.withColumn(name, F.when(kept, F.col("_solution")).otherwise(line)).drop("_solution", "_answer", "_right")


def with_answer(df: DataFrame, answer: str) -> DataFrame:
    """Rows whose answer is more than white space, stripped."""
    return df.withColumn(answer, strip(F.col(answer))).where(F.col(answer) != "")


def mix(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of the sources under their name and rank, by column name; missing columns are null."""
    out: DataFrame | None = None
    for rank, (name, df) in enumerate(sources.items()):
        part = df.withColumn("source", F.lit(name)).withColumn("source_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def problem_set(df: DataFrame, extracted: str = "gsm8k", stripped: str = "math") -> DataFrame:
    """Problems (`source`, `answer`, ...) of two sources: answers of the one extracted, those of the other stripped; rows without go."""
    answer = F.when(F.col("source") == extracted, extract_answer(F.col("answer"))).otherwise(F.when(strip(F.col("answer")) != "", strip(F.col("answer"))))
    return df.where(F.col("source").isin(extracted, stripped)).withColumn("answer", answer).where(F.col("answer").isNotNull())


def load_task(name: str, tasks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The rows of a task by its name; an unknown name is an error."""
    if name not in tasks:
        raise ValueError(f"unknown task {name!r}; there are {', '.join(sorted(tasks))}")
    return tasks[name]()


def nested(turns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Turns (`role`, `content`, `order`) of each key as `messages`; a turn repeated under one place counts once, a conversation is held by one task."""
    one = F.struct(order, "role", "content")
    rows = turns.groupBy(*keys).agg(F.array_sort(F.collect_set(one)).alias("_turns"))
    return rows.select(*keys, F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).cast(MESSAGE).alias("messages"))


def source_name(column: Column) -> Column:
    """A source without case and outer white space; null for none."""
    name = F.lower(F.trim(column))
    return F.when(name != "", name)


def to_jsonl(*columns: str) -> Column:
    """A row as JSON with its nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
