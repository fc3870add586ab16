"""Whole paths from raw files to their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import chat as D
from millrace.operators import corpus as C
from millrace.operators import evaluation as E
from millrace.operators import grading as G
from millrace.operators import profiling as P
from millrace.sizing import broadcast_if_small
from millrace.sources.jsonl import read_lines, source_positions
from millrace.sources.shards import write_jsonl, write_shards
from millrace.storage import materialise

_PLACE = ["file", "block", "line"]


def corpus_to_shards(
    spark: SparkSession, folder: str, out: str, *, target_tokens: float, val_tokens: float = 0, subsets: list[str] | None = None, docs: int = C.SHARD_DOCS,
    min_chars: int = C.MIN_CHARS, max_chars: int = C.MAX_CHARS,
) -> dict[str, dict]:
    """JSON lines to numbered Parquet shards: cleaned, one document a source and round, up to the target; the validation split last, as one shard.

    The cleaned rows are written once, so that their places stay what they are; order and budget see only places and lengths.
    Returns the figures of both parts; a warning stands under `warnings` if there are fewer than two shards or none for validation.
    """
    rows = C.clean(C.in_subsets(read_lines(spark, folder), subsets), min_chars=min_chars, max_chars=max_chars)
    rows = rows.join(broadcast_if_small(source_positions(rows.where("split = 'train'"))), "source", "left")
    rows = rows.select(*_PLACE, "split", "source_pos", "text", F.length("text").cast("long").alias("size"))
    rows = materialise(rows.withColumn("key", F.concat_ws(":", *_PLACE)), "cleaned")
    train, held = rows.where("split = 'train'"), rows.where("split = 'validation'")
    kept = C.balanced_budget(train.select("source_pos", *_PLACE, "size", "key"), "source_pos", _PLACE, "size", target_tokens * C.CHARS_PER_TOKEN, min_chars, ["key"])
    found = {"train": write_shards(kept, train, "key", out, docs=docs)}
    cut = C.budget_cut(held.select(*_PLACE, "size", "key"), _PLACE, "size", val_tokens * C.CHARS_PER_TOKEN) if val_tokens else held.limit(0).withColumn("seq", F.lit(0))
    found["validation"] = write_shards(cut, held, "key", out, start=found["train"]["next_index"], docs=docs, one=True)
    notes = ["fewer than two shards"] * (found["train"]["shards"] + found["validation"]["shards"] < 2) + ["no validation shard"] * (not found["validation"]["shards"])
    return found | {"warnings": notes}


def sft_to_jsonl(sources: dict[str, DataFrame], out: str, per_source: int | None = None) -> DataFrame:
    """Pairs (`id`, `problem`, `solution`, `answer`) of each source to chat records; returns the number of records by source."""
    parts = {}
    for name, df in sources.items():
        some = D.with_answer(df, "answer")
        some = some if per_source is None else some.orderBy("id").limit(per_source)
        parts[name] = D.with_boxed(some, "solution", "answer").select("id", "problem", F.col("boxed").alias("solution"))
    mixed = materialise(D.mix(parts), "mixed")
    write_jsonl(mixed.orderBy("source_rank", "id").select(D.message_record(F.col("problem"), F.col("solution")).alias("messages")), out)
    return mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def grpo_to_jsonl(problems: DataFrame, out: str, limit: int | None = None, least: float | None = None) -> dict[str, dict]:
    """Problems (`id`, `problem`, `answer`, `source`, `level`, perhaps `solution`) of both sources to JSON lines.

    Returns for each source the number written and, with solutions, the share of them that come to the answer; below `least` it raises.
    """
    rows = D.problem_set(problems)
    rows = materialise(rows if limit is None else C.limit_per_source(rows, "source", ["id"], limit), "problems")
    write_jsonl(rows.orderBy("source", "id").select("problem", "answer", "source", "level"), out)
    found = {r["source"]: {"n": r["n"]} for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    if "solution" in rows.columns:
        for r in G.agreement(G.grade(rows.drop("is_correct"), "solution", "answer", "right"), "right", "source", least=least).collect():
            found[r["source"]]["agreement"] = r["agreement"]
    return found


def evaluate(records: DataFrame, task: str = "task", facts: dict[str, object] | None = None) -> DataFrame:
    """The report of each task over completions (`completion`, `gold`, `level`, the task): graded, one row a task."""
    graded = G.grade(records.select(task, "completion", "gold", "level"), "completion", "gold", "correct")
    return E.report(graded, task, facts=facts)


def inspect(parts: dict[str, object], text: str = "text", rows: int = P.SAMPLED) -> dict[str, dict]:
    """For each named loader (a function without arguments that gives a frame): its columns, two rows and length statistics.

    Both are of the first `rows` rows: by file and line of a scan, else by partition.

    A loader that fails gives its error instead, and the others go on.
    """
    found = {}
    for name, load in parts.items():
        try:
            df = load()
            order = _PLACE if set(_PLACE) <= set(df.columns) else [F.monotonically_increasing_id()]
            sample = df.orderBy(*order).limit(rows).select(text)
            stats = P.length_stats(sample.select(F.length(text).alias("size")), "size").first()
            shown = [r[0] for r in sample.limit(2).select(F.substring(F.replace(F.col(text), F.lit("\n"), F.lit(" ")), 1, 150)).collect()]
            found[name] = {"columns": dict(df.dtypes), "examples": shown, "lengths": stats.asDict() if stats else None}
        except Exception as e:  # reported and passed over
            found[name] = {"skipped": f"{type(e).__name__}: {str(e)[:160]}"}
    return found


def temperature(k: int, given: float | None = None) -> float:
    """Sampling temperature: the given one, else none for one sample and 1.0 for several."""
    return given if given is not None else 0.0 if k == 1 else 1.0
