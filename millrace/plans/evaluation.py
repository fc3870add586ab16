"""Evaluation queries over `eval_record` and `eval_row`, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import evaluation as E
from millrace.operators.grading import reward
from millrace.plans import sqltext as Q
from millrace.streaming.live_accuracy import stream_accuracy
from millrace.tables import table

#: Samples of a problem that pass@k looks at, completions of a batch, the models compared.
K, BATCH = 4, 64
MODEL_A, MODEL_B = "abacus-1b", "abacus-1b-rl"
#: What the report says of its run.
FACTS = {"model": "all", "adapter": None, "backend": "records", "k": K, "limit": None}


def _records(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "eval_record").select("record_id", *columns).distinct()


def _with_task(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    tasks = table(spark, sf, "eval_row").select("eval_id", "task")
    return _records(spark, sf, "eval_id", *columns).join(tasks, "eval_id")


def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return E.accuracy(_records(spark, sf, "run_id", "correct"), ["run_id"])


def accuracy_by_level(spark: SparkSession, sf: str) -> DataFrame:
    return E.accuracy(_records(spark, sf, "run_id", "level", "correct").where("level IS NOT NULL"), ["run_id", "level"])


def pass_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return E.pass_at_k(_records(spark, sf, "run_id", "eval_id", "sample_idx", "correct"), ["run_id"], "eval_id", "sample_idx", K)


def eval_records(spark: SparkSession, sf: str) -> DataFrame:
    # Repeated rows change neither a first sample nor whether any is right, so they stay.
    rows = table(spark, sf, "eval_record").select("run_id", "eval_id", "sample_idx", "predicted", "completion", "correct")
    return E.first_records(rows, ["run_id", "eval_id"], "sample_idx", ["predicted", "completion"])


def running_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return E.running_accuracy(_records(spark, sf, "correct"), ["record_id"], batch=BATCH)


def expand_k(spark: SparkSession, sf: str) -> DataFrame:
    return E.expand_k(table(spark, sf, "eval_row").select("eval_id", "problem"), K)


def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    return E.report(_with_task(spark, sf, "level", "correct"), "task", facts=FACTS)


def model_diff(spark: SparkSession, sf: str) -> DataFrame:
    return E.model_diff(_records(spark, sf, "model", "eval_id", "correct"), "model", MODEL_A, MODEL_B, "eval_id")


def progression(spark: SparkSession, sf: str) -> DataFrame:
    return E.progression(_with_task(spark, sf, "run_id", "correct"), "run_id", "task", ["gsm8k", "math"])


def _rewards(spark: SparkSession, sf: str) -> DataFrame:
    gained = reward(F.coalesce("predicted", F.lit("")), F.coalesce("correct", F.lit(False)))
    return _records(spark, sf, "run_id", "eval_id", "predicted", "correct").select("record_id", "run_id", "eval_id", gained.alias("reward"))


def advantage_mean(spark: SparkSession, sf: str) -> DataFrame:
    found = E.advantages(_rewards(spark, sf), ["run_id", "eval_id"], "reward")
    return found.select("record_id", F.round("advantage", 9).alias("advantage"))


def advantage_std(spark: SparkSession, sf: str) -> DataFrame:
    found = E.advantages(_rewards(spark, sf), ["run_id", "eval_id"], "reward")
    return found.select("record_id", F.round("advantage_std", 6).alias("advantage"))


def reward_groups(spark: SparkSession, sf: str) -> DataFrame:
    return E.reward_groups(_rewards(spark, sf), ["run_id"], ["eval_id"], "reward")


def live_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy by level of graded completions as they arrive, each record once; records without a level are left out here."""
    return stream_accuracy(spark, f"{sf}/eval_record.parquet", ["level"], "correct", key="record_id", answers=("completion", "gold")).where(F.col("level").isNotNull())


QUERIES = [
    accuracy, accuracy_by_level, pass_at_k, eval_records, running_accuracy, expand_k, eval_report, model_diff, progression, advantage_mean, advantage_std, reward_groups, live_accuracy,
]

_R = f"r AS (SELECT *, coalesce(correct, false) AS hit FROM {Q.RECORDS})"
_COUNTS = "count(*) AS n, sum(hit::INTEGER)::BIGINT AS correct, avg(hit::INTEGER) AS accuracy"
_REWARD = f"WITH {_R}, g AS (SELECT *, CASE WHEN hit THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS reward FROM r)"

ORACLES = {
    "accuracy": f"WITH {_R} SELECT run_id, {_COUNTS} FROM r GROUP BY run_id",
    "accuracy_by_level": f"WITH {_R} SELECT run_id, level, {_COUNTS} FROM r WHERE level IS NOT NULL GROUP BY run_id, level",
    "pass_at_k": f"WITH {_R}, s AS (SELECT run_id, eval_id, bool_or(hit) AS solved FROM r WHERE sample_idx < {K} GROUP BY ALL) SELECT run_id, count(*) AS n, sum(solved::INTEGER)::BIGINT AS n_solved, avg(solved::INTEGER) AS pass_rate FROM s GROUP BY run_id",
    "eval_records": f"WITH {_R}, f AS (SELECT run_id, eval_id, predicted, completion, row_number() OVER (PARTITION BY run_id, eval_id ORDER BY sample_idx) AS i, bool_or(hit) OVER (PARTITION BY run_id, eval_id) AS any_correct FROM r) SELECT run_id, eval_id, predicted, completion, any_correct FROM f WHERE i = 1",
    "running_accuracy": f"WITH {_R}, o AS (SELECT hit, row_number() OVER (ORDER BY record_id) AS i, sum(hit::INTEGER) OVER (ORDER BY record_id) AS hits FROM r), b AS (SELECT ((i - 1) // {BATCH}) + 1 AS batch, max(i) AS n, max(hits) AS hits FROM o GROUP BY 1) SELECT batch, n, hits / n AS accuracy FROM b",
    "expand_k": f"SELECT eval_id, problem, s::INTEGER AS sample_idx FROM eval_row, unnest(range({K})) AS u(s)",
    "eval_report": f"""WITH {_R}, t AS (SELECT r.*, e.task FROM r JOIN eval_row e USING (eval_id)), l AS (SELECT task, level, sum(hit::INTEGER) AS c, count(*) AS k FROM t WHERE level IS NOT NULL GROUP BY ALL),
        m AS (SELECT task, string_agg('"' || level || '":{{"correct":' || c || ',"total":' || k || '}}', ',' ORDER BY level) AS by_level FROM l GROUP BY task),
        g AS (SELECT task, {_COUNTS}, coalesce(any_value(by_level), '') AS by_level FROM t LEFT JOIN m USING (task) GROUP BY task)
        SELECT task, n, correct, accuracy, '{{"model":"all","adapter":null,"backend":"records","k":{K},"limit":null,"task":"' || task || '","n":' || n || ',"correct":' || correct || ',"accuracy":' || round(accuracy, 4) || ',"by_level":{{' || by_level || '}}}}' AS report FROM g""",
    "model_diff": f"WITH {_R} SELECT eval_id FROM r GROUP BY eval_id HAVING bool_or(hit) FILTER (model = '{MODEL_A}') = false AND bool_or(hit) FILTER (model = '{MODEL_B}')",
    "progression": f"WITH {_R}, t AS (SELECT r.run_id, r.hit, e.task FROM r JOIN eval_row e USING (eval_id)) SELECT run_id, avg(hit::INTEGER) FILTER (task = 'gsm8k') AS gsm8k, avg(hit::INTEGER) FILTER (task = 'math') AS math FROM t GROUP BY run_id",
    "advantage_mean": f"{_REWARD} SELECT record_id, round(reward - avg(reward) OVER (PARTITION BY run_id, eval_id), 9) AS advantage FROM g",
    "advantage_std": f"{_REWARD} SELECT record_id, round((reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-6::DOUBLE), 6) AS advantage FROM g WINDOW w AS (PARTITION BY run_id, eval_id)",
    "reward_groups": f"{_REWARD}, s AS (SELECT run_id, eval_id, max(reward) = min(reward) AS flat FROM g GROUP BY ALL) SELECT run_id, count(*) AS n_groups, sum(flat::INTEGER)::BIGINT AS n_flat FROM s GROUP BY run_id",
    "live_accuracy": f"WITH {Q.graded(Q.RECORDS, 'completion', 'gold', 'record_id, level')} SELECT level, count(*) AS n, sum(ok::INTEGER)::BIGINT AS correct FROM graded WHERE level IS NOT NULL GROUP BY level",
}
