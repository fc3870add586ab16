import pytest
from pyspark.sql import functions as F

from millrace.operators import chat as D
from millrace.operators import evaluation as E
from millrace.operators import grading as G


def test_last_turn_and_render(spark):
    schema = "i int, m array<struct<role:string,content:string>>"
    rows = [(1, [("System", "s"), (" USER ", "a"), ("assistant", "b"), ("user", "c")]), (2, []), (3, None), (4, [(None, "x"), ("user", None)])]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.orderBy("i").select(D.last_turn(F.col("m"), "user")).collect()] == ["c", None, None, None]
    assert df.where("i = 1").select(D.render(F.col("m"))).first()[0].endswith("<|im_start|>user\nc<|im_end|>\n<|im_start|>assistant\n")


def test_with_boxed(spark):
    rows = [("work\n\\boxed{5}", "5", "work\n\\boxed{5}"), ("so 5", "5", "so 5\nThe final answer is $\\boxed{5}$."), ("\\boxed{4} ", "5", "\\boxed{4}\nThe final answer is $\\boxed{5}$.")]
    df = spark.createDataFrame(rows, "s string, a string, want string")
    assert D.with_boxed(df, "s", "a").where("boxed <> want").count() == 0


def test_mix_and_jsonl(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, p string"), spark.createDataFrame([(2, 3)], "i int, level int")
    out = D.mix({"one": a, "two": b}).orderBy("i")
    assert [(r.source, r.source_rank, r.level) for r in out.collect()] == [("one", 0, None), ("two", 1, 3)]
    assert out.select(D.to_jsonl("p", "level")).first()[0] == '{"p":"x","level":null}'


def test_tasks_and_nested_turns(spark):
    tasks = {"one": lambda: spark.range(2)}
    assert D.load_task("one", tasks).count() == 2
    with pytest.raises(ValueError):
        D.load_task("two", tasks)
    turns = spark.createDataFrame([(1, 1, "user", "b"), (1, 0, None, "a"), (1, 1, "user", "b"), (2, 0, "user", None)], "id int, turn int, role string, content string")
    found = {r.id: [(m.role, m.content) for m in r.messages] for r in D.nested(turns, ["id"], "turn").collect()}
    assert found == {1: [(None, "a"), ("user", "b")], 2: [("user", None)]}


def test_reward_function(spark):
    rewards = G.reward_function(spark, no_answer=-0.5)
    assert rewards(["so \\boxed{5}", [{"role": "assistant", "content": "#### 6"}], "nothing", [], None], ["5", "5", "5", "5", "5"]) == [1.0, -1.0, -0.5, -0.5, -0.5]


def samples(spark):
    rows = [("m", 1, 0, False, 1), ("m", 1, 1, True, 1), ("m", 2, 0, False, None), ("m", 2, 1, False, None), ("n", 1, 0, True, 1), ("n", 2, 0, True, None), ("m", 3, 0, None, 2)]
    return spark.createDataFrame(rows, "model string, eval_id int, sample_idx int, correct boolean, level int")


def test_scores(spark):
    df = samples(spark)
    assert {r.model: r.accuracy for r in E.accuracy(df, ["model"]).collect()} == {"m": 0.2, "n": 1.0}
    assert E.accuracy(df.limit(0), []).first().accuracy == 0.0
    rates = [E.pass_at_k(df.where("model = 'm'"), ["model"], "eval_id", "sample_idx", k).first().pass_rate for k in (1, 2)]
    assert rates[0] == 0.0 and rates[1] == pytest.approx(1 / 3)
    assert [r.eval_id for r in E.model_diff(df, "model", "m", "n", "eval_id").collect()] == [2]
    first = E.first_records(df.where("model = 'm'"), ["eval_id"], "sample_idx", ["correct"]).orderBy("eval_id").collect()
    assert [(r.correct, r.any_correct) for r in first] == [(False, True), (False, False), (None, False)]


def test_running_accuracy(spark):
    df = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "i int, correct boolean")
    found = E.running_accuracy(df, ["i"], batch=4).orderBy("batch").collect()
    assert [(r.batch, r.n, round(r.accuracy, 6)) for r in found] == [(1, 4, 0.5), (2, 8, 0.5), (3, 10, 0.5)]


def test_advantages_sum_to_nothing(spark):
    df = spark.createDataFrame([(g, float(i)) for g in "ab" for i in range(4)] + [("c", 1.0)], "g string, r double")
    out = E.advantages(df, ["g"], "r")
    assert all(abs(r.s) < 1e-9 for r in out.groupBy("g").agg(F.sum("advantage").alias("s")).collect())
    flat = E.reward_groups(df.withColumn("run", F.lit(1)), ["run"], ["g"], "r").first()
    assert (flat.n_groups, flat.n_flat) == (3, 1)


def test_bits_per_byte(spark):
    df = spark.createDataFrame([("a", 8.0, 4, "é"), ("a", 8.0, 4, "ab"), ("b", 1.0, 0, ""), ("b", None, None, None)], "g string, loss double, n int, t string")
    found = {r.g: r for r in E.bits_per_byte(df, ["g"], "loss", "n", "t").collect()}
    assert found["a"].bits_per_byte == pytest.approx(16 / 0.6931471805599453 / 4) and found["a"].perplexity == pytest.approx(7.38905609893065)
    assert found["b"].bits_per_byte is None and found["b"].perplexity is None


def test_expand(spark):
    assert E.expand_k(spark.range(3), 4).count() == 12
    with pytest.raises(ValueError):
        E.expand_k(spark.range(3), 0)


def test_reward_and_agreement(spark):
    df = spark.createDataFrame([("\\boxed{1}", "1"), ("none", "1"), ("\\boxed{2}", "1"), (None, "1")], "c string, g string")
    graded = G.grade(df, "c", "g")
    found = graded.select(G.reward(F.col("answer"), F.col("is_correct"), no_answer=-1.5).alias("r")).collect()
    assert sorted(r.r for r in found) == [-1.5, -1.5, -1.0, 1.0]
    assert G.agreement(graded, "is_correct").first().agreement == 0.25
    assert G.agreement(graded.limit(0), "is_correct").first().agreement == 1.0
    with pytest.raises(ValueError):
        G.agreement(graded, "is_correct", least=0.85)
    nested = spark.createDataFrame([([("assistant", "x")],), ([],), (None,)], "m array<struct<role:string,content:string>>")
    assert [r[0] for r in nested.select(G.completion_text(F.col("m"), True)).collect()] == ["x", "", ""]


def test_solve(spark):
    df = spark.createDataFrame([("2 + 2 = 5\nThe answer is 5",), ("\\boxed{3}\nuser: hi",)], "c string")
    found = {r.raw_answer: (r.answer, r.errors, r.corrected) for r in G.solve(df, "c").collect()}
    assert found == {"5": ("4", 1, True), "3": ("3", 0, False)}
