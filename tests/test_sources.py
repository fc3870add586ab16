import gzip
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import corpus as C
from millrace import storage
from millrace.plans import pipelines
from millrace.sources import jsonl, shards
from millrace.streaming.generation import oracle, with_completions
from millrace.streaming.live_accuracy import stream_accuracy


def fill(root, files, pack):
    for name, lines in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        (gzip.open if pack else open)(path, "wt", encoding="utf-8").write("\n".join(lines) + "\n")


LINES = [json.dumps({"text": f"document {i} " + "x" * 300, "subset": "s", "more": 1}) for i in range(30)]


def test_read_lines(spark, tmp_path):
    fill(tmp_path, {"train/b/1.jsonl.gz": LINES[:10], "train/a/1.jsonl.gz": [*LINES[10:15], "", "{broken", "[1]", '[{"text": "a"}]', '{"text": null}'], "validation/a/1.jsonl.gz": LINES[15:20]}, True)
    fill(tmp_path, {"train/c/1.jsonl": LINES[20:]}, False)
    rows = jsonl.read_lines(spark, str(tmp_path)).cache()
    assert {(r.source, r.split): r.n for r in rows.groupBy("source", "split").agg(F.count("*").alias("n")).collect()} == {("a", "train"): 6, ("b", "train"): 10, ("a", "validation"): 5}
    order = [r.text for r in rows.where("source = 'b'").orderBy("file", "block", "line").collect()]
    assert order == [json.loads(x)["text"] for x in LINES[:10]]
    assert {r.source: r.source_pos for r in jsonl.source_positions(rows.where("split = 'train'")).collect()} == {"a": 1, "b": 2}
    assert {r.source for r in jsonl.first_file(rows).select("source").collect()} == {"a"}
    bad = jsonl.read_lines(spark, str(tmp_path), keep_bad=True)
    assert [r.bad_line for r in bad.where("bad_line is not null").orderBy("file", "line").collect()] == ["{broken", "[1]", '[{"text": "a"}]']


def test_plain_lines_only_without_packed_ones(spark, tmp_path):
    fill(tmp_path, {"train/c/1.jsonl": LINES}, False)
    assert jsonl.read_lines(spark, str(tmp_path)).count() == 30
    with pytest.raises(FileNotFoundError):
        jsonl.read_lines(spark, str(tmp_path / "none"))


def test_shards_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(47)], "doc_id long, text string").withColumn("size", F.length("text").cast("long"))
    kept = C.budget_cut(docs.select("doc_id", "size"), ["doc_id"], "size", 10**9)
    stats = shards.write_shards(kept, docs, "doc_id", str(tmp_path), docs=20)
    assert (stats["docs"], stats["shards"], stats["next_index"]) == (47, 3, 3)
    assert sorted(p.name for p in tmp_path.iterdir() if p.suffix == ".parquet") == [shards.shard_name(i) for i in range(3)]
    for i, n in enumerate((20, 20, 7)):
        found = spark.read.parquet(str(tmp_path / shards.shard_name(i)))
        assert found.columns == ["text"] and [r.text for r in found.collect()] == [f"text {j}" for j in range(20 * i, 20 * i + n)]
    held = shards.write_shards(kept, docs, "doc_id", str(tmp_path), start=3, one=True)
    assert held["next_index"] == 4 and spark.read.parquet(str(tmp_path / shards.shard_name(3))).count() == 47
    assert shards.write_shards(kept.limit(0), docs, "doc_id", str(tmp_path), start=9)["docs"] == 0


def test_jsonl_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 0.123456)], "i int, v double")
    shards.write_jsonl(df, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["i"]) == [{"i": 1, "v": None}, {"i": 2, "v": 0.123456}]
    assert json.loads(shards.report_text(df))[1]["v"] == 0.1235
    assert "```" in shards.markdown_report("t", {"part": df})


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i % 2 == 0) for i in range(60)], "level int, correct boolean")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    found = {r.level: (r.n, r.correct) for r in stream_accuracy(spark, str(tmp_path / "in"), ["level"], "correct", 2).collect()}
    assert found == {level: (20, 10) for level in range(3)}


def test_stream_keeps_groups_without_a_name(spark, tmp_path):
    spark.createDataFrame([(1, True), (None, True), (None, None)], "level int, correct boolean").write.parquet(str(tmp_path / "in"))
    assert {r.level: (r.n, r.correct) for r in stream_accuracy(spark, str(tmp_path / "in"), ["level"], "correct").collect()} == {1: (1, 1), None: (2, 1)}


def test_reports_are_whole_or_an_error(spark):
    df = spark.range(80)
    assert all(f"\n{i}\n" in shards.markdown_report("t", {"part": df}) for i in range(80))
    with pytest.raises(ValueError):
        shards.markdown_report("t", {"part": df}, 50)
    with pytest.raises(ValueError):
        shards.report_text(df, 50)


def test_scope_drops_its_tables_only(spark):
    import os

    kept = storage.materialise(spark.range(3), "kept")
    with storage.scope(spark):
        gone = storage.materialise(spark.range(3), "gone")
        assert gone.count() == 3
        path = gone.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(path) and kept.count() == 3


def test_grpo_and_evaluation(spark, tmp_path):
    schema = "id int, problem string, answer string, source string, level int, solution string"
    rows = [(1, "p", "so\n#### 1,000", "gsm8k", None, "so 1000"), (2, "q", " 7 ", "math", 3, "it is 8"), (3, "r", "none", "gsm8k", None, "x"), (4, "s", " ", "math", 1, "x"), (5, "t", "1", "omi", 1, "1")]
    found = pipelines.grpo_to_jsonl(spark.createDataFrame(rows, schema), str(tmp_path / "g"))
    assert found == {"gsm8k": {"n": 1, "agreement": 1.0}, "math": {"n": 1, "agreement": 0.0}}
    lines = [json.loads(x) for p in sorted((tmp_path / "g").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [{"problem": "p", "answer": "1,000", "source": "gsm8k", "level": None}, {"problem": "q", "answer": "7", "source": "math", "level": 3}]
    with pytest.raises(ValueError):
        pipelines.grpo_to_jsonl(spark.createDataFrame(rows, schema), str(tmp_path / "h"), least=0.85)
    graded = spark.createDataFrame([("math", "so \\boxed{5}", "5", 2), ("math", None, "5", 2), ("math", "6", "5", None), ("gsm8k", "#### 3", "3", None)], "task string, completion string, gold string, level int")
    report = {r.task: json.loads(r.report) for r in pipelines.evaluate(graded, facts={"model": "m", "k": 1}).collect()}
    assert report["math"] == {"model": "m", "k": 1, "task": "math", "n": 3, "correct": 1, "accuracy": 0.3333, "by_level": {"2": {"correct": 1, "total": 2}}}
    assert report["gsm8k"]["by_level"] == {} and report["gsm8k"]["accuracy"] == 1.0


def test_stream_grades_and_counts_records_once(spark, tmp_path):
    def row(i):
        return (i, i % 3, i % 2 == 0, "7", f"so\n#### {7 if i % 4 else 8}" if i else None)

    schema = "record_id long, level int, correct boolean, gold string, completion string"
    for part in (range(30), range(20, 60)):  # ten records come again in a later file
        spark.createDataFrame([row(i) for i in part] + [row(part[0])], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = stream_accuracy(spark, str(tmp_path / "in"), ["level"], "correct", 1, key="record_id", answers=("completion", "gold"))
    assert {r.level: (r.n, r.correct) for r in live.collect()} == {level: (20, sum(1 for i in range(60) if i % 3 == level and i % 4)) for level in range(3)}


def test_generation(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "p string")
    found = {r.p: r.completion for r in with_completions(df, "p", oracle({"a": "1"})).collect()}
    assert found == {"a": "\\boxed{1}", "b": "\\boxed{0}", None: "\\boxed{0}"}


def test_corpus_to_shards(spark, tmp_path):
    def docs(name, n):
        return [json.dumps({"text": f"{name} {i} " + "x" * 40, "subset": name}) for i in range(n)] + [json.dumps({"text": "short"}), "{"]

    fill(tmp_path / "in", {"train/b/1.jsonl.gz": docs("b", 60), "train/a/2.jsonl.gz": docs("a", 30), "validation/a/1.jsonl.gz": docs("v", 10)}, True)
    out = tmp_path / "out"
    out.mkdir()
    found = pipelines.corpus_to_shards(spark, str(tmp_path / "in"), str(out), target_tokens=10**6, val_tokens=10**6, docs=25, min_chars=20)
    assert (found["train"]["docs"], found["train"]["shards"], found["validation"]["docs"], found["warnings"]) == (90, 4, 10, [])
    texts = [[r.text.split()[0] + r.text.split()[1] for r in spark.read.parquet(str(out / shards.shard_name(i))).collect()] for i in range(5)]
    order = [x for i in range(30) for x in (f"a{i}", f"b{i}")] + [f"b{i}" for i in range(30, 60)]
    assert sum(texts[:4], []) == order and texts[4] == [f"v{i}" for i in range(10)]
    few = pipelines.corpus_to_shards(spark, str(tmp_path / "in"), str(tmp_path / "few"), target_tokens=1, subsets=["b"], min_chars=20) if (tmp_path / "few").mkdir() is None else None
    assert few["train"]["docs"] == 1 and few["warnings"] == ["fewer than two shards", "no validation shard"]


def test_sft_and_inspect(spark, tmp_path):
    df = spark.createDataFrame([(1, "p", "so 5", "5"), (2, "q", "x", " ")], "id int, problem string, solution string, answer string")
    assert {r.source: r.n for r in pipelines.sft_to_jsonl({"one": df, "two": df}, str(tmp_path / "o"), 1).collect()} == {"one": 1, "two": 1}
    found = pipelines.inspect({"good": lambda: df, "bad": lambda: 1 / 0}, "problem")
    assert found["good"]["lengths"]["n"] == 2 and "ZeroDivisionError" in found["bad"]["skipped"]
    assert (pipelines.temperature(1), pipelines.temperature(4), pipelines.temperature(4, 0.5)) == (0.0, 1.0, 0.5)
