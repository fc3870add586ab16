"""The queries of the training-data problems, with their production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import abuse, leakage, mixing, overlap, packing, pair_defects, splitting, tokens
from millrace.llm import near_duplicates as nd
from millrace.llm.oracles import ORACLES
from millrace.shipping import shipped
from millrace.storage import materialise
from millrace.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Near duplicates by TESTDATA.md: three words, an overlap of one half.
NEAR = {"size": 3, "threshold": 0.5}
MISSING = "(missing)"


def _documents(spark: SparkSession, sf_dir: str, *others: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", *others)


def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_row").select(F.col("eval_id").alias("id"), F.col("problem").alias("text"))


def _cap(spark: SparkSession, sf_dir: str, job: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "size_cap").where(F.lower(F.trim("job")) == job).select("capacity", "overlap").first()
    return row.capacity, row.overlap


def cleaned(column: Column) -> Column:
    """A spelling without case and outer white space, with a group of its own for missing values."""
    key = mixing.clean_key(column)
    return F.when(key.isNull() | (key == ""), F.lit(MISSING)).otherwise(key)


def language(column: Column) -> Column:
    """The primary part of a language tag; null, blank and `und` are missing."""
    tag = F.split(cleaned(column), "[-_]")[0]
    return F.when(tag == "und", F.lit(MISSING)).otherwise(tag)


def domain(meta: Column) -> Column:
    """The `domain` of a stringified dict, also of a broken one that still holds it."""
    return cleaned(F.regexp_extract(meta, r"""['"]domain['"]\s*:\s*['"]([^'"]*)['"]""", 1))


def _grpo_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    problems = table(spark, sf_dir, "grpo").select(F.col("problem_id").alias("id"), F.col("problem").alias("text"))
    return overlap.overlaps(_evaluation(spark, sf_dir), problems)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grpo_overlaps(spark, sf_dir).select(F.col("query_id").alias("eval_id"), F.col("id").alias("problem_id"))


def p1_split_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = table(spark, sf_dir, "eval_row").select(F.col("eval_id").alias("query_id"), cleaned(F.col("split")).alias("split")).dropDuplicates(["query_id"])
    source = table(spark, sf_dir, "grpo").groupBy(F.col("problem_id").alias("id")).agg(F.min(cleaned(F.col("source"))).alias("source"))
    found = _grpo_overlaps(spark, sf_dir).join(split, "query_id").join(source, "id")
    return found.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("query_id").alias("n_eval"), F.countDistinct("id").alias("n_problems"), F.avg("coverage").alias("mean_coverage")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, shared = _cap(spark, sf_dir, "split")
    spans = splitting.piece_spans(_documents(spark, sf_dir), capacity, shared).where("piece_no = 0")
    # A stretch without boundaries shows as a cut that had to be forced; its length is checked then.
    kind = F.when((F.col("forced") > 0) & (F.col("longest_run") > capacity), "forced").otherwise("natural")
    return spans.select(F.col("id").alias("doc_id"), kind.alias("cut_kind"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, shared = _cap(spark, sf_dir, "split")
    return splitting.split_texts(_documents(spark, sf_dir), capacity, shared).select(F.col("id").alias("doc_id"), "piece_no", "start", "stop", "ends", "text")


def p2_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cut document put together again from its pieces without their overlaps, as length and digest; whether all pieces are legal."""
    capacity, shared = _cap(spark, sf_dir, "split")
    pieces = p2_pieces(spark, sf_dir)
    own = F.when(F.col("piece_no") == 0, F.col("text")).otherwise(F.substring("text", F.lit(shared + 1), F.length("text")))
    legal = (F.length("text") <= capacity) & (F.length("text") == F.col("stop") - F.col("start"))
    # The pieces of one document meet in one row, which is as long as the document was.
    rows = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("p"), F.min(legal).alias("legal"))
    text = F.array_join(F.transform("p", lambda x: x["own"]), "")
    return rows.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("digest"), "legal")


def _records(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "documents": _documents(spark, sf_dir),
        "sft": table(spark, sf_dir, "sft").select(F.col("sft_id").alias("id"), nd.chat_text(F.col("messages")).alias("text")),
    }


def _near(spark: SparkSession, sf_dir: str, run: Callable) -> dict:
    """What an operator finds in both tables, whose jobs run side by side."""
    records = _records(spark, sf_dir)
    with ThreadPoolExecutor(len(records)) as pool:
        running = {name: pool.submit(run, df, **NEAR) for name, df in records.items()}
        return {name: r.result() for name, r in running.items()}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [nd.pairs(*found).select(F.lit(name).alias("table_name"), "id_a", "id_b") for name, found in _near(spark, sf_dir, nd.links).items()]
    return parts[0].unionByName(parts[1])


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [found.select(F.lit(name).alias("table_name"), "id", "rep", "group_id") for name, found in _near(spark, sf_dir, nd.groups).items()]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    question, response = pair_defects.chat_pair(F.col("messages"))
    sft = table(spark, sf_dir, "sft").select(F.lit("sft").alias("table_name"), F.col("sft_id").alias("id"), question.alias("question"), response.alias("response"), F.lit(False).alias("short"))
    grpo = table(spark, sf_dir, "grpo").select(
        F.lit("grpo").alias("table_name"), F.col("problem_id").alias("id"), F.col("problem").alias("question"), F.col("answer").alias("response"), F.lit(True).alias("short")
    )
    pairs = sft.unionByName(grpo).where(F.col("id").isNotNull())
    return pair_defects.find_defects(pairs, pair_defects.train(pairs)).withColumnRenamed("id", "rec_id")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_documents(spark, sf_dir, "subset"), table(spark, sf_dir, "mix_target"))


def p5_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target, whether the mix keeps its limit of uses and its share to one in ten thousand, and counts each document's length right."""
    uses, report = _mix(spark, sf_dir)
    limits = table(spark, sf_dir, "mix_target").select(F.trim("subset").alias("subset"), "max_repeat").dropDuplicates(["subset"])
    lengths = _documents(spark, sf_dir).select("id", F.length("text").alias("chars")).dropDuplicates(["id"])
    wrong = uses.join(lengths, "id", "left").groupBy("subset").agg(F.sum((~F.coalesce(F.col("length") == F.col("chars"), F.lit(False))).cast("long")).alias("n_wrong"))
    kept = report.join(limits, "subset").join(wrong, "subset", "left")
    near = F.abs(F.col("actual_share") - F.col("target_share")) < 1e-4
    return kept.select("subset", (F.col("most_uses") <= F.col("max_repeat")).alias("repeats_kept"), near.alias("share_kept"), F.coalesce("n_wrong", F.lit(0)).cast("long").alias("n_wrong"))


def _counted(spark: SparkSession, sf_dir: str, *others: str) -> DataFrame:
    merges = tokens.read_merges(table(spark, sf_dir, "tokenizer_merge"))
    return tokens.count_tokens(_documents(spark, sf_dir, *others), merges, list(others))


def p6_doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir).select(F.col("id").alias("doc_id"), "n_tokens")


def p6_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _counted(spark, sf_dir, "subset", "source", "lang", "meta").select(
        cleaned(F.col("subset")).alias("subset"), cleaned(F.col("source")).alias("source"), language(F.col("lang")).alias("language"), domain(F.col("meta")).alias("domain"), "n_tokens"
    )
    cells = counted.groupBy("subset", "source", "language", "domain").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    by = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("subset", "source", "language", "domain")])).alias("d")
    return cells.select(by, "n_docs", "n_tokens").groupBy("d.dimension", "d.value").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, _ = _cap(spark, sf_dir, "pack")
    items = _counted(spark, sf_dir).select("id", F.col("n_tokens").alias("size"))
    return packing.pack(items, capacity).select(F.col("id").alias("doc_id"), "part", F.col("size").alias("n_tokens"), "container", "fill")


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each document over all of its parts, and whether every container that holds one is as full as stated and within capacity."""
    capacity, _ = _cap(spark, sf_dir, "pack")
    packed = materialise(p7_containers(spark, sf_dir), "packed")
    fills = packed.where("container IS NOT NULL").groupBy("container").agg(((F.sum("n_tokens") == F.max("fill")) & (F.max("fill") == F.min("fill")) & (F.max("fill") <= capacity)).alias("right"))
    rows = packed.join(fills, "container", "left")
    return rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.min(F.coalesce("right", F.lit(True))).alias("fills_kept"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_coverage(spark, sf_dir).select("eval_id", "doc_id")


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks of which the document has half of the item's triples."""
    return p8_leaks(spark, sf_dir).where(F.col("coverage") >= 0.5).select("eval_id", "doc_id", "covered", "n_query", "coverage")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(_evaluation(spark, sf_dir), _documents(spark, sf_dir))
    return found.select(F.col("query_id").alias("eval_id"), F.col("id").alias("doc_id"), "covered", "n_query", "coverage", "alignment", "aligned", "identity")


def _abuse_scores(spark: SparkSession, sf_dir: str, *others: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "category")
    model = abuse.train(_documents(spark, sf_dir), labels)
    return abuse.score(_documents(spark, sf_dir, *others), model, list(others))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse_scores(spark, sf_dir).where(F.col("score") >= 0.5).select(F.col("id").alias("doc_id"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse_scores(spark, sf_dir).select(F.col("id").alias("doc_id"), "score")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("score") >= 0.5).cast("long")
    scored = _abuse_scores(spark, sf_dir, "source").groupBy(cleaned(F.col("source")).alias("source"))
    return scored.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(bad).alias("n_bad"), F.avg(bad.cast("double")).alias("rate"))


def queries() -> dict[str, Query]:
    every = (p1_found, p1_split_source, p2_found, p2_pieces, p2_rebuilt, p3_found, p3_groups, p4_found, p5_uses, p5_shares, p5_kept, p6_doc_tokens, p6_token_budget, p7_containers, p7_kept, p8_found, p8_coverage, p8_leaks, p9_found, p9_scores, p9_rates)
    return {q.__name__: shipped(q) for q in every}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
