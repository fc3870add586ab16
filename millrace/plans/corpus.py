"""Corpus queries over `documents`, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.strings import strip
from millrace.operators import corpus as C
from millrace.operators import profiling as P
from millrace.plans import sqltext as Q
from millrace.tables import table

#: Budget of the budget queries and of the validation shard as shares of all characters kept, documents of a shard and of a source, rows of the sampled profile.
SHARE, VALIDATION_SHARE, SHARD, HEAD, SAMPLE = 0.4, 0.01, 200, 50, P.SAMPLED
SUBSETS = ["arXiv", "Wikipedia", "ProofWiki"]
VALIDATION = "text-ug"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean(_docs(spark, sf)).select("doc_id", "source", F.length("text").cast("long").alias("size"))


def _target(spark: SparkSession, sf: str, share: float) -> int:
    """A share of the characters of the cleaned documents."""
    return int((_sized(spark, sf).agg(F.sum("size")).first()[0] or 0) * share)


def clean_docs(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", strip(F.col("text")).alias("text"))


def min_length_filter(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean(_docs(spark, sf)).select("doc_id")


def truncate_docs(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean(_docs(spark, sf), max_chars=1000).select("doc_id", "text")


def subset_filter(spark: SparkSession, sf: str) -> DataFrame:
    return C.in_subsets(_docs(spark, sf), SUBSETS).select("doc_id", "subset")


def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", C.tokens_of(F.length("text")).alias("approx_tokens"))


def balanced_order(spark: SparkSession, sf: str) -> DataFrame:
    return C.balanced_order(_sized(spark, sf), "source", ["doc_id"]).select("doc_id", "source", "round", "seq")


def budget_cut(spark: SparkSession, sf: str) -> DataFrame:
    return C.budget_cut(_sized(spark, sf).select("doc_id", "size"), ["doc_id"], "size", _target(spark, sf, SHARE)).select("doc_id", "seq", "before")


def _budgeted(spark: SparkSession, sf: str) -> DataFrame:
    return C.balanced_budget(_sized(spark, sf), "source", ["doc_id"], "size", _target(spark, sf, SHARE))


def balanced_budget(spark: SparkSession, sf: str) -> DataFrame:
    return _budgeted(spark, sf).select("doc_id", "source", "round", "seq", "size")


def shard_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _budgeted(spark, sf).select("doc_id", C.shard_of(F.col("seq"), SHARD).alias("shard"))


def shard_stats(spark: SparkSession, sf: str) -> DataFrame:
    return C.shard_stats(_budgeted(spark, sf), "size", docs=SHARD)


def val_shard(spark: SparkSession, sf: str) -> DataFrame:
    """The validation documents as one shard, numbered after those for training (one row of figures is joined to all)."""
    held = _sized(spark, sf).where(F.col("source") == VALIDATION).select("doc_id", "size")
    train = C.shard_stats(_budgeted(spark, sf), "size", docs=SHARD).select(F.col("next_index").alias("shard"))
    cut = C.budget_cut(held, ["doc_id"], "size", _target(spark, sf, VALIDATION_SHARE))
    return cut.crossJoin(F.broadcast(train)).select("doc_id", "seq", "shard")


def limit_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return C.limit_per_source(_docs(spark, sf).select("doc_id", "source"), "source", ["doc_id"], HEAD)


def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    return P.length_stats(_docs(spark, sf).select(F.length("text").alias("size")), "size")


def length_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return P.percentiles(_docs(spark, sf).select(F.length("text").alias("size")), "size", [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])


def subset_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).groupBy(F.coalesce("subset", F.lit("?")).alias("subset")).agg(F.count(F.lit(1)).alias("n"))


def preview(spark: SparkSession, sf: str) -> DataFrame:
    return P.preview(_docs(spark, sf), "doc_id", "text", chars=200)


def sampled_stats(spark: SparkSession, sf: str) -> DataFrame:
    sample = _docs(spark, sf).select("doc_id", F.length("text").alias("size")).orderBy("doc_id").limit(SAMPLE)
    return P.length_stats(sample, "size")


def unique_chars(spark: SparkSession, sf: str) -> DataFrame:
    return P.characters(_docs(spark, sf), "text")


def latex_commands(spark: SparkSession, sf: str) -> DataFrame:
    return P.latex_commands(_docs(spark, sf), "text")


def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return P.histogram(_docs(spark, sf), C.tokens_of(F.length("text")), 256)


def trim_bibliography(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", C.trim_bibliography(F.col("text")).alias("text"))


QUERIES = [
    clean_docs, min_length_filter, truncate_docs, subset_filter, token_estimate, balanced_order, budget_cut, balanced_budget, shard_assign, shard_stats, val_shard,
    limit_per_source, length_stats, length_percentiles, subset_counts, preview, sampled_stats, unique_chars, latex_commands, length_histogram, trim_bibliography,
]

_KEPT = f"kept AS (SELECT doc_id, source, least(length(t), 100000)::BIGINT AS size, t FROM (SELECT doc_id, source, {Q.strip('text')} AS t FROM documents) WHERE length(t) >= 200)"
_ORDER = f"{_KEPT}, rounds AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round FROM kept), placed AS (SELECT *, row_number() OVER (ORDER BY round, source) AS seq FROM rounds)"
_CUT = f"{_ORDER}, summed AS (SELECT *, coalesce(sum(size) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed), cut AS (SELECT * FROM summed WHERE seq = 1 OR before < (SELECT floor(sum(size) * {SHARE}::DOUBLE) FROM kept))"
_STATS = """SELECT count(*) AS n, min(s) AS min, (list_sort(list(s)))[least(count(*) - 1, floor(0.5::DOUBLE * count(*))::BIGINT) + 1] AS p50, floor(sum(s) / count(*))::BIGINT AS mean,
    (list_sort(list(s)))[least(count(*) - 1, floor(0.95::DOUBLE * count(*))::BIGINT) + 1] AS p95, max(s) AS max FROM (SELECT length(text)::BIGINT AS s FROM {rows}) WHERE s IS NOT NULL"""


def _running(rows: str, order: str, where: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS seq, coalesce(sum(size) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM {rows}) WHERE {where}"


ORACLES = {
    "clean_docs": f"SELECT doc_id, {Q.strip('text')} AS text FROM documents",
    "min_length_filter": f"WITH {_KEPT} SELECT doc_id FROM kept",
    "truncate_docs": f"WITH {_KEPT} SELECT doc_id, substring(t, 1, 1000) AS text FROM kept",
    "subset_filter": f"SELECT doc_id, subset FROM documents WHERE subset IN ({', '.join(repr(s) for s in SUBSETS)})",
    "token_estimate": "SELECT doc_id, floor(length(text) / 4.0::DOUBLE)::BIGINT AS approx_tokens FROM documents",
    "balanced_order": f"WITH {_ORDER} SELECT doc_id, source, round, seq FROM placed",
    "budget_cut": f"WITH {_KEPT} SELECT doc_id, seq, before FROM ({_running('kept', 'doc_id', f'seq = 1 OR before < (SELECT floor(sum(size) * {SHARE}::DOUBLE) FROM kept)')})",
    "balanced_budget": f"WITH {_CUT} SELECT doc_id, source, round, seq, size FROM cut",
    "shard_assign": f"WITH {_CUT} SELECT doc_id, (seq - 1) // {SHARD} AS shard FROM cut",
    "shard_stats": f"WITH {_CUT} SELECT count(*) AS docs, sum(size)::BIGINT AS chars, floor(sum(size) / 4.0::DOUBLE)::BIGINT AS approx_tokens, ceil(count(*) / {SHARD}.0)::BIGINT AS shards, ceil(count(*) / {SHARD}.0)::BIGINT AS next_index FROM cut",
    "val_shard": f"WITH {_CUT}, held AS (SELECT doc_id, size FROM kept WHERE source = '{VALIDATION}') SELECT doc_id, seq, (SELECT ceil(count(*) / {SHARD}.0)::BIGINT FROM cut) AS shard FROM ({_running('held', 'doc_id', f'seq = 1 OR before < (SELECT floor(sum(size) * {VALIDATION_SHARE}::DOUBLE) FROM kept)')})",
    "limit_per_source": f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= {HEAD}",
    "length_stats": _STATS.format(rows="documents"),
    "length_percentiles": """WITH v AS (SELECT list_sort(list(length(text)::BIGINT)) AS l FROM documents WHERE text IS NOT NULL)
        SELECT q::DOUBLE AS share, l[least(len(l) - 1, floor(q::DOUBLE * len(l))::BIGINT) + 1] AS value FROM v, unnest([0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]) AS u(q)""",
    "subset_counts": "SELECT coalesce(subset, '?') AS subset, count(*) AS n FROM documents GROUP BY 1",
    "preview": "SELECT doc_id, substring(replace(text, chr(10), ' '), 1, 200) AS text FROM documents ORDER BY doc_id LIMIT 2",
    "sampled_stats": _STATS.format(rows=f"(SELECT text FROM documents ORDER BY doc_id LIMIT {SAMPLE})"),
    "unique_chars": "SELECT c AS character, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY 1",
    "latex_commands": r"SELECT c AS command, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\[a-zA-Z]+')) AS c FROM documents) GROUP BY 1",
    "length_histogram": "SELECT (floor(floor(length(text) / 4.0::DOUBLE) / 256) * 256)::BIGINT AS bucket, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "trim_bibliography": r"SELECT doc_id, regexp_split_to_array(text, '\\(?:begin\{thebibliography\}|bibliography\{|bibliographystyle\{)')[1] AS text FROM documents",
}
