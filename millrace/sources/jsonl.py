"""Compressed or plain JSON lines in a directory tree, and datasets with a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.strings import strip

CORPUS = T.StructType([T.StructField("text", T.StringType()), T.StructField("subset", T.StringType()), T.StructField("meta", T.StringType())])
GSM = T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())])
MATH = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("problem", "solution", "answer", "subject")] + [T.StructField("level", T.IntegerType()), T.StructField("unique_id", T.StringType())]
)
OMI = T.StructType([T.StructField(c, T.StringType()) for c in ("problem", "generated_solution", "expected_answer", "problem_source")])
_BAD = "_corrupt_record"


def _has(spark: SparkSession, folder: str, ending: str) -> bool:
    """Whether a file of that ending lies in the tree; the listing stops at the first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return False
    files = system.listFiles(root, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(ending):
            return True
    return False


def split_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/validation/")), "validation").otherwise("train")


def source_of(path: Column) -> Column:
    """The name of a file's directory."""
    return F.element_at(F.split(path, "/"), -2)


def read_lines(spark: SparkSession, folder: str, schema: T.StructType = CORPUS, *, keep_bad: bool = False) -> DataFrame:
    """Rows of all *.jsonl.gz of a tree, or of all *.jsonl if there is none; an error if there is neither.

    Adds `split`, `source`, and the place of a row: `file`, `block`, `line` (only its order counts). Lines that are no JSON object
    are left out, or kept with `keep_bad` in the column `bad_line`.
    """
    ending = next((e for e in (".jsonl.gz", ".jsonl") if _has(spark, folder, e)), None)
    if ending is None:
        raise FileNotFoundError(f"no *.jsonl.gz and no *.jsonl in {folder}")
    full = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").text(folder)
    path = F.col("_metadata.file_path")
    placed = lines.select("value", path.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    placed = placed.where(strip(F.col("value")) != "")
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    rows = placed.select(parsed.alias("_row"), "value", "file", "block", "line", split_of(F.col("file")).alias("split"), source_of(F.col("file")).alias("source"))
    bad = F.col("_row").isNull() | F.col(f"_row.{_BAD}").isNotNull()
    columns = [F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields] + ["file", "block", "line", "split", "source"]
    if keep_bad:
        return rows.select(*columns, F.when(bad, F.col("value")).alias("bad_line"))
    return rows.where(~bad).select(*columns)


def first_file(rows: DataFrame) -> DataFrame:
    """The rows of the first file by name."""
    first = rows.agg(F.min("file").alias("first"))
    return rows.join(F.broadcast(first), F.col("file") == F.col("first")).drop("first")


def source_positions(rows: DataFrame) -> DataFrame:
    """`source`, `source_pos`: sources in the order of their first file. A row for each source."""
    firsts = rows.groupBy("source").agg(F.min("file").alias("first"))
    return firsts.select("source", F.row_number().over(Window.partitionBy(F.lit("all")).orderBy("first", "source")).alias("source_pos"))


def read_dataset(spark: SparkSession, path: str, schema: T.StructType, form: str = "json") -> DataFrame:
    """A dataset of that schema; columns that it lacks are null."""
    return spark.read.schema(schema).format(form).load(path)


def head(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in order; n must be positive."""
    if n < 1:
        raise ValueError("n must be positive")
    return rows.orderBy(*order).limit(n)
