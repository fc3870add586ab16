"""Accuracy of completions as their files arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.grading import grade
from millrace.storage import shared_dir

# Ids that were counted are kept on local disk, in bounded memory.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def stream_accuracy(
    spark: SparkSession, path: str, by: list[str], right: str, files_per_trigger: int = 4, key: str | None = None, answers: tuple[str, str] | None = None
) -> DataFrame:
    """Accuracy by group over a file stream, after all files that are there now: `by`, `n`, `correct`.

    Rows whose group is null are a group of their own. With `key`, rows repeated under one key count once, in whichever files they arrive; with `answers` (completion, gold),
    completions are graded, and `right` is the name of the grade, not a column.
    The aggregate state is a row a group, and with `key` each key; each trigger reads some of the files, and the result of the
    last one is returned.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():  # a stream reads a folder
        rows = reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    else:
        rows = reader.parquet(path)
    if answers:
        rows = grade(rows.select(*dict.fromkeys([*by, *([key] if key else []), *answers])), *answers, right)
    if key:
        rows = rows.select(key, *by, right).dropDuplicates([key])
    live = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col(right), F.lit(False)).cast("long")).alias("correct"))
    out = f"{shared_dir(spark)}/millrace-live-{uuid.uuid4().hex}"

    def keep(part: DataFrame, epoch: int) -> None:
        part.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items() if key else ():
        spark.conf.set(k, v)
    query = live.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{out}-log").foreachBatch(keep).start()
    for k, v in before.items() if key else ():  # the query has its own copy
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    query.awaitTermination()
    epochs = spark.read.schema(live.schema.add("epoch", "long")).parquet(out)
    last = epochs.agg(F.max("epoch").alias("last"))
    return epochs.join(F.broadcast(last), F.col("epoch") == F.col("last")).select(*by, "n", "correct")
