"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session without one gets its own."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"{SETTING} must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set(SETTING, own)
    _made.append((spark, own))
    return own


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, after: int = 0) -> None:
    """Deletes what materialise() wrote for this session, but for the first `after` tables of the process.

    Results that still read it must have been written before.
    """
    kept = _made[:after]
    for owner, path in _made[after:]:
        if owner is not spark:
            kept.append((owner, path))
            continue
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if spark.conf.get(SETTING, None) == path:
            spark.conf.unset(SETTING)
    _made[:] = kept


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside the block are deleted at its end: for a query whose result is written inside it."""
    shared_dir(spark)
    before = len(_made)
    try:
        yield
    finally:
        clear(spark, before)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if path.startswith("file:"):
                shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
            else:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session may be gone already
            continue
