"""Sinks: numbered Parquet shards, JSON lines and reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.corpus import SHARD_DOCS, shard_of, shard_stats
from millrace.storage import materialise


def shard_name(index: int) -> str:
    return f"shard_{index:05d}.parquet"


def write_shards(kept: DataFrame, texts: DataFrame, key: str, folder: str, *, start: int = 0, docs: int = SHARD_DOCS, one: bool = False) -> dict:
    """Writes the texts of the kept rows (`key`, `seq`, `size`) in order, `docs` to a file named shard_NNNNN.parquet with one column.

    With `one` all of them make one shard. The files are written to a side folder by one job and moved to their names after
    its commit. Returns the next index and the numbers of shards, documents, characters and tokens; no rows, no file.
    """
    spark = kept.sparkSession
    shard = F.lit(start).cast("long") if one else shard_of(F.col("seq"), docs, start)
    rows = materialise(kept.select(key, "seq", "size", shard.alias("shard")), "kept")
    stats = shard_stats(rows, "size", start, docs).first().asDict()
    stats["shards"] = min(stats["shards"], 1) if one else stats["shards"]
    stats["next_index"] = start + stats["shards"]
    if not stats["docs"]:
        return stats
    side = f"{folder.rstrip('/')}/_side-{uuid.uuid4().hex}"
    full = rows.join(texts.select(key, "text"), key)
    full.repartitionByRange(stats["shards"], "shard").sortWithinPartitions("shard", "seq").select("shard", "text").write.partitionBy("shard").parquet(side)
    paths = spark._jvm.org.apache.hadoop.fs.Path
    system = paths(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in system.listStatus(paths(side)):
        name = part.getPath().getName()
        if not name.startswith("shard="):
            continue
        files = [f.getPath() for f in system.listStatus(part.getPath()) if f.getPath().getName().startswith("part-")]
        if len(files) != 1:
            raise RuntimeError(f"{len(files)} files for {name}")
        target = paths(f"{folder.rstrip('/')}/{shard_name(int(name.split('=')[1]))}")
        system.delete(target, False)
        if not system.rename(files[0], target):
            raise OSError(f"cannot move {files[0]} to {target}")
    system.delete(paths(side), True)
    return stats


def write_jsonl(df: DataFrame, folder: str) -> None:
    """One JSON object a line, with nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def _small(table: DataFrame, most: int) -> list:
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return rows


def report_text(report: DataFrame, most: int = 10_000) -> str:
    """A small table as indented JSON, doubles rounded to four places; an error beyond `most` rows."""
    rows = _small(report, most)
    return json.dumps([{k: round(v, 4) if isinstance(v, float) else v for k, v in r.asDict(recursive=True).items()} for r in rows], indent=2, ensure_ascii=False, default=str)


def markdown_report(title: str, parts: dict[str, DataFrame], most: int = 10_000) -> str:
    """Small tables as text in a fence, every row of them; an error beyond `most` rows."""
    out = [f"# {title}", "", "```"]
    for name, df in parts.items():
        lines = [df.columns] + [["null" if v is None else str(v) for v in r] for r in _small(df, most)]
        widths = [max(map(len, column)) for column in zip(*lines, strict=True)]
        out += [name, *("  ".join(v.ljust(w) for v, w in zip(line, widths, strict=True)).rstrip() for line in lines), ""]
    return "\n".join([*out, "```", ""])
