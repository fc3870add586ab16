"""Makes the package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from millrace.storage import shared_dir

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once; through the shared folder, if that is a file system path."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    folder = shared_dir(spark)
    if folder.startswith("file:") or "://" not in folder:
        path = Path("/" + folder.removeprefix("file:").lstrip("/")) / f"millrace-{uuid.uuid4().hex}.zip"
        os.makedirs(path.parent, exist_ok=True)
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for source in sorted(_ROOT.rglob("*.py")):
                z.write(source, f"{_ROOT.name}/{source.relative_to(_ROOT)}")
        path.write_bytes(held.getvalue())
        context.addPyFile(str(path))
    context._millrace_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after ship()."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
