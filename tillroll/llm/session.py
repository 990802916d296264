"""Session settings and the shared scratch tables of the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path, tune

# Texts differ much in length; small batches keep the memory of a Python worker low.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


PACKAGE = Path(__file__).resolve().parents[1]
_sent_to: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Let Spark hand this package to the Python workers of all executors, once."""
    context = spark.sparkContext
    if context.applicationId not in _sent_to:
        _sent_to.add(context.applicationId)
        folder = tempfile.mkdtemp()  # of the driver; Spark serves the file from there
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        name = f"{folder}/{PACKAGE.name}"
        context.addPyFile(shutil.make_archive(name, "zip", PACKAGE.parent, PACKAGE.name))


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in ARROW_SETTINGS.items():
        spark.conf.set(key, value)
    send_package(spark)
    return tune(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder now and read it back: lineage ends there, and an
    executor that is lost later takes nothing of it along."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
