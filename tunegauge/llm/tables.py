"""Helpers that the operators share: reading tables, tables written to the shared folder, Arrow batches in small slices."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tunegauge.session import shared_folder

#: Rows that a Python task holds as Python objects at a time; long texts make even these large.
SLICE = 128
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def share_code(spark: SparkSession) -> None:
    """Let Python workers that start in another folder find this package; on a cluster it is installed on the executors."""
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH")]))


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python tasks in Arrow batches of 1,000, unless the session has a size of its own.

    Texts are long: 10,000 of them, Spark's default, take many MB in the JVM and again in each Python worker of a task.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read back: computed once, and safe when executors are lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores added as it takes to differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
