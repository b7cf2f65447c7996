"""Sources and sinks. Every write is a Spark job into a folder; nothing passes through the driver."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunegauge.operators.clean import require_columns
from tunegauge.operators.quantiles import same
from tunegauge.schema import RAW_TRACKS, REQUIRED_RAW


def read_raw_csv(
    spark: SparkSession, path: str, schema: T.StructType = RAW_TRACKS, required: list[str] = REQUIRED_RAW
) -> DataFrame:
    """Delimited track table with a header. Columns are matched by the header, types come from ``schema``.

    The header line decides which columns exist, so a missing required column raises before any job over the data.
    """
    header = spark.read.option("header", True).csv(path).columns
    types = {f.name: f.dataType for f in schema}
    text = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    frame = spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(path)
    return require_columns(frame, required)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_keyed_json(spark: SparkSession, path: str, root: str, value: T.DataType) -> DataFrame:
    """A keyed JSON document ``{root: {key: value}}`` as rows (key, value fields...)."""
    schema = T.StructType([T.StructField(root, T.MapType(T.StringType(), value))])
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode(root))
    return rows.select("key", "value.*") if isinstance(value, T.StructType) else rows


def write_keyed_json(df: DataFrame, path: str) -> None:
    """One JSON object per line and key."""
    df.write.mode("overwrite").json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers, one JSON document per line, as text column ``body``."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def write_reports(reports: DataFrame, path: str) -> None:
    reports.select(F.col("report").alias("value")).write.mode("overwrite").text(path)


def append_pending(work: DataFrame, path: str, keys: list[str], enrich) -> None:
    """Restart-safe enrichment: enrich the keys that are not yet at ``path`` and append them; NULL is a key like others.

    A Parquet append is atomic per job, so a restart finds either all rows of a batch or none.
    """
    spark = work.sparkSession
    todo = work.dropDuplicates(keys)
    if _exists(spark, path):
        done = spark.read.parquet(path).select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)])
        todo = todo.join(done, same(keys), "left_anti")
    write_parquet(enrich(todo), path, mode="append")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True
