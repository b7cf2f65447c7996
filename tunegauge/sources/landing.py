"""Landed results that are added to safely: batches of a stream by bucket of their key, and long lookups chunk by chunk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunegauge.operators.quantiles import same
from tunegauge.operators.ranking import top_per_group
from tunegauge.session import written

#: Folders per batch; a later batch reads those that its own keys fall into.
BUCKETS = 64


def _read(spark: SparkSession, paths: str | list[str], schema: T.StructType, base: str) -> DataFrame | None:
    """Parquet files below ``paths``, or None where no such folder is there yet."""
    try:
        return spark.read.schema(schema).option("basePath", base).parquet(*([paths] if isinstance(paths, str) else paths))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


# ---- batches of a stream -----------------------------------------------------------------------------------------------

def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def landed_before(spark: SparkSession, path: str, schema: T.StructType, touched: list[int], batch_id: int) -> DataFrame | None:
    """What other batches landed in the touched buckets; no other folder is listed or read."""
    if not touched:
        return None
    names = f"{{{','.join(str(b) for b in touched)}}}"
    layout = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
    found = _read(spark, f"{path}/batch=*/bucket={names}", layout, path)
    return None if found is None else found.where(F.col("batch") != batch_id)


def land_batch(batch: DataFrame, batch_id: int, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """Land the first row per key of a batch, by ``order``, for keys that no other batch has landed; NULL is a key.

    A batch owns its folder and replaces it when it is run again, so a replay adds nothing and half a batch never stays.
    """
    spark = batch.sparkSession
    first = written(top_per_group(batch, keys, order).withColumn("bucket", bucket_of(keys, buckets)), "batch")
    touched = sorted(r["bucket"] for r in first.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    done = landed_before(spark, path, batch.schema, touched, batch_id)
    if done is not None:
        first = first.join(done.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)]), same(keys), "left_anti")
    first.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")


def landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All that has landed, with the columns of ``schema``."""
    found = _read(spark, path, schema, path)
    return spark.createDataFrame([], schema) if found is None else found.select(*schema.names)


# ---- lookups in chunks -------------------------------------------------------------------------------------------------

_RUNS = T.StructType([T.StructField("run", T.LongType()), T.StructField("first", T.LongType()), T.StructField("chunks", T.LongType())])
_DONE = T.StructType([T.StructField("chunk", T.LongType())])


def _mark(spark: SparkSession, path: str, schema: T.StructType, row: tuple) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def _rows(spark: SparkSession, path: str, schema: T.StructType) -> list:
    found = _read(spark, path, schema, path)
    return [] if found is None else found.distinct().collect()


def enrich_in_chunks(
    work: DataFrame, path: str, keys: list[str], enrich: Callable[[DataFrame], DataFrame], chunk_rows: int = 50_000
) -> int:
    """Enrich the keys that are not yet at ``path``, chunk by chunk, and give the number of chunks done by this call.

    The work list is stored first, dealt to chunks of ``chunk_rows`` rows on average by a hash of its keys. Each chunk is
    written to its own folder and then marked. After a failure the next call takes up the stored list: marked chunks are not
    run again, an unmarked one replaces its folder. Then it goes on with keys that were never listed. NULL is a key.
    Per chunk the driver holds one number.
    """
    spark = work.sparkSession
    work = work.dropDuplicates(keys)
    runs = sorted(_rows(spark, f"{path}/runs", _RUNS))
    finished = {r["chunk"] for r in _rows(spark, f"{path}/done", _DONE)}
    listed = T.StructType([*work.schema.fields, T.StructField("chunk", T.LongType())])

    def run(number: int, first: int, chunks: int) -> int:
        ran = 0
        for chunk in range(first, first + chunks):
            if chunk in finished:
                continue
            rows = _read(spark, f"{path}/plan/run={number}/chunk={chunk}", work.schema, f"{path}/plan/run={number}/chunk={chunk}")
            if rows is not None:  # a chunk that no key fell into has no folder
                enrich(rows).write.mode("overwrite").parquet(f"{path}/chunks/chunk={chunk}")
            _mark(spark, f"{path}/done", _DONE, (chunk,))
            ran += 1
        return ran

    ran = sum(run(*r) for r in runs)
    if runs:
        known = _read(spark, [f"{path}/plan/run={r['run']}" for r in runs], listed, f"{path}/plan")
        work = work.join(known.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)]), same(keys), "left_anti")
    work = written(work, "work-list")
    count = work.count()
    if not count:
        return ran
    chunks = -(-count // chunk_rows)
    number = runs[-1]["run"] + 1 if runs else 0
    first = runs[-1]["first"] + runs[-1]["chunks"] if runs else 0
    dealt = work.withColumn("chunk", F.pmod(F.xxhash64(*keys), F.lit(chunks)) + first)
    dealt.repartition("chunk").write.mode("overwrite").partitionBy("chunk").parquet(f"{path}/plan/run={number}")
    _mark(spark, f"{path}/runs", _RUNS, (number, first, chunks))
    return ran + run(number, first, chunks)


def enriched(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all marked chunks, with the columns of ``schema``; a chunk that failed half-way is not seen."""
    found = _read(spark, f"{path}/chunks", T.StructType([*schema.fields, T.StructField("chunk", T.LongType())]), f"{path}/chunks")
    if found is None:
        return spark.createDataFrame([], schema)
    marks = spark.read.schema(_DONE).parquet(f"{path}/done").distinct()
    return found.join(marks, "chunk", "left_semi").select(*schema.names)
