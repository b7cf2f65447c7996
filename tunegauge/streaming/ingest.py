"""Structured Streaming jobs: enrichment ingest, lookup throttling and scoring of arriving tracks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tunegauge.functions.scalars import clip_0_100, listeners_log, regime_id
from tunegauge.operators import gram
from tunegauge.sources import landing

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Arriving Parquet files of a folder. Event times become timestamps, which a watermark needs."""
    raw = (
        spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def enrichment_ingest(
    stream: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, buckets: int = landing.BUCKETS
) -> None:
    """Land the first result per key, with all its columns, in a Parquet folder; then stop.

    Each batch is cut to the first row per key by ``order`` and compared with what has landed in the buckets of its keys
    only; it lands in a folder of its own, which a replay after a failure replaces. No state is kept. A key that has landed
    stays as it is. NULL is a key.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        landing.land_batch(batch, batch_id, path, keys, order, buckets)

    query = (
        stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()


def ttl_dedup(stream: DataFrame, keys: list[str], seconds: int = 3600) -> DataFrame:
    """(keys..., asked_at): events that ask, as the last lookup of their key lies ``seconds`` or more before them.

    The first event of a key asks at once. State is the key's last lookup; it goes once the watermark says that any
    later event would ask anyway. Of a batch, a task holds the times of one key, in order.
    """
    schema = stream.select(*keys, F.col("ts").alias("asked_at")).schema

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        wait = pd.Timedelta(seconds=seconds)
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        asked = []
        for ts in np.sort(np.concatenate([b["ts"].to_numpy() for b in batches])):
            if not pd.isna(ts) and (last is None or ts >= last + wait):
                last = pd.Timestamp(ts)
                asked.append(last)
        if last is not None:
            state.update((int(last.value // 1000),))
            state.setTimeoutTimestamp(max(int(last.value // 1_000_000) + 1000 * seconds, state.getCurrentWatermarkMs() + 1))
        if asked:
            yield pd.DataFrame({**{k: [v] * len(asked) for k, v in zip(schema.names, key)}, "asked_at": asked})

    return stream.withWatermark("ts", f"{seconds} seconds").select(*keys, "ts").groupBy(*keys).applyInPandasWithState(
        decide, schema, "last_asked long", "append", GroupStateTimeout.EventTimeTimeout)


def score_stream(
    stream: DataFrame, artists: DataFrame, artist: str, predict: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Arriving rows with listeners, regime and forecast; a stream-static join and projections, no state."""
    joined = stream.join(artists.select(F.col("artist_id").alias(artist), "listeners"), artist, "left")
    routed = joined.withColumn("listeners_log", listeners_log("listeners")).withColumn("regime_id", regime_id("listeners_log"))
    return predict(routed.drop("listeners")).withColumn("pred", clip_0_100("pred"))


def score_saved(
    stream: DataFrame, artists: DataFrame, artist: str, inputs: dict[str, Column], path: str, version: str
) -> DataFrame:
    """``score_stream`` with the experts of a saved version: regime, forecast and the version that made it.

    ``inputs`` gives the arriving row's value for each feature that the version was trained on; a missing one raises. The
    experts are a static table of one row per regime that joins the stream.
    """
    models, facts = gram.load_groups(stream.sparkSession, path, version)
    if absent := [c for c in facts["columns"] if c not in inputs]:
        raise ValueError(f"no input for {', '.join(absent)}")
    names = {c: f"_in_{c}" for c in facts["columns"]}

    def predict(rows: DataFrame) -> DataFrame:
        given = rows.withColumns({n: inputs[c] for c, n in names.items()})
        return gram.score_groups(given, models, list(names.values()), ["regime_id"]).drop(*names.values())

    return score_stream(stream, artists, artist, predict).withColumn("version", F.lit(facts["version"]))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived into Parquet, then stop. A restart goes on from the checkpoint."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()
