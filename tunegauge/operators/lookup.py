"""Enrichment joins: listeners, tags, release facts, codes and work queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegauge.functions.scalars import listeners_log
from tunegauge.functions.text import tag_column
from tunegauge.operators.quantiles import same


def join_model(meta: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Metadata and modeling features of the same row, by key (never by position)."""
    return meta.join(features, key, "inner")


def join_listeners(tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """Add ``listeners_log``. Spark broadcasts the lookup when its size allows, else shuffles and splits hot artists."""
    found = tracks.join(artists.select("artist_name", "listeners"), "artist_name", "left")
    return found.withColumn("listeners_log", listeners_log("listeners")).drop("listeners")


def top_tags(artist_tags: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` most frequent tags; ties by name. A driver-side list of at most ``k`` tags may be taken from it."""
    return artist_tags.groupBy(tag_column("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), "tag"
    ).limit(k)


def multi_hot_tags(tracks: DataFrame, artist_tags: DataFrame, selected: list[str]) -> DataFrame:
    """One 0/1 column per selected tag. Only selected tags enter the per-artist set, so that set is bounded."""
    wanted = artist_tags.select("artist_name", tag_column("tag").alias("tag")).where(F.col("tag").isin(selected))
    sets = wanted.groupBy("artist_name").agg(F.collect_set("tag").alias("_tags"))
    joined = tracks.join(sets, "artist_name", "left")
    flags = [
        F.coalesce(F.array_contains("_tags", t), F.lit(False)).cast("tinyint").alias(f"tag_{t}") for t in selected
    ]
    return joined.select(*tracks.columns, *flags)


def join_proxy(tracks: DataFrame, proxies: DataFrame) -> DataFrame:
    return tracks.join(proxies, "track_id", "left")


def release_features(tracks: DataFrame, releases: DataFrame) -> DataFrame:
    """Release facts with neutral defaults; singles and EPs count as singles; ratio rounded to four places."""
    joined = tracks.join(releases, ["artist_name", "song_name"], "left")
    found = F.coalesce(F.col("found") == 1, F.lit(False))
    number = F.when(found, F.coalesce(F.nullif("track_number", F.lit(0)), F.lit(1))).otherwise(1)
    count = F.when(found, F.coalesce(F.nullif("track_count", F.lit(0)), F.lit(1))).otherwise(1)
    single = F.when(found, F.coalesce(F.col("release_type").isin("Single", "EP"), F.lit(False)).cast("int")).otherwise(1)
    ratio = F.when(found & (count > 0), F.bround(number / count, 4)).otherwise(0.0)
    return joined.select(
        *tracks.columns, found.cast("int").alias("mb_found"), single.alias("mb_is_single"),
        number.alias("mb_track_number"), count.alias("mb_track_count"), ratio.alias("mb_prominence_ratio"),
    )


def release_features_v2(tracks: DataFrame, releases: DataFrame) -> DataFrame:
    """Second definition: only singles count, a missing release has ratio 1, the ratio is not rounded."""
    joined = tracks.join(releases, ["artist_name", "song_name"], "left")
    found = F.coalesce(F.col("found") == 1, F.lit(False))
    number = F.coalesce(F.col("track_number"), F.lit(1)).cast("double")
    count = F.coalesce(F.col("track_count"), F.lit(1)).cast("double")
    count = F.when(count <= 0, 1.0).otherwise(count)
    single = F.when(found, F.coalesce(F.col("release_type") == "Single", F.lit(False)).cast("int")).otherwise(1)
    return joined.select(
        *tracks.columns, single.alias("mb_is_single"), F.when(found, number.cast("int")).otherwise(1)
        .alias("mb_track_number"), F.when(found, number / count).otherwise(1.0).alias("mb_prominence_ratio"),
    )


def pending(keys: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Keys still to be enriched: never done, or done without a code and not known to be invalid."""
    finished = done.where(F.col("qid").isNotNull() | (F.col("status") == "invalid"))
    finished = finished.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(on)])
    return keys.select(*on).distinct().join(finished, same(on), "left_anti")


def match_codes(candidates: DataFrame, catalog: DataFrame, codes: str = "codes", code: str = "isrc") -> DataFrame:
    """Catalog rows that carry any code of a candidate; each (candidate, row) once."""
    exploded = candidates.withColumn("_code", F.explode(codes)).drop(codes)
    return exploded.join(catalog, F.col("_code") == F.col(code)).drop("_code").distinct()


def explode_keyed_json(df: DataFrame, column: str, value_type: str = "bigint") -> DataFrame:
    """A JSON object per row to one row per key: all columns plus ``key`` and ``value``."""
    return df.select("*", F.explode(F.from_json(column, f"map<string,{value_type}>")))


def two_pass_entities(credits: DataFrame, entities: DataFrame) -> DataFrame:
    """Credit strings to entities: the whole string when it is an entity, else each of its collaborators.

    ``credits`` has (credit_id, raw), ``entities`` has (artist_name, ...). Returns (credit_id, name, pass_no, found).
    Distinct strings are resolved once, so popular credits add no work.
    """
    from tunegauge.functions.text import split_collaborations, squeeze

    raw = credits.select("credit_id", squeeze("raw").alias("raw"))
    known = entities.select(F.col("artist_name").alias("name")).distinct().withColumn("_known", F.lit(True))
    texts = raw.select("raw").distinct().join(known.withColumnRenamed("name", "raw"), "raw", "left")
    names = texts.select(
        "raw",
        F.when(F.col("_known"), 1).otherwise(2).alias("pass_no"),
        F.explode(F.when(F.col("_known"), F.array("raw")).otherwise(split_collaborations("raw"))).alias("name"),
    )
    resolved = names.join(known, "name", "left").select(
        "raw", "name", "pass_no", F.coalesce("_known", F.lit(False)).alias("found")
    )
    return raw.join(resolved, "raw").drop("raw")
