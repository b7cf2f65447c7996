"""Landed JSON answers: one shape for all spellings, reports, and summaries for comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegauge.schema import PAGE


def normalized_items(pages: DataFrame, column: str = "body", keep: list[str] | None = None) -> DataFrame:
    """Items of landed pages with one spelling of every field.

    A page lists its items under ``content`` or ``items``; titles, dates, types and numbers come in two spellings,
    and a recording code is a text or an object with the code inside.
    """
    page = F.from_json(column, PAGE)
    rows = pages.select(*(keep or []), F.explode_outer(F.coalesce(page["content"], page["items"])).alias("t"))
    code = F.col("t.isrc")
    inner = F.coalesce(F.get_json_object(code, "$.isrc"), F.get_json_object(code, "$.id"))
    date = F.coalesce("t.releaseDate", "t.release_date", F.lit("0000"))
    return rows.where("t IS NOT NULL").select(
        *(keep or []), F.col("t.id").alias("id"), F.coalesce("t.trackTitle", "t.name", F.lit("Unknown Track")).alias("title"),
        F.coalesce("t.trackNumber", "t.track_number", F.lit(0)).alias("track_number"),
        F.coalesce("t.popularity", F.lit(0)).alias("popularity"), F.substring(date, 1, 4).alias("year"),
        F.initcap(F.coalesce("t.albumType", "t.album_type", F.lit("Unknown"))).alias("type"),
        F.when(code.startswith("{"), inner).otherwise(code).alias("isrc"),
    )


def union_pages(pages: DataFrame, key: list[str], column: str = "body") -> DataFrame:
    """All items of all landed pages, each id once per key: the most popular copy, then the first title."""
    from tunegauge.operators.ranking import top_per_group

    items = normalized_items(pages, column, key)
    return top_per_group(items, [*key, "id"], [F.col("popularity").desc(), "title"])


def report_json(scored: DataFrame, key: str, features: list[str]) -> DataFrame:
    """One nested JSON report per scored row: metadata and the simulated features."""
    metadata = F.struct(
        F.coalesce("title", F.lit("Unknown")).alias("track"), F.coalesce("artist", F.lit("Unknown")).alias("artist"),
        "forecast", "regime")
    simulation = F.struct("anti_sabotage", F.struct(*features).alias("simulated_features"))
    return scored.select(key, F.to_json(F.struct(metadata.alias("metadata"), simulation.alias("simulation"))).alias("report"))


# Payload fields that are compared between runs.
PAYLOAD_FIELDS = [
    "title", "artist", "album", "original_release_year", "real_market_popularity", "rb_track_id", "isrc", "is_partial",
]


def _sorted_names(names: Column) -> Column:
    """Field names as one sorted, comma-separated text; '' when there is none."""
    return F.coalesce(F.array_join(F.sort_array(names), ","), F.lit(""))


def payload_summary(results: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Flat fields of resolver answers for a comparison of runs. Each answer is parsed once."""
    shape = "success string, is_artist_only_fallback string, inference_payload map<string,string>"
    parsed = results.select(key, F.from_json(body, shape).alias("a")).select(
        key, "a.success", "a.is_artist_only_fallback", F.coalesce("a.inference_payload", F.create_map().cast("map<string,string>")).alias("p"))

    def field(name: str) -> Column:
        return F.try_element_at("p", F.lit(name))

    first_person = F.get_json_object(field("collaborators"), "$[0]")
    return parsed.select(
        key,
        F.coalesce("success", F.lit("false")).alias("success"),
        F.coalesce("is_artist_only_fallback", F.lit("false")).alias("is_artist_only_fallback"),
        *[field(n).alias(n) for n in PAYLOAD_FIELDS],
        F.coalesce(F.json_array_length(field("raw_alternatives")), F.lit(0)).alias("raw_alternatives_count"),
        F.coalesce(F.json_array_length(field("collaborators")), F.lit(0)).alias("collaborators_count"),
        _sorted_names(F.map_keys("p")).alias("payload_keys"),
        _sorted_names(F.json_object_keys(field("audio_features"))).alias("audio_features_keys"),
        _sorted_names(F.json_object_keys(first_person)).alias("collaborator_keys"),
    )


def expected_flags(summary: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Null-safe match of summaries with expected ids and key lists."""
    joined = summary.join(expected, key, "left")
    return joined.select(
        key, F.equal_null("rb_track_id", "expected_rb_track_id").alias("matches_expected_track"),
        F.equal_null("audio_features_keys", "expected_audio_features_keys").alias("has_expected_audio_features"),
    )
