"""Contracts and fixed values shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Column contracts of the track table.
TARGET = "song_popularity"
REQUIRED_RAW = [
    "spotify_id", "album_release_date", "album_release_year", "album_release_month", "song_popularity", "key", "mode",
    "time_signature", "song_explicit", "total_available_markets", "acousticness", "danceability", "energy",
    "instrumentalness", "liveness", "speechiness", "valence", "loudness", "tempo", "duration_ms",
]
DROP_FOR_MODELING = ["Unnamed: 0", "spotify_id", "analysis_url", "track_href", "uri", "song_name", "artist_name"]
FLOAT_COLS = [
    "acousticness", "danceability", "duration_ms", "energy", "instrumentalness", "liveness", "loudness",
    "speechiness", "tempo", "valence",
]
BYTE_COLS = ["key", "mode", "time_signature"]
SHORT_COLS = ["song_popularity", "total_available_markets"]
STRICT_15 = [
    "album_release_year", "acousticness", "danceability", "duration_ms", "energy", "instrumentalness", "key",
    "liveness", "loudness", "mode", "speechiness", "tempo", "time_signature", "total_available_markets", "valence",
]
AUDIO_DEFAULTS = {
    "danceability": 0.5, "energy": 0.5, "valence": 0.5, "acousticness": 0.5, "instrumentalness": 0.0,
    "speechiness": 0.05, "tempo": 120.0, "loudness": -6.0, "key": 0.0, "mode": 1.0, "time_signature": 4.0,
    "liveness": 0.1,
}
# Audience regimes by log listeners.
REGIME_T1, REGIME_T2 = 8.81, 13.09
REGIME_LABELS = ["Cold Start", "Tipping Point", "Mainstream"]

RAW_TRACKS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("spotify_id", "song_name", "artist_name", "album_release_date")]
    + [T.StructField(c, T.DoubleType()) for c in ("album_release_year", "album_release_month")]
    + [T.StructField("song_explicit", T.BooleanType())]
    + [T.StructField(c, T.DoubleType()) for c in SHORT_COLS + BYTE_COLS + FLOAT_COLS]
)

PAYLOAD_ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("trackTitle", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("trackNumber", T.LongType()),
    T.StructField("track_number", T.LongType()),
    T.StructField("popularity", T.LongType()),
    T.StructField("releaseDate", T.StringType()),
    T.StructField("release_date", T.StringType()),
    T.StructField("albumType", T.StringType()),
    T.StructField("album_type", T.StringType()),
    T.StructField("isrc", T.StringType()),
])
PAGE = T.StructType([
    T.StructField("content", T.ArrayType(PAYLOAD_ITEM)),
    T.StructField("items", T.ArrayType(PAYLOAD_ITEM)),
])
