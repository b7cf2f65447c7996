"""Queries: cleaning, contracts, splits and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunegauge.functions import scalars
from tunegauge.operators import clean, lookup, split, stats
from tunegauge.plans.registry import query

NUMERIC = ["acousticness", "danceability", "energy", "instrumentalness", "liveness", "speechiness", "valence",
           "loudness", "tempo", "duration_ms"]

# Sub-queries of the expected results: de-duplicated, prepared and split tracks.
DEDUP = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY song_popularity DESC, row_key) AS rn FROM tracks)
WHERE rn = 1"""
YEARS = """
SELECT * EXCLUDE (album_release_date, y), y AS album_release_year FROM (
  SELECT * EXCLUDE (album_release_year), CASE WHEN album_release_date <> '0000' THEN
    coalesce(album_release_year, TRY_CAST(substring(album_release_date, 1, 4) AS DOUBLE)) END AS y FROM dedup)
WHERE y IS NOT NULL"""
PREPARED = """
SELECT * EXCLUDE (album_release_year), CASE WHEN album_release_year > 1900 THEN album_release_year END AS album_release_year,
  NOT coalesce(album_release_year > 1900, false) AS release_year_missing_or_suspect FROM years"""
SPLIT = """
SELECT *, CASE WHEN album_release_year IS NULL OR album_release_year <= 1999 THEN 'train' WHEN album_release_year = 2000 THEN 'val'
  ELSE 'test' END AS split FROM prepared WHERE album_release_year IS NULL OR album_release_year <= 2001"""
EXTRA = {"dedup": DEDUP, "years": YEARS, "prepared": PREPARED, "split_tracks": SPLIT}


def dedup(v):
    return clean.dedup_keep_max(v.tracks, "track_id", tie_break=["row_key"])


def prepared(v):
    return clean.flag_suspect_year(clean.normalize_release_year(dedup(v)))


def split_tracks(v):
    return split.temporal_split(prepared(v), 1999)


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


@query("read_parquet", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30""")
def _(v):
    # one table, so that the filter and the three columns reach the scan
    return v.lineitem.where("l_quantity >= 30").select("l_orderkey", "l_linenumber", "l_quantity")


@query("dedup_keep_max", "SELECT track_id, row_key, song_popularity FROM dedup", EXTRA)
def _(v):
    return dedup(v).select("track_id", "row_key", "song_popularity")


@query("drop_if_present", "SELECT track_id, song_popularity, energy FROM tracks")
def _(v):
    return clean.drop_if_present(
        v.tracks.select("track_id", "song_popularity", "energy", "row_key"), "row_key", "album_release_month"
    )


@query("normalize_release_year", "SELECT row_key, album_release_year FROM years", EXTRA)
def _(v):
    return clean.normalize_release_year(dedup(v)).select("row_key", "album_release_year")


@query("flag_suspect_year", "SELECT row_key, album_release_year, release_year_missing_or_suspect FROM prepared", EXTRA)
def _(v):
    return prepared(v).select("row_key", "album_release_year", "release_year_missing_or_suspect")


@query("enforce_dtypes", """
SELECT row_key, CAST(round_even(duration_ms / 1e3, 0) AS SMALLINT) AS total_available_markets, CAST(energy AS FLOAT) AS energy,
  CAST(round_even(key + 5e-1, 0) AS TINYINT) AS key, CAST(round_even(song_popularity / 2e0, 0) AS SMALLINT) AS song_popularity,
  CAST(album_release_year AS SMALLINT) AS album_release_year FROM prepared""", EXTRA)
def _(v):
    halves = prepared(v).select(
        "row_key", (F.col("duration_ms") / 1000).alias("total_available_markets"), "energy",
        (F.col("key") + 0.5).alias("key"), (F.col("song_popularity") / 2).alias("song_popularity"),
        "album_release_year",
    )
    return clean.enforce_dtypes(halves)


@query("validate_target_range", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE song_popularity IS NULL) AS n_missing,
  CAST(min(song_popularity) AS DOUBLE) AS min_target, CAST(max(song_popularity) AS DOUBLE) AS max_target,
  count(*) FILTER (WHERE song_popularity < 0 OR song_popularity > 100) AS n_out_of_range FROM tracks""")
def _(v):
    return clean.target_range_report(clean.validate_target_range(v.tracks))


@query("require_columns", "SELECT track_id, song_popularity FROM tracks")
def _(v):
    checked = clean.require_columns(v.tracks, ["track_id", "song_popularity"])
    return clean.forbid_columns(checked.select("track_id", "song_popularity"), ["uri", "track_href"])


@query("row_rules", """
SELECT rule, count(*) FILTER (WHERE NOT coalesce(good, false)) AS n_violations, count(*) AS n_rows FROM (
  SELECT unnest([{'rule': 'target_in_range', 'good': song_popularity BETWEEN 0 AND 100},
    {'rule': 'duration_positive', 'good': duration_ms IS NULL OR duration_ms > 0},
    {'rule': 'tempo_not_negative', 'good': tempo IS NULL OR tempo >= 0},
    {'rule': 'loudness_not_positive', 'good': loudness <= 0},
    {'rule': 'energy_in_unit', 'good': energy BETWEEN 0 AND 1}], recursive := true) FROM tracks) GROUP BY rule""")
def _(v):
    return clean.row_rules(v.tracks, clean.track_rules())


@query("repair_merge_suffixes", "SELECT row_key, energy, tempo AS tempo_x_raw FROM tracks")
def _(v):
    merged = v.tracks.select(
        F.col("row_key").alias("row_key"), F.col("energy").alias("energy_x"), F.col("energy").alias("energy_y"),
        F.col("tempo").alias("tempo_x_raw"), F.lit(0).alias("Unnamed: 0"),
    )
    return clean.repair_merge_suffixes(merged)


@query("select_numeric", "SELECT key, mode, energy FROM tracks")
def _(v):
    return clean.select_numeric(v.tracks.select("row_key", "key", "mode", "energy", "tempo", "song_explicit"), ["tempo"])


@query("clean_numeric", """
SELECT row_key, CASE WHEN tempo <> 0 THEN energy / tempo END AS ratio, CAST(song_explicit AS TINYINT) AS song_explicit
FROM tracks""")
def _(v):
    ratio = F.when(F.col("tempo") == 0, F.lit(float("inf"))).otherwise(F.col("energy") / F.nullif("tempo", F.lit(0.0)))
    return clean.clean_numeric(v.tracks.select("row_key", ratio.alias("ratio"), "song_explicit"))


@query("strict_contract", "SELECT " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in clean.STRICT_15) + " FROM prepared", EXTRA)
def _(v):
    return clean.strict_contract(prepared(v))


@query("conditional_filters", """
SELECT row_key, tempo, loudness, duration_ms, time_signature FROM tracks
WHERE tempo = 0 OR loudness > 0 OR duration_ms > 1200000 OR time_signature = 0""")
def _(v):
    wanted = (F.col("tempo") == 0) | (F.col("loudness") > 0) | (F.col("duration_ms") > 1_200_000) | (
        F.col("time_signature") == 0)
    return v.tracks.where(wanted).select("row_key", "tempo", "loudness", "duration_ms", "time_signature")


@query("mainstream_filter", """
SELECT DISTINCT artist_name, song_name FROM tracks JOIN artists USING (artist_name) WHERE ln(1 + listeners) >= 1309e-2""")
def _(v):
    return clean.mainstream_work_list(lookup.join_listeners(v.tracks, v.artists))


@query("default_features", """
SELECT row_key, coalesce(danceability, 5e-1) AS danceability, coalesce(CASE WHEN mode = 1 THEN energy END, 5e-1) AS energy,
  5e-1 AS valence, 5e-1 AS acousticness, 0e0 AS instrumentalness, 5e-2 AS speechiness,
  CASE WHEN tempo > 0 THEN tempo ELSE 12e1 END AS tempo, -6e0 AS loudness, 0e0 AS key, 1e0 AS mode, 4e0 AS time_signature,
  1e-1 AS liveness, danceability IS NULL AND mode <> 1 AND tempo = 0 AS is_partial FROM tracks""")
def _(v):
    parsed = {
        "danceability": F.col("danceability"),
        "energy": F.when(F.col("mode") == 1, F.col("energy")),
        "tempo": F.when(F.col("tempo") > 0, F.col("tempo").cast("string")),
        "valence": F.when(F.col("valence") > 2, F.lit("not a number")),
    }
    return clean.with_default_audio(v.tracks, parsed, ["row_key"])


@query("map_labels", """
SELECT replace(type, 'Ep', 'EP') AS type, upper(substring(artist_kind, 1, 1)) || substring(artist_kind, 2) AS artist_kind, n FROM (
  SELECT type, CASE WHEN artist_id % 2 = 0 THEN 'solo' ELSE 'group' END AS artist_kind, count(*) AS n FROM albums GROUP BY ALL)""")
def _(v):
    kind = F.when(F.col("artist_id") % 2 == 0, "solo").otherwise("group")
    label = F.when(F.col("type") == "Ep", "EP").otherwise(F.col("type"))
    return v.albums.groupBy(label.alias("type"), F.initcap(kind).alias("artist_kind")).agg(F.count(F.lit(1)).alias("n"))


def hashed(*parts):
    """SQL of ``text_hash`` over columns."""
    marked = ", ".join(f"coalesce('v' || CAST({p} AS VARCHAR), 'n')" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws('|', {marked})), 1, 15) AS BIGINT)"


@query("sample_n", f"SELECT row_key, song_popularity FROM tracks ORDER BY {hashed('row_key', '42')}, row_key LIMIT 500")
def _(v):
    return clean.sample_n(v.tracks.select("row_key", "song_popularity"), "row_key", 500)


@query("anti_leakage_view", "SELECT * EXCLUDE (row_key, track_id, song_name, artist_name) FROM tracks")
def _(v):
    return clean.anti_leakage_view(v.tracks, ["row_key", "track_id", "song_name", "artist_name", "uri"])


@query("random_split", f"""
SELECT CASE WHEN b < 1500 THEN 'test' WHEN b < 3000 THEN 'val' ELSE 'train' END AS split, count(*) AS n
FROM (SELECT {hashed('row_key', '42')} % 10000 AS b FROM tracks) GROUP BY 1""")
def _(v):
    parts = split.random_split(v.tracks, "row_key")
    return parts.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("temporal_split", "SELECT row_key, split FROM split_tracks", EXTRA)
def _(v):
    return split.check_year_coverage(split_tracks(v), 1999).select("row_key", "split")


@query("recency_weight", """
SELECT row_key, CASE WHEN album_release_year IS NOT NULL THEN round(exp(-5e-2 * greatest(2001 - album_release_year, 0)), 9) END AS w_none,
  round(least(greatest(exp(-5e-2 * greatest(2001 - coalesce(album_release_year, m), 0)), 1e-3), 1e0), 9) AS w_median,
  round(exp(-5e-2 * greatest(2001 - coalesce(album_release_year, 2001), 0)), 9) AS w_current
FROM prepared, (SELECT quantile_cont(album_release_year, 5e-1) AS m FROM prepared)""", EXTRA)
def _(v):
    rows = prepared(v)
    median = rows.agg(F.percentile("album_release_year", 0.5)).first()[0]  # one value per calendar year
    year = F.col("album_release_year")
    return rows.select(
        "row_key",
        F.round(scalars.recency_weight(year, 2001, null_policy="none"), 9).alias("w_none"),
        F.round(scalars.recency_weight(year, 2001, null_policy="median", median_year=median), 9).alias("w_median"),
        F.round(scalars.recency_weight(year, 2001, null_policy="current"), 9).alias("w_current"),
    )


@query("refit_union", """
SELECT row_key, split, CASE WHEN split = 'val' THEN 1e0 ELSE round(exp(-5e-2 * greatest(2000 - coalesce(album_release_year, 2000), 0)), 9) END AS weight
FROM split_tracks WHERE split IN ('train', 'val')""", EXTRA)
def _(v):
    weighted = split_tracks(v).withColumn("weight", F.round(scalars.recency_weight("album_release_year", 2000), 9))
    return split.refit_union(weighted).select("row_key", "split", "weight")


@query("describe", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
  round(quantile_cont({c}, 25e-2), 6) AS q25, round(quantile_cont({c}, 5e-1), 6) AS q50, round(quantile_cont({c}, 75e-2), 6) AS q75,
  round(max({c}), 6) AS max FROM tracks""".strip() for c in NUMERIC))
def _(v):
    return rounded(stats.describe(v.tracks, NUMERIC), ["mean", "std", "min", "q25", "q50", "q75", "max"])


@query("describe_text", """
SELECT feature, CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, min_by(value, (-n, value)) AS top, max(n) AS freq FROM (
  SELECT 'song_name' AS feature, song_name AS value, count(*) AS n FROM tracks GROUP BY ALL
  UNION ALL SELECT 'song_explicit', CAST(song_explicit AS VARCHAR), count(*) FROM tracks GROUP BY ALL) GROUP BY feature""")
def _(v):
    return stats.describe_text(v.tracks, ["song_name", "song_explicit"])


@query("missing_summary", """
SELECT split, feature, n_missing, round(n_missing * 1e2 / n, 6) AS pct_missing FROM (
  SELECT split, count(*) AS n, unnest([{'feature': 'album_release_year', 'n_missing': count(*) - count(album_release_year)},
   {'feature': 'tempo', 'n_missing': count(*) - count(tempo)}], recursive := true) FROM split_tracks GROUP BY split)""", EXTRA)
def _(v):
    return rounded(stats.missing_summary(split_tracks(v), ["album_release_year", "tempo"], ["split"]), ["pct_missing"])


@query("cardinality", """
SELECT feature, n_unique, round(n_unique / n, 6) AS unique_ratio FROM (
 SELECT count(*) AS n, unnest([
  {'feature': 'artist_name', 'n_unique': count(DISTINCT artist_name)}, {'feature': 'song_name', 'n_unique': count(DISTINCT song_name)},
  {'feature': 'album_release_year', 'n_unique': count(DISTINCT album_release_year) + CAST(bool_or(album_release_year IS NULL) AS INT)}],
  recursive := true) FROM tracks)""")
def _(v):
    return rounded(stats.cardinality(v.tracks, ["artist_name", "song_name", "album_release_year"]), ["unique_ratio"])


@query("duplicate_report", """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - d) AS BIGINT) AS n_row_duplicates, CAST(sum(n - 1) AS BIGINT) AS n_key_duplicates,
  count(*) FILTER (WHERE n > 1) AS n_duplicated_keys FROM (
   SELECT track_id, sum(c) AS n, count(*) AS d FROM (
     SELECT track_id, song_name, artist_name, mode, count(*) AS c FROM tracks GROUP BY ALL) GROUP BY track_id)""")
def _(v):
    return stats.duplicate_report(v.tracks.select("track_id", "song_name", "artist_name", "mode"), "track_id")


@query("duplicated_keys", "SELECT track_id, count(*) AS n FROM tracks GROUP BY track_id HAVING count(*) > 1")
def _(v):
    return stats.duplicated_keys(v.tracks, ["track_id"])


@query("value_counts", """
SELECT album_release_year, count(*) AS n, round(count(*) * 1e2 / sum(count(*)) OVER (), 6) AS pct FROM tracks GROUP BY album_release_year""")
def _(v):
    return rounded(stats.value_counts(v.tracks, "album_release_year"), ["pct"])


@query("date_format_census", r"""
SELECT CASE WHEN d = '0000' THEN '0000' WHEN regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'YYYY-MM-DD'
 WHEN regexp_full_match(d, '[0-9]{4}-[0-9]{2}') THEN 'YYYY-MM' WHEN regexp_full_match(d, '[0-9]{4}') THEN 'YYYY' ELSE 'other' END AS grain,
 count(*) AS n FROM (SELECT album_release_date AS d FROM tracks) GROUP BY 1""")
def _(v):
    return stats.date_format_census(v.tracks, "album_release_date")


@query("target_summary", """
SELECT count(*) AS n_rows, count(*) - count(y) AS n_missing, count(DISTINCT y) AS n_unique, min(y) AS min, max(y) AS max,
 round(avg(y), 6) AS mean, round(avg(CAST(y = 0 AS DOUBLE)), 6) AS zero_rate, quantile_cont(y, 25e-2) AS q25,
 quantile_cont(y, 5e-1) AS median, quantile_cont(y, 75e-2) AS q75, round(avg(y) FILTER (WHERE y > 0), 6) AS mean_positive,
 quantile_cont(y, 5e-1) FILTER (WHERE y > 0) AS median_positive FROM (SELECT CAST(song_popularity AS DOUBLE) AS y FROM tracks)""")
def _(v):
    return rounded(stats.target_summary(v.tracks), ["mean", "zero_rate", "mean_positive"])


@query("correlations", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(corr({c}, CAST(song_popularity AS DOUBLE)), 6) AS corr FROM tracks" for c in NUMERIC))
def _(v):
    return rounded(stats.target_correlations(v.tracks, NUMERIC), ["corr"])


@query("correlation_pairs", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr({a}, {b}), 6) AS corr FROM tracks"
    for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]))
def _(v):
    return rounded(stats.correlation_pairs(v.tracks, NUMERIC), ["corr"])


@query("split_summary", """
SELECT split, count(*) AS n_rows, 22 AS n_cols, CAST(min(album_release_year) AS INT) AS year_min,
 CAST(max(album_release_year) AS INT) AS year_max, round(avg(CAST(album_release_year IS NULL AS DOUBLE)) * 1e2, 6) AS year_missing_pct,
 round(avg(song_popularity), 6) AS target_mean, quantile_cont(song_popularity, 5e-1) AS target_median,
 round(avg(CAST(song_popularity = 0 AS DOUBLE)), 6) AS zero_rate FROM split_tracks GROUP BY split""", EXTRA)
def _(v):
    return rounded(stats.split_summary(split_tracks(v)), ["year_missing_pct", "target_mean", "zero_rate"])


@query("flag_counts", """
SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE release_year_missing_or_suspect) AS flagged_rows,
 round(avg(CAST(release_year_missing_or_suspect AS DOUBLE)) * 1e2, 6) AS flagged_pct,
 count(*) - count(album_release_year) AS missing_year_rows,
 round(avg(CAST(album_release_year IS NULL AS DOUBLE)) * 1e2, 6) AS missing_year_pct FROM split_tracks GROUP BY split""", EXTRA)
def _(v):
    return rounded(stats.flag_counts(split_tracks(v)), ["flagged_pct", "missing_year_pct"])


HASHED = ["row_key", "track_id", "song_name", "artist_name", "song_popularity", "album_release_year"]


@query("content_hash", f"SELECT count(*) AS n_rows, CAST(sum(CAST({hashed(*HASHED)} AS HUGEINT)) AS VARCHAR) AS content_hash FROM tracks")
def _(v):
    return stats.content_hash(v.tracks, HASHED)


@query("histogram", """
SELECT CASE WHEN song_popularity = 100 THEN 20 ELSE CAST(floor(song_popularity / 5e0) AS INT) + 1 END AS bin, count(*) AS n
FROM tracks GROUP BY 1""")
def _(v):
    return stats.histogram(v.tracks, "song_popularity", 0.0, 100.0, 20)


@query("box_numbers", """
SELECT song_explicit, min(loudness) AS low, round(quantile_cont(loudness, 25e-2), 6) AS q25, round(quantile_cont(loudness, 5e-1), 6) AS median,
 round(quantile_cont(loudness, 75e-2), 6) AS q75, max(loudness) AS high FROM tracks GROUP BY song_explicit""")
def _(v):
    return rounded(stats.box_numbers(v.tracks, "loudness", "song_explicit"), ["q25", "median", "q75"])


@query("unique_artists", """
SELECT artist_name, bool_or(release_year_missing_or_suspect) AS has_suspect_year FROM prepared GROUP BY artist_name""", EXTRA)
def _(v):
    return prepared(v).where("artist_name IS NOT NULL").groupBy("artist_name").agg(
        F.bool_or("release_year_missing_or_suspect").alias("has_suspect_year"))
