"""Queries: features, lookups, tags and codes."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tunegauge.functions import scalars, text
from tunegauge.operators import features, lookup, stats
from tunegauge.plans.cleaning import EXTRA, prepared, rounded, split_tracks
from tunegauge.plans.registry import query
from tunegauge.session import shared_folder


def model_for(v, blocks, **options):
    rows = split_tracks(v)
    estimator = features.FeatureEstimator(blocks=blocks, options=json.dumps(options))
    return estimator.fit(rows.where("split = 'train'")), rows


def feature_query(v, blocks, columns, digits=5, **options):
    model, rows = model_for(v, blocks, **options)
    out = model.transform(rows).select("row_key", *columns)
    floats = [f.name for f in out.schema if f.dataType.typeName() in ("float", "double")]
    return out.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in floats})


FIT = """
SELECT max(album_release_year) AS current_year, avg(album_release_year) AS year_mean, stddev_pop(album_release_year) AS year_std,
  avg(tempo) AS tempo_mean, stddev_pop(tempo) AS tempo_std, avg(total_available_markets) AS markets_mean,
  stddev_pop(total_available_markets) AS markets_std FROM split_tracks WHERE split = 'train'"""
YEAR_MEANS = """
SELECT CAST(album_release_year AS INT) AS year, avg(song_popularity) AS year_mean, count(*) AS n FROM split_tracks
WHERE split = 'train' AND album_release_year IS NOT NULL GROUP BY 1"""
FEATURES = {**EXTRA, "fit": FIT, "year_means": YEAR_MEANS}
# feature columns are 4-byte floats, so the expected values take the same cast before they are rounded
TEMPORAL = """album_release_year IS NULL AS year_is_missing, album_release_year >= 1996 AS is_post_1996,
  album_release_year >= 1998 AS is_post_1998, album_release_year > current_year AS is_future_release,
  CASE WHEN album_release_year IS NOT NULL THEN greatest(current_year - album_release_year, 0) END AS age,
  CAST(CASE WHEN album_release_year IS NULL THEN NULL WHEN greatest(current_year - album_release_year, 0) <= 2 THEN 0
   WHEN greatest(current_year - album_release_year, 0) <= 3 THEN 1 WHEN greatest(current_year - album_release_year, 0) <= 10 THEN 2 ELSE 3 END AS TINYINT) AS age_bin,
  round(CAST(CAST((album_release_year - year_mean) / year_std AS FLOAT) AS DOUBLE), 5) AS year_zscore"""
AUDIO = ", ".join(f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 5) AS {n}" for n, x in [
    ("vibe", "energy * danceability"), ("soft_mood", "acousticness * valence"), ("emotional_intensity", "energy * valence"),
    ("rap_speed", "speechiness * tempo"), ("punch", "greatest(-loudness, 0) * energy")])
NONLINEAR = "tempo = 0 AS tempo_is_zero, " + ", ".join(f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 4) AS {n}" for n, x in [
    ("log_duration", "ln(1 + duration_ms)"), ("energy_sq", "energy * energy"),
    ("tempo_zscore", "(tempo - tempo_mean) / tempo_std"), ("tempo_log1p", "ln(1 + greatest(tempo, 0))")])
MARKET = """round(CAST(CAST((total_available_markets - markets_mean) / markets_std AS FLOAT) AS DOUBLE), 4) AS markets_zscore,
  CAST(CASE WHEN total_available_markets <= 100 THEN 0 WHEN total_available_markets <= 150 THEN 1 ELSE 2 END AS TINYINT) AS markets_bucket"""


@query("temporal_features", f"SELECT row_key, {TEMPORAL} FROM split_tracks, fit", FEATURES)
def _(v):
    return feature_query(
        v, ["temporal"],
        ["year_is_missing", "is_post_1996", "is_post_1998", "is_future_release", "age", "age_bin", "year_zscore"],
        age_bins=[2, 3, 10], year_thresholds=[1996, 1998],
    )


@query("audio_interactions", f"SELECT row_key, {AUDIO} FROM split_tracks", FEATURES)
def _(v):
    return feature_query(
        v, ["audio_interactions"], ["vibe", "soft_mood", "emotional_intensity", "rap_speed", "punch"], 5)


@query("non_linear_features", f"SELECT row_key, {NONLINEAR} FROM split_tracks, fit", FEATURES)
def _(v):
    return feature_query(
        v, ["non_linear"], ["log_duration", "energy_sq", "tempo_is_zero", "tempo_zscore", "tempo_log1p"], 4)


@query("market_features", f"SELECT row_key, {MARKET} FROM split_tracks, fit", FEATURES)
def _(v):
    return feature_query(v, ["market"], ["markets_zscore", "markets_bucket"], 4)


@query("target_encode_year", """
SELECT year, round(CASE WHEN n < 1500 THEN (year_mean * n + g * 20) / (n + 20) ELSE year_mean END, 6) AS year_mean, n
FROM year_means, (SELECT avg(song_popularity) AS g FROM split_tracks WHERE split = 'train')""", FEATURES)
def _(v):
    train = split_tracks(v).where("split = 'train'")
    return rounded(features.smoothed_year_means(train, 20.0, 1500), ["year_mean"])


@query("prior_year_join", """
SELECT a.year, round(a.year_mean, 6) AS year_mean, round(a.year_mean - b.year_mean, 6) AS year_trend
FROM year_means a LEFT JOIN year_means b ON a.year = b.year + 1""", FEATURES)
def _(v):
    means = features.smoothed_year_means(split_tracks(v).where("split = 'train'"), 0.0, 1)
    return rounded(features.year_trend(means), ["year_mean", "year_trend"])


@query("feature_blocks", f"""
SELECT split, count(*) AS n, round(avg(age), 4) AS age, round(avg(year_zscore), 4) AS year_zscore, round(avg(vibe), 4) AS vibe,
 round(avg(log_duration), 3) AS log_duration, round(avg(tempo_zscore), 3) AS tempo_zscore, CAST(sum(markets_bucket) AS BIGINT) AS markets_bucket,
 round(avg(m.year_mean), 3) AS year_popularity_mean, round(avg(m.year_mean - p.year_mean), 3) AS year_trend FROM (
 SELECT split, album_release_year, {TEMPORAL}, {AUDIO}, {NONLINEAR}, {MARKET} FROM split_tracks, fit) t
 LEFT JOIN year_means m ON m.year = album_release_year LEFT JOIN year_means p ON p.year = album_release_year - 1 GROUP BY split""", FEATURES)
def _(v):
    model, rows = model_for(v, features.PLAIN_BLOCKS, age_bins=[2, 3, 10], year_thresholds=[1996, 1998])
    means = {"age": 4, "year_zscore": 4, "vibe": 4, "log_duration": 3, "tempo_zscore": 3, "year_popularity_mean": 3,
             "year_trend": 3}
    return model.transform(rows).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("markets_bucket").alias("markets_bucket"),
        *[F.round(F.avg(F.col(c).cast("double")), d).alias(c) for c, d in means.items()],
    )


PROXIES = """
SELECT concat('T', CAST(o_orderkey AS VARCHAR)) AS track_id, CAST(year(o_orderdate) AS BIGINT) AS proxy_year FROM orders WHERE o_orderstatus = 'F'"""


@query("feature_pipeline", f"""
SELECT t.* EXCLUDE (artist_name, track_id, album_release_year), round(CAST(CAST(m.year_mean AS FLOAT) AS DOUBLE), 3) AS year_popularity_mean,
 round(CAST(CAST(m.year_mean - p.year_mean AS FLOAT) AS DOUBLE), 3) AS year_trend,
 round(CAST(CAST(ln(1 + coalesce(listeners, 0)) AS FLOAT) AS DOUBLE), 4) AS artist_lastfm_listeners_log,
 CAST(coalesce(list_contains(own, 'pop'), false) AS TINYINT) AS tag_pop, CAST(coalesce(list_contains(own, 'hip_hop'), false) AS TINYINT) AS tag_hip_hop,
 CAST(coalesce(list_contains(own, 'rock'), false) AS TINYINT) AS tag_rock, CAST(coalesce(list_contains(own, 'indie_pop'), false) AS TINYINT) AS tag_indie_pop,
 proxy_year AS lastfm_track_proxy
FROM (SELECT row_key, artist_name, track_id, album_release_year, {TEMPORAL}, {AUDIO}, {NONLINEAR}, {MARKET},
  round(CAST(CAST(danceability * danceability AS FLOAT) AS DOUBLE), 4) AS danceability_sq, round(CAST(CAST(valence * valence AS FLOAT) AS DOUBLE), 4) AS valence_sq
  FROM split_tracks, fit) t
 LEFT JOIN year_means m ON m.year = album_release_year LEFT JOIN year_means p ON p.year = album_release_year - 1
 LEFT JOIN artists ON artists.artist_name = t.artist_name LEFT JOIN (SELECT artist_name, list(replace(lower(tag), ' ', '_')) AS own FROM artist_tags GROUP BY artist_name) g
 ON g.artist_name = t.artist_name LEFT JOIN proxies ON proxies.track_id = t.track_id""", {**FEATURES, "proxies": PROXIES})
def _(v):
    # all six blocks, every output column of every row; the lookups are landed tables that the fitted model names
    folder = shared_folder(v.spark, "lookups")
    v.artists.write.parquet(f"{folder}/artists")
    v.artist_tags.write.parquet(f"{folder}/tags")
    v.orders.where("o_orderstatus = 'F'").select(
        F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("track_id"),
        F.year("o_orderdate").cast("bigint").alias("proxy_year")).write.parquet(f"{folder}/proxies")
    model, rows = model_for(
        v, features.BLOCKS, age_bins=[2, 3, 10], year_thresholds=[1996, 1998],
        tables={name: f"{folder}/{name}" for name in ("artists", "tags", "proxies")})
    out = model.transform(rows)
    made = [c for c in out.columns if c not in rows.columns]
    digits = {c: 4 for c in made} | {
        c: 5 for c in ("year_zscore", "vibe", "soft_mood", "emotional_intensity", "rap_speed", "punch")} | {"year_popularity_mean": 3, "year_trend": 3}
    floats = {f.name for f in out.schema if f.dataType.typeName() in ("float", "double")}
    return out.select("row_key", *[F.round(F.col(c).cast("double"), digits[c]).alias(c) if c in floats else F.col(c) for c in made])


@query("fit_median", """
SELECT row_key, split, coalesce(album_release_year, (SELECT quantile_cont(album_release_year, 5e-1) FROM split_tracks WHERE split = 'train')) AS album_release_year,
 coalesce(CASE WHEN tempo > 0 THEN tempo END, (SELECT quantile_cont(tempo, 5e-1) FROM split_tracks WHERE split = 'train' AND tempo > 0)) AS tempo
FROM split_tracks""", EXTRA)
def _(v):
    rows = split_tracks(v).withColumn("tempo", F.when(F.col("tempo") > 0, F.col("tempo")))
    imputer = features.MedianImputer(columns=["album_release_year", "tempo"]).fit(rows.where("split = 'train'"))
    return imputer.transform(rows).select("row_key", "split", "album_release_year", "tempo")


@query("inner_join_model", """
SELECT row_key, artist_name, song_name, song_popularity, album_release_year FROM prepared""", EXTRA)
def _(v):
    meta = v.tracks.select("row_key", "artist_name", "song_name")
    return lookup.join_model(meta, prepared(v).select("row_key", "song_popularity", "album_release_year"), "row_key")


@query("left_lookup_listeners", """
SELECT row_key, round(ln(1 + coalesce(listeners, 0)), 9) AS listeners_log FROM tracks LEFT JOIN artists USING (artist_name)""")
def _(v):
    return rounded(lookup.join_listeners(v.tracks, v.artists).select("row_key", "listeners_log"), ["listeners_log"], 9)


@query("listeners_log", """
SELECT artist_name, listeners, round(ln(1 + listeners), 9) AS listeners_log FROM artists""")
def _(v):
    return v.artists.select(
        "artist_name", "listeners", F.round(scalars.listeners_log("listeners"), 9).alias("listeners_log"))


TAGS = "SELECT DISTINCT artist_name, replace(lower(tag), ' ', '_') AS tag FROM artist_tags"


@query("top_tags", """
SELECT replace(lower(tag), ' ', '_') AS tag, count(*) AS n FROM artist_tags GROUP BY 1 ORDER BY n DESC, tag LIMIT 3""")
def _(v):
    return lookup.top_tags(v.artist_tags, 3)


@query("multi_hot_tags", """
SELECT row_key, """ + ", ".join(
    f"CAST(EXISTS (SELECT 1 FROM tags g WHERE g.artist_name = t.artist_name AND g.tag = '{x}') AS TINYINT) AS tag_{x}"
    for x in ("pop", "hip_hop", "rock", "indie_pop")) + " FROM tracks t", {"tags": TAGS})
def _(v):
    selected = [r["tag"] for r in lookup.top_tags(v.artist_tags, 50).collect()]
    return lookup.multi_hot_tags(v.tracks.select("row_key", "artist_name"), v.artist_tags, selected).drop("artist_name")


@query("tag_normalise", "SELECT DISTINCT artist_name, concat('tag_', tag) AS tag FROM tags", {"tags": TAGS})
def _(v):
    return v.artist_tags.select(
        "artist_name", F.concat(F.lit("tag_"), text.tag_column("tag")).alias("tag")).distinct()


@query("left_lookup_proxy", """
SELECT row_key, proxy_year FROM tracks LEFT JOIN (SELECT concat('T', CAST(o_orderkey AS VARCHAR)) AS track_id,
 year(o_orderdate) AS proxy_year FROM orders WHERE o_orderstatus = 'F') USING (track_id)""")
def _(v):
    proxies = v.orders.where("o_orderstatus = 'F'").select(
        F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("track_id"),
        F.year("o_orderdate").cast("bigint").alias("proxy_year"))
    return lookup.join_proxy(v.tracks.select("row_key", "track_id"), proxies).drop("track_id")


@query("release_features", """
SELECT row_key, CASE WHEN found = 1 THEN 1 ELSE 0 END AS mb_found,
 CASE WHEN coalesce(found, 0) <> 1 OR release_type IN ('Single', 'EP') THEN 1 ELSE 0 END AS mb_is_single,
 CASE WHEN found = 1 THEN coalesce(nullif(track_number, 0), 1) ELSE 1 END AS mb_track_number,
 CASE WHEN found = 1 THEN coalesce(nullif(track_count, 0), 1) ELSE 1 END AS mb_track_count,
 CASE WHEN found = 1 THEN round_even(coalesce(nullif(track_number, 0), 1) / coalesce(nullif(track_count, 0), 1), 4) ELSE 0 END AS mb_prominence_ratio
FROM tracks LEFT JOIN releases USING (artist_name, song_name)""")
def _(v):
    return lookup.release_features(v.tracks.select("row_key", "artist_name", "song_name"), v.releases).drop(
        "artist_name", "song_name")


V2 = """
SELECT row_key, song_popularity, CASE WHEN coalesce(found, 0) <> 1 OR release_type = 'Single' THEN 1 ELSE 0 END AS mb_is_single,
 CASE WHEN found = 1 THEN coalesce(track_number, 1) ELSE 1 END AS mb_track_number,
 CASE WHEN found = 1 THEN coalesce(track_number, 1) / CASE WHEN coalesce(track_count, 1) <= 0 THEN 1e0 ELSE coalesce(track_count, 1) END ELSE 1 END AS mb_prominence_ratio
FROM tracks LEFT JOIN releases USING (artist_name, song_name)"""


def with_releases(v):
    rows = v.tracks.select("row_key", "artist_name", "song_name", "song_popularity")
    return lookup.release_features_v2(rows, v.releases).drop("artist_name", "song_name")


@query("release_features_v2", "SELECT * EXCLUDE (song_popularity) FROM v2", {"v2": V2})
def _(v):
    return with_releases(v).drop("song_popularity")


@query("coverage_audit", """
SELECT "check", count(*) AS n_rows, count(*) FILTER (WHERE hit) AS n_hit, count(*) FILTER (WHERE hit) * 1e2 / count(*) AS hit_pct FROM (
 SELECT unnest([{'check': 'release_found', 'hit': mb_prominence_ratio <> 1}, {'check': 'single', 'hit': mb_is_single = 1}], recursive := true) FROM v2)
GROUP BY 1""", {"v2": V2})
def _(v):
    return stats.coverage(with_releases(v), {
        "release_found": F.col("mb_prominence_ratio") != 1, "single": F.col("mb_is_single") == 1})


@query("regime_coverage", """
SELECT regime, count(*) AS n, round(avg(coalesce(n_tags, 0)), 6) AS tags_per_track, round(avg(CAST(n_tags IS NOT NULL AS DOUBLE)) * 1e2, 6) AS tagged_pct,
 round(avg(total_available_markets), 6) AS mean_markets FROM (
 SELECT t.total_available_markets, n_tags, CASE WHEN ln(1 + coalesce(listeners, 0)) < 881e-2 THEN 'Cold Start' WHEN ln(1 + coalesce(listeners, 0)) < 1309e-2 THEN 'Tipping Point' ELSE 'Mainstream' END AS regime
 FROM tracks t LEFT JOIN artists USING (artist_name) LEFT JOIN (SELECT artist_name, count(DISTINCT replace(lower(tag), ' ', '_')) AS n_tags FROM artist_tags GROUP BY artist_name) USING (artist_name))
GROUP BY regime""")
def _(v):
    tags = v.artist_tags.groupBy("artist_name").agg(F.count_distinct(text.tag_column("tag")).alias("n_tags"))
    rows = lookup.join_listeners(v.tracks, v.artists).join(tags, "artist_name", "left")
    rows = rows.withColumn("regime", scalars.regime_label("listeners_log"))
    return rounded(stats.coverage_by(rows, "regime", "n_tags", "total_available_markets"), ["tags_per_track", "tagged_pct", "mean_markets"])


@query("release_dtypes", """
SELECT unnest(['mb_is_single', 'mb_track_number', 'mb_prominence_ratio']) AS name, unnest(['int', 'int', 'double']) AS dtype, count(*) AS n_rows,
 CAST(0 AS BIGINT) AS n_missing FROM v2""", {"v2": V2})
def _(v):
    return stats.dtype_audit(with_releases(v), ["mb_is_single", "mb_track_number", "mb_prominence_ratio"])


@query("sanity_audit", """
SELECT 'corr' AS metric, 'mb_is_single' AS name, round(corr(mb_is_single, song_popularity), 6) AS value FROM v2
UNION ALL SELECT 'corr', 'mb_track_number', round(corr(mb_track_number, song_popularity), 6) FROM v2
UNION ALL SELECT 'corr', 'mb_prominence_ratio', round(corr(mb_prominence_ratio, song_popularity), 6) FROM v2
UNION ALL SELECT 'coverage_pct', 'release_found', round(avg(CAST(mb_prominence_ratio <> 1 AS DOUBLE)) * 1e2, 6) FROM v2
UNION ALL SELECT 'class_pct', CAST(mb_is_single AS VARCHAR), round(count(*) * 1e2 / sum(count(*)) OVER (), 6) FROM v2 GROUP BY mb_is_single""", {"v2": V2})
def _(v):
    rows = with_releases(v)
    corr = stats.target_correlations(rows, ["mb_is_single", "mb_track_number", "mb_prominence_ratio"])
    cover = stats.coverage(rows, {"release_found": F.col("mb_prominence_ratio") != 1})
    classes = stats.value_counts(rows, "mb_is_single")
    parts = [
        corr.select(F.lit("corr").alias("metric"), F.col("feature").alias("name"), F.col("corr").alias("value")),
        cover.select(F.lit("coverage_pct").alias("metric"), F.col("check").alias("name"), F.col("hit_pct").alias("value")),
        classes.select(F.lit("class_pct").alias("metric"), F.col("mb_is_single").cast("string").alias("name"),
                       F.col("pct").alias("value")),
    ]
    return rounded(stats.union_all(parts), ["value"])


@query("anti_join_pending", """
SELECT DISTINCT artist_name, song_name FROM tracks t WHERE NOT EXISTS (SELECT 1 FROM releases r
 WHERE r.artist_name = t.artist_name AND r.song_name = t.song_name AND (r.track_number IS NOT NULL OR r.found = 0))""")
def _(v):
    done = v.releases.select(
        "artist_name", "song_name", F.col("track_number").alias("qid"),
        F.when(F.col("found") == 0, "invalid").otherwise("done").alias("status"))
    return lookup.pending(v.tracks, done, ["artist_name", "song_name"])


@query("distinct_pairs", "SELECT DISTINCT artist_name, song_name FROM tracks")
def _(v):
    return v.tracks.select("artist_name", "song_name").distinct()


CODES = """
SELECT request, unnest([concat('C', CAST(k AS VARCHAR), '-1'), concat('C', CAST(k AS VARCHAR), '-2'), concat('C', CAST(k AS VARCHAR), '-2')]) AS code
FROM (SELECT CAST(c_custkey AS BIGINT) AS request, c_custkey AS k FROM customer)"""


@query("code_batch_lookup", """
SELECT DISTINCT request, track_key, isrc FROM codes JOIN album_tracks ON code = isrc""", {"codes": CODES})
def _(v):
    key = F.col("c_custkey").cast("string")
    codes = F.array(*[F.concat(F.lit("C"), key, F.lit(f"-{n}")) for n in (1, 2, 2)])
    wanted = v.customer.select(F.col("c_custkey").alias("request"), codes.alias("codes"))
    return lookup.match_codes(wanted, v.album_tracks.select("track_key", "isrc"))


@query("explode_keyed_json", """
SELECT event_id, key, CAST(json_extract(props, '$.' || key) AS BIGINT) AS value FROM (
 SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def _(v):
    return lookup.explode_keyed_json(v.events.select("event_id", "props"), "props").drop("props")


@query("regime", """
SELECT row_key, CASE WHEN listeners IS NULL THEN NULL WHEN ln(1 + listeners) < 881e-2 THEN 0 WHEN ln(1 + listeners) < 1309e-2 THEN 1 ELSE 2 END AS regime_id,
 CASE WHEN listeners IS NULL THEN NULL WHEN ln(1 + listeners) < 881e-2 THEN 'Cold Start' WHEN ln(1 + listeners) < 1309e-2 THEN 'Tipping Point' ELSE 'Mainstream' END AS regime
FROM tracks LEFT JOIN artists USING (artist_name)""")
def _(v):
    joined = v.tracks.select("row_key", "artist_name").join(v.artists, "artist_name", "left")
    x = F.log1p(F.col("listeners").cast("double"))
    return joined.select("row_key", scalars.regime_id(x).alias("regime_id"), scalars.regime_label(x).alias("regime"))


@query("pitch_key_name", """
SELECT row_key, CASE WHEN key BETWEEN 0 AND 11 THEN concat(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][key + 1], CASE WHEN mode = 1 THEN ' Maj' ELSE ' Min' END)
 ELSE 'Unknown' END AS key_name FROM (SELECT row_key, mode, CASE WHEN time_signature = 5 THEN key + 12 ELSE key END AS key FROM tracks)""")
def _(v):
    key = F.when(F.col("time_signature") == 5, F.col("key") + 12).otherwise(F.col("key"))
    return v.tracks.select("row_key", scalars.pitch_key_name(key, "mode").alias("key_name"))


@query("market_count", """
SELECT conv_id, turn, CASE WHEN role = 'user' OR coalesce(text, '') = '' THEN 18e1 ELSE CAST(len(string_split(text, ',')) AS DOUBLE) END AS markets
FROM conversations""")
def _(v):
    codes = F.when(F.col("role") == "user", "").otherwise(F.col("text"))
    return v.conversations.select(
        "conv_id", "turn", scalars.market_count(codes).alias("markets"))


@query("clip_round_prediction", """
SELECT row_key, CAST(greatest(0, least(100, round_even(duration_ms / 3000 - 5, 0))) AS INT) AS forecast FROM tracks""")
def _(v):
    return v.tracks.select("row_key", scalars.clip_round_prediction(F.col("duration_ms") / 3000 - 5).alias("forecast"))


CREDITS = """
SELECT row_key AS credit_id, CASE time_signature % 4 WHEN 0 THEN artist_name WHEN 1 THEN concat(artist_name, ' feat. Guest ', CAST(key AS VARCHAR))
 WHEN 2 THEN concat(artist_name, ' / DJ ', CAST(key AS VARCHAR), ' x ', lower(artist_name)) ELSE concat(artist_name, ' vs.  ', artist_name, ' & Band') END AS raw FROM tracks"""


def credits(v):
    artist, key = F.col("artist_name"), F.col("key").cast("string")
    kind = F.col("time_signature") % 4
    raw = (
        F.when(kind == 0, artist).when(kind == 1, F.concat(artist, F.lit(" feat. Guest "), key))
        .when(kind == 2, F.concat(artist, F.lit(" / DJ "), key, F.lit(" x "), F.lower(artist)))
        .otherwise(F.concat(artist, F.lit(" vs.  "), artist, F.lit(" & Band")))
    )
    return v.tracks.select(F.col("row_key").alias("credit_id"), raw.alias("raw"))


SPLIT_NAMES = r"""
SELECT credit_id, raw, list_filter(list_transform(flatten(list_transform(string_split(raw, ' / '),
 lambda c: regexp_split_to_array(c, '\s+(?:feat\.?|ft\.?|&|x|with|vs\.?|presents|features)\s+'))), lambda n: trim(n)), lambda n: n <> '') AS parts FROM credits"""
NAMES = """
SELECT credit_id, raw, list_filter(parts, lambda n, i: list_position(list_transform(parts, lambda m: lower(m)), lower(n)) = i) AS names FROM split_names"""
PEOPLE = {"credits": CREDITS, "split_names": SPLIT_NAMES, "names": NAMES}


@query("split_collaborations", "SELECT credit_id, array_to_string(names, '|') AS names FROM names", PEOPLE)
def _(v):
    return credits(v).select("credit_id", F.array_join(text.split_collaborations("raw"), "|").alias("names"))


@query("two_pass_entity", """
SELECT n.credit_id, u.name, CASE WHEN a.artist_name IS NOT NULL THEN 1 ELSE 2 END AS pass_no, b.artist_name IS NOT NULL AS found
FROM names n LEFT JOIN artists a ON a.artist_name = n.raw,
 LATERAL (SELECT unnest(CASE WHEN a.artist_name IS NOT NULL THEN [n.raw] ELSE n.names END) AS name) u
 LEFT JOIN artists b ON b.artist_name = u.name""", PEOPLE)
def _(v):
    return lookup.two_pass_entities(credits(v), v.artists)


@query("merge_nationalities", """
SELECT c_custkey, nullif(array_to_string(list_filter(CASE WHEN trim(a) = trim(b) THEN [trim(a)] ELSE [trim(a), trim(b)] END, lambda x: x IS NOT NULL), ' / '), '') AS nationality FROM (
 SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN concat(' ', n_name) END AS a, CASE WHEN c_custkey % 2 = 0 THEN n_name WHEN c_custkey % 9 = 0 THEN NULL ELSE r_name END AS b
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""")
def _(v):
    key = F.col("c_custkey")
    joined = v.customer.join(v.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        v.region, F.col("n_regionkey") == F.col("r_regionkey"))
    first = F.when(key % 3 != 0, F.concat(F.lit(" "), "n_name"))
    second = F.when(key % 2 == 0, F.col("n_name")).when(key % 9 != 0, F.col("r_name"))
    return joined.select("c_custkey", text.merge_nationalities(first, second).alias("nationality"))


@query("extract_code", r"""
SELECT page_id, nullif(regexp_extract(concat(url, '/Q', CAST(page_id AS VARCHAR)), 'Q\d+', 0), '') AS qid,
 TRY_CAST(nullif(regexp_replace(concat('A', CAST(page_id AS VARCHAR), 'b'), '[^0-9]', '', 'g'), '') AS INT) AS digits FROM pages""")
def _(v):
    key = F.col("page_id").cast("string")
    return v.pages.select(
        "page_id", text.extract_code(F.concat("url", F.lit("/Q"), key)).alias("qid"),
        text.digits_of(F.concat(F.lit("A"), key, F.lit("b"))).alias("digits"))


@query("composite_key", r"""
SELECT row_key, concat(trim(regexp_replace(artist_name, '\s+', ' ', 'g')), ' || ', trim(regexp_replace(concat('  ', song_name, '   x'), '\s+', ' ', 'g'))) AS key FROM tracks""")
def _(v):
    return v.tracks.select(
        "row_key", text.composite_key("artist_name", F.concat(F.lit("  "), "song_name", F.lit("   x"))).alias("key"))


@query("release_year_from_date", r"""
SELECT row_key, coalesce(TRY_CAST(nullif(regexp_extract(album_release_date, '^([0-9]{4})', 1), '') AS INT), 2025) AS year
FROM (SELECT row_key, CASE WHEN mode = 1 THEN album_release_date ELSE substring(album_release_date, 3) END AS album_release_date FROM tracks)""")
def _(v):
    date = F.when(F.col("mode") == 1, F.col("album_release_date")).otherwise(F.substring("album_release_date", 3, 100))
    return v.tracks.select("row_key", F.coalesce(text.year_of(date), F.lit(2025)).alias("year"))


BASIC = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({0}, '\([^)]*\)', ' ', 'g'), '\[[^\]]*\]', ' ', 'g')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("normalize_basic_text", f"SELECT doc_id, md5({BASIC.format('text')}) AS digest, len({BASIC.format('text')}) AS n FROM documents")
def _(v):
    plain = text.normalize_basic_text("text")
    return v.documents.select("doc_id", F.md5(plain).alias("digest"), F.length(plain).cast("bigint").alias("n"))


ARTIST = r"trim(regexp_replace(regexp_replace(strip_accents(lower(trim({0}))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("normalize_artist_name", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, md5({ARTIST.format('text')}) AS digest FROM documents
UNION ALL SELECT mention_id, md5({ARTIST.format('mention')}) FROM mentions""")
def _(v):
    both = v.documents.select(F.col("doc_id").cast("string").alias("id"), "text").unionByName(
        v.mentions.select(F.col("mention_id").alias("id"), F.col("mention").alias("text")))
    return both.select("id", F.md5(text.normalize_artist_name("text")).alias("digest"))


@query("artist_name_match_score", """
SELECT c_custkey, CAST(CASE WHEN q = c THEN 100 WHEN len(s) = len(qt) AND len(ct) = len(qt) THEN 95 WHEN len(s) = len(qt) THEN 80
 ELSE floor(len(s) / len(qt) * 60) END AS INT) AS score FROM (
 SELECT *, list_intersect(qt, ct) AS s FROM (SELECT *, string_split(q, ' ') AS qt, string_split(c, ' ') AS ct FROM (
  SELECT c_custkey, concat(lower(n_name), CASE WHEN c_custkey % 3 = 0 THEN ' trio' ELSE '' END) AS q,
   CASE c_custkey % 4 WHEN 0 THEN concat(lower(n_name), ' trio') WHEN 1 THEN concat('trio ', lower(n_name)) WHEN 2 THEN lower(r_name) ELSE lower(n_name) END AS c
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)))""")
def _(v):
    key = F.col("c_custkey")
    joined = v.customer.join(v.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        v.region, F.col("n_regionkey") == F.col("r_regionkey"))
    asked = F.concat("n_name", F.when(key % 3 == 0, " Trio").otherwise(""))
    found = F.when(key % 4 == 0, F.concat("n_name", F.lit(" (Trio)"))).when(
        key % 4 == 1, F.concat(F.lit("Tríó "), "n_name")).when(key % 4 == 2, F.col("r_name")).otherwise(F.col("n_name"))
    return joined.select("c_custkey", text.artist_name_match_score(asked, found).alias("score"))
