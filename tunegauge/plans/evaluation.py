"""Queries: evaluation, rankings of results and set operations on a forecast that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunegauge.functions.scalars import clip_round_prediction, regime_label
from tunegauge.operators import discover, evaluate, lookup, models, setops, stats
from tunegauge.plans.cleaning import EXTRA, NUMERIC, rounded, split_tracks
from tunegauge.plans.registry import query

# Sub-queries: the one-feature forecast over split tracks with listeners.
LINE = "SELECT regr_slope(song_popularity, energy) AS a, regr_intercept(song_popularity, energy) AS b FROM split_tracks WHERE split = 'train'"
SCORED = """
SELECT row_key, split, artist_name, album_release_year, CAST(song_popularity AS DOUBLE) AS y, round(b + a * energy, 6) AS pred,
  ln(1 + coalesce(listeners, 0)) AS listeners_log, energy, danceability, valence, tempo, total_available_markets, song_explicit, mode,
  CASE WHEN ln(1 + coalesce(listeners, 0)) < 881e-2 THEN 'Cold Start' WHEN ln(1 + coalesce(listeners, 0)) < 1309e-2 THEN 'Tipping Point' ELSE 'Mainstream' END AS regime
FROM split_tracks LEFT JOIN artists USING (artist_name), line"""
EVAL = {**EXTRA, "line": LINE, "scored": SCORED}
METRICS = """count(*) AS n, round(avg(abs(y - {p})), 6) AS mae, round(sqrt(avg((y - {p}) * (y - {p}))), 6) AS rmse,
 round(1 - avg((y - {p}) * (y - {p})) / var_pop(y), 6) AS r2, round(avg(abs(y - {p})) FILTER (WHERE y = 0), 6) AS mae_zero,
 round(avg(abs(y - {p})) FILTER (WHERE y <> 0), 6) AS mae_pos, round(avg(CAST(y = 0 AS DOUBLE)) * 1e2, 6) AS pct_zero_true,
 round(avg(CAST({p} = 0 AS DOUBLE)) * 1e2, 6) AS pred_zero_pct"""
FULL = METRICS.format(p="pred")
METRIC_NAMES = ["mae", "rmse", "r2", "mae_zero", "mae_pos", "pct_zero_true", "pred_zero_pct"]


def with_target(v):
    return split_tracks(v).withColumn("y", F.col("song_popularity").cast("double"))


def scored(v):
    rows = with_target(v)
    slope, intercept = models.line_fit(rows.where("split = 'train'"), "energy")
    out = models.line_score(lookup.join_listeners(rows, v.artists), "energy", slope, intercept)
    return out.withColumn("regime", regime_label("listeners_log"))


@query("constant_median", f"""
SELECT split, {METRICS.format(p='m')} FROM (SELECT split, CAST(song_popularity AS DOUBLE) AS y,
 (SELECT quantile_cont(CAST(song_popularity AS DOUBLE), 5e-1) FROM split_tracks WHERE split = 'train') AS m FROM split_tracks) GROUP BY split""", EXTRA)
def _(v):
    return rounded(evaluate.full_metrics(models.constant_median(with_target(v)), ["split"]), METRIC_NAMES)


@query("linear_twin", "SELECT row_key, split, y, pred FROM scored", EVAL)
def _(v):
    return scored(v).select("row_key", "split", "y", "pred")


@query("regression_metrics", f"SELECT split, {FULL} FROM scored GROUP BY split", EVAL)
def _(v):
    return rounded(evaluate.full_metrics(scored(v), ["split"]), METRIC_NAMES)


@query("segmented_metrics", f"SELECT split, regime, {FULL} FROM scored GROUP BY split, regime", EVAL)
def _(v):
    return rounded(evaluate.full_metrics(scored(v), ["split", "regime"]), METRIC_NAMES)


@query("clip_metrics", """
SELECT split, round(avg(abs(y - p)), 6) AS mae_raw, round(avg(abs(y - greatest(0, least(100, p)))), 6) AS mae_clip,
 min(p) AS min_raw, max(p) AS max_raw, round(avg(p), 6) AS mean_raw, min(greatest(0, least(100, p))) AS min_clip,
 max(greatest(0, least(100, p))) AS max_clip, round(avg(greatest(0, least(100, p))), 6) AS mean_clip
FROM (SELECT split, y, pred * 2e0 - 100 AS p FROM scored) GROUP BY split""", EVAL)
def _(v):
    stretched = scored(v).withColumn("pred", F.col("pred") * 2.0 - 100)
    return rounded(evaluate.clip_metrics(stretched, ["split"]), ["mae_raw", "mae_clip", "mean_raw", "mean_clip"])


@query("binned_mae", """
SELECT bin, count(y) AS n, round(avg(abs(y - pred)), 6) AS mae FROM (VALUES ('[0,5]', -1, 5), ('(5,20]', 5, 20), ('(20,40]', 20, 40),
 ('(40,60]', 40, 60), ('(60,80]', 60, 80), ('(80,100]', 80, 100)) b(bin, lo, hi) LEFT JOIN scored ON y > lo AND y <= hi GROUP BY bin""", EVAL)
def _(v):
    return rounded(evaluate.binned_mae(scored(v)), ["mae"])


@query("mae_by_year", """
SELECT album_release_year, count(*) AS n, round(avg(abs(y - pred)), 6) AS mae FROM scored GROUP BY album_release_year""", EVAL)
def _(v):
    return rounded(evaluate.mae_by(scored(v), "album_release_year"), ["mae"])


@query("residual_summary", """
SELECT split, round(avg(y - pred), 6) AS mean, round(stddev_samp(y - pred), 6) AS std, round(min(y - pred), 6) AS min, round(max(y - pred), 6) AS max,
 round(quantile_cont(y - pred, 5e-1), 3) AS median FROM scored GROUP BY split""", EVAL)
def _(v):
    # a median of 6-digit forecasts often ends in a tie at the 7th digit, so it is compared at 3 digits
    out = rounded(evaluate.residual_summary(scored(v), ["split"]), ["mean", "std", "min", "max"])
    return rounded(out, ["median"], 3)


@query("percentile_summary", """
SELECT split, count(pred) AS n, round(avg(pred), 6) AS mean, round(stddev_pop(pred), 6) AS std, """ + ", ".join(
    f"round(quantile_cont(pred, {q}), 3) AS {n}" for n, q in [
        ("p0", "0e0"), ("p1", "1e-2"), ("p5", "5e-2"), ("p50", "5e-1"), ("p95", "95e-2"), ("p99", "99e-2"), ("p100", "1e0")]
) + " FROM scored GROUP BY split", EVAL)
def _(v):
    names = ["p0", "p1", "p5", "p50", "p95", "p99", "p100"]
    return rounded(rounded(evaluate.percentile_summary(scored(v), "pred", ["split"]), ["mean", "std"]), names, 3)


@query("regime_mae", """
SELECT regime, count(*) AS n, round(avg(abs(y - pred)), 6) AS mae, round(count(*) * 1e2 / sum(count(*)) OVER (), 6) AS share_pct,
 (SELECT round(avg(abs(y - pred)), 6) FROM scored) AS global_mae FROM scored GROUP BY regime""", EVAL)
def _(v):
    return rounded(evaluate.regime_mae(scored(v)), ["mae", "share_pct", "global_mae"])


@query("regime_bias", """
SELECT regime, round(avg(abs(y - pred)), 6) AS mae, round(avg(pred - y), 6) AS bias,
 round(avg(CAST(pred > y AS DOUBLE)) * 1e2, 6) AS pct_over FROM scored GROUP BY regime""", EVAL)
def _(v):
    return rounded(evaluate.regime_bias(scored(v)), ["mae", "bias", "pct_over"])


@query("hits_zeros_report", """
SELECT round(avg(abs(y - pred)), 6) AS mae, round(avg(abs(y - pred)) FILTER (WHERE y > 0), 6) AS mae_hits, count(*) FILTER (WHERE y > 0) AS n_hits,
 round(avg(abs(y - pred)) FILTER (WHERE y = 0), 6) AS mae_zeros, count(*) FILTER (WHERE y = 0) AS n_zeros,
 round(avg(pred) FILTER (WHERE y > 0), 6) AS mean_pred_hits, round(avg(pred) FILTER (WHERE y = 0), 6) AS mean_pred_zeros FROM scored""", EVAL)
def _(v):
    return rounded(evaluate.hits_zeros_report(scored(v)),
                   ["mae", "mae_hits", "mae_zeros", "mean_pred_hits", "mean_pred_zeros"])


PROFILE = ["energy", "danceability", "valence", "tempo", "total_available_markets"]


@query("segment_profile", """
SELECT feature, round(s, 6) AS severe_mean, round(n, 6) AS normal_mean, round((s - n) * 1e2 / nullif(abs(n), 0), 6) AS delta_pct FROM (
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) FILTER (WHERE abs(y - pred) > 40) AS s, avg({c}) FILTER (WHERE abs(y - pred) <= 40) AS n FROM scored"
    for c in PROFILE) + ")", EVAL)
def _(v):
    return rounded(evaluate.segment_profile(scored(v), PROFILE, evaluate.abs_error() > 40),
                   ["severe_mean", "normal_mean", "delta_pct"])


TAG_FLAGS = {"pop": 2, "hip_hop": 3, "rock": 5, "indie_pop": 7}
TAGGED = """
SELECT s.*, abs(y - pred) > 40 AS severe, """ + ", ".join(
    f"CAST(k % {n} = 0 AS INT) AS tag_{t}" for t, n in TAG_FLAGS.items()
) + " FROM scored s JOIN (SELECT s_name AS artist_name, s_suppkey AS k FROM supplier) USING (artist_name)"


@query("tag_prevalence", """
SELECT segment, tag, round(pct, 6) AS pct, round(mean_markets, 6) AS mean_markets FROM (
 SELECT *, row_number() OVER (PARTITION BY segment ORDER BY pct DESC, tag) AS rn FROM (
""" + " UNION ALL ".join(
    f"SELECT '{seg}' AS segment, '{t}' AS tag, avg(tag_{t}) * 100 AS pct, avg(total_available_markets) AS mean_markets FROM tagged WHERE {cond} severe"
    for seg, cond in [("severe", ""), ("normal", "NOT")] for t in TAG_FLAGS) + ")) WHERE rn <= 3", {**EVAL, "tagged": TAGGED})
def _(v):
    selected = [r["tag"] for r in lookup.top_tags(v.artist_tags, 50).collect()]
    flagged = lookup.multi_hot_tags(scored(v), v.artist_tags, selected).withColumn("tag_const", F.lit(1))
    names = [f"tag_{t}" for t in selected] + ["tag_const", "mode"]
    out = evaluate.tag_prevalence(flagged, [n for n in names if n != "mode"], evaluate.abs_error() > 40, 3)
    return rounded(out, ["pct", "mean_markets"])


@query("crosstab_pct", """
SELECT mode, round(count(*) FILTER (WHERE regime = 'Cold Start') * 1e2 / count(*), 6) AS cold_start,
 round(count(*) FILTER (WHERE regime = 'Tipping Point') * 1e2 / count(*), 6) AS tipping_point,
 round(count(*) FILTER (WHERE regime = 'Mainstream') * 1e2 / count(*), 6) AS mainstream FROM scored GROUP BY mode""", EVAL)
def _(v):
    out = evaluate.crosstab_pct(scored(v), "mode", "regime", ["Cold Start", "Tipping Point", "Mainstream"])
    return rounded(out, ["cold_start", "tipping_point", "mainstream"])


@query("cluster_profile", """
SELECT mode, count(*) AS n, round(avg(listeners_log), 6) AS mean_listeners, round(min(listeners_log), 6) AS min_listeners,
 round(max(listeners_log), 6) AS max_listeners, round(avg(y), 6) AS mean_target FROM scored GROUP BY mode""", EVAL)
def _(v):
    return rounded(evaluate.cluster_profile(scored(v), "mode", "listeners_log", "y"),
                   ["mean_listeners", "min_listeners", "max_listeners", "mean_target"])


@query("regime_thresholds", """
SELECT regime, level, round(mean, 6) AS mean, threshold FROM (SELECT regime, CAST(row_number() OVER (ORDER BY mean, regime) AS INT) AS level, mean, threshold,
  count(*) OVER () AS k FROM (SELECT regime, avg(listeners_log) AS mean, round_even(max(listeners_log), 2) AS threshold FROM scored GROUP BY regime)) WHERE level < k""", EVAL)
def _(v):
    return rounded(evaluate.regime_thresholds(scored(v), "regime", "listeners_log"), ["mean"])


LEADER = """
SELECT regime AS model, split, round(avg(abs(y - pred)), 6) AS mae FROM scored GROUP BY regime, split"""


@query("leaderboard_pivot", """
SELECT model, max(mae) FILTER (WHERE split = 'train') AS train, max(mae) FILTER (WHERE split = 'val') AS val,
 max(mae) FILTER (WHERE split = 'test') AS test FROM leader GROUP BY model""", {**EVAL, "leader": LEADER})
def _(v):
    return evaluate.leaderboard_pivot(leader(v), ["model"], "split", ["train", "val", "test"], "mae")


def leader(v):
    long = scored(v).groupBy(F.col("regime").alias("model"), "split").agg(F.avg(evaluate.abs_error()).alias("mae"))
    return rounded(long, ["mae"])


@query("model_rank", """
SELECT model, split, mae, CAST(rank() OVER (PARTITION BY split ORDER BY mae, model) AS INT) AS rank FROM leader""", {**EVAL, "leader": LEADER})
def _(v):
    return evaluate.model_rank(leader(v), ["split"])


RESULTS = """
SELECT concat(CASE WHEN mode = 1 THEN 'baseline_' ELSE 'huber_' END, replace(lower(regime), ' ', '_'), CASE WHEN song_explicit THEN '_clip' ELSE '' END) AS tag,
 CASE WHEN regime = 'Cold Start' THEN round(avg(abs(y - pred)) FILTER (WHERE split = 'val'), 6) END AS mae_val,
 round(avg(abs(y - pred)) FILTER (WHERE split = 'test'), 6) AS mae_test FROM scored GROUP BY mode, regime, song_explicit"""


@query("champion_select", """
SELECT mode, b.tag AS baseline_tag, b.mae_test AS baseline_test, c.tag AS best_tag, c.mae_test AS best_test, round(c.mae_test - b.mae_test, 6) AS gap,
 CASE WHEN c.mae_test - b.mae_test < 0 THEN c.tag ELSE b.tag END AS champion FROM (VALUES ('clip'), ('raw')) m(mode),
 LATERAL (SELECT * FROM results WHERE mae_val IS NULL AND contains(tag, 'clip') = (mode = 'clip') AND contains(tag, 'baseline') ORDER BY mae_test, tag LIMIT 1) b,
 LATERAL (SELECT * FROM results WHERE mae_val IS NULL AND contains(tag, 'clip') = (mode = 'clip') AND NOT contains(tag, 'baseline') ORDER BY mae_test, tag LIMIT 1) c""",
       {**EVAL, "results": RESULTS})
def _(v):
    error = evaluate.abs_error()
    tag = F.concat(F.when(F.col("mode") == 1, "baseline_").otherwise("huber_"),
                   F.replace(F.lower("regime"), F.lit(" "), F.lit("_")),
                   F.when(F.col("song_explicit"), "_clip").otherwise(""))
    results = scored(v).groupBy(tag.alias("tag"), "regime").agg(
        F.round(F.avg(F.when(F.col("split") == "val", error)), 6).alias("_val"),
        F.round(F.avg(F.when(F.col("split") == "test", error)), 6).alias("mae_test"),
    ).select("tag", F.when(F.col("regime") == "Cold Start", F.col("_val")).alias("mae_val"), "mae_test")
    both = stats.union_all([evaluate.champion_select(results, True), evaluate.champion_select(results, False)])
    return rounded(both, ["gap"])


GRID = [0.1, 0.2, 0.3, 0.4, 0.5]
HURDLE = """
SELECT split, y, danceability AS p_zero, pred AS pred_positive FROM scored"""
SWEEP = f"""
SELECT split, threshold, {FULL} FROM (SELECT split, y, threshold, CASE WHEN p_zero >= threshold THEN 0 ELSE pred_positive END AS pred
 FROM hurdle, (SELECT unnest([1e-1, 2e-1, 3e-1, 4e-1, 5e-1]) AS threshold)) GROUP BY split, threshold"""


def hurdle_frame(v):
    return scored(v).select("split", "y", F.col("danceability").alias("p_zero"), F.col("pred").alias("pred_positive"))


@query("hurdle_sweep", "SELECT * FROM sweep", {**EVAL, "hurdle": HURDLE, "sweep": SWEEP})
def _(v):
    return rounded(evaluate.threshold_sweep(hurdle_frame(v), GRID, ["split"]), METRIC_NAMES)


@query("guardrail_pick", """
SELECT threshold, mae, pred_zero_pct FROM sweep WHERE split = 'val' AND pred_zero_pct >= 4e-1 ORDER BY mae, threshold LIMIT 1""",
       {**EVAL, "hurdle": HURDLE, "sweep": SWEEP})
def _(v):
    sweep = evaluate.threshold_sweep(hurdle_frame(v).where("split = 'val'"), GRID, ["split"])
    return evaluate.guardrail_pick(rounded(sweep, METRIC_NAMES), 0.4)


PAIRS = [c for c in NUMERIC if c not in ("loudness", "duration_ms")]
PAIR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(abs(corr({a}, {b})), 9) AS magnitude FROM tracks"
    for i, a in enumerate(PAIRS) for b in PAIRS[i + 1:])


@query("pair_share", """
SELECT feature_1, feature_2, magnitude, round(magnitude * 100 / sum(magnitude) OVER (), 6) AS share_pct,
 round(magnitude * 100 / max(magnitude) OVER (), 6) AS relative_to_top,
 round(sum(magnitude) OVER (ORDER BY magnitude DESC, feature_1, feature_2 ROWS UNBOUNDED PRECEDING) * 100 / sum(magnitude) OVER (), 6) AS cumulative_pct,
 CAST(row_number() OVER (ORDER BY magnitude DESC, feature_1, feature_2) AS INT) AS rank FROM pairs QUALIFY rank <= 15""", {"pairs": PAIR_SQL})
def _(v):
    pairs = stats.correlation_pairs(v.tracks, PAIRS).select(
        "feature_1", "feature_2", F.round(F.abs("corr"), 9).alias("magnitude"))
    return rounded(evaluate.pair_share(pairs, 15), ["share_pct", "relative_to_top", "cumulative_pct"])


@query("cumulative_share", """
SELECT source, n, round(sum(n) OVER (ORDER BY n DESC, source ROWS UNBOUNDED PRECEDING) * 1e2 / sum(n) OVER (), 6) AS cumulative_pct FROM (
 SELECT source, count(*) AS n FROM documents GROUP BY source)""")
def _(v):
    counts = v.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    pairs = counts.select(F.col("source").alias("feature_1"), F.lit("").alias("feature_2"),
                          F.col("n").alias("magnitude"))
    out = evaluate.pair_share(pairs).select(
        F.col("feature_1").alias("source"), F.col("magnitude").alias("n"), "cumulative_pct")
    return rounded(out, ["cumulative_pct"])


@query("shared_total", """
SELECT regime, count(*) AS n, round(count(*) * 1e2 / sum(count(*)) OVER (), 6) AS share_pct FROM scored GROUP BY regime""", EVAL)
def _(v):
    counts = scored(v).groupBy("regime").agg(F.count(F.lit(1)).alias("n"))
    return rounded(evaluate.share_of_total(counts, "n"), ["share_pct"])


@query("importance_by_source", """
SELECT source, round(importance, 6) AS importance, round(importance * 100 / sum(importance) OVER (), 6) AS share_pct FROM (
 SELECT CASE WHEN feature_1 IN ('tempo', 'energy') THEN 'signal' ELSE 'mood' END AS source, sum(magnitude) AS importance FROM pairs GROUP BY 1)""", {"pairs": PAIR_SQL})
def _(v):
    pairs = stats.correlation_pairs(v.tracks, PAIRS)
    source = F.when(F.col("feature_1").isin("tempo", "energy"), "signal").otherwise("mood")
    importance = pairs.select(source.alias("source"), F.round(F.abs("corr"), 9).alias("importance"))
    return rounded(evaluate.importance_by_source(importance), ["importance", "share_pct"])


COEF = {"energy": 40.0, "danceability": -3.0, "valence": 5.0, "tempo": 0.02}
CONTRIB = """
SELECT s.*, 40e0 * (energy - (SELECT avg(energy) FROM scored WHERE split = 'train')) AS c_energy,
 -3e0 * (danceability - (SELECT avg(danceability) FROM scored WHERE split = 'train')) AS c_danceability,
 5e0 * (valence - (SELECT avg(valence) FROM scored WHERE split = 'train')) AS c_valence,
 2e-2 * (tempo - (SELECT avg(tempo) FROM scored WHERE split = 'train')) AS c_tempo FROM scored s"""


def contributions(v):
    rows = scored(v)
    means = rows.where("split = 'train'").agg(*[F.avg(c).alias(c) for c in COEF]).first().asDict()
    return discover.linear_contributions(rows, COEF, means)


@query("attributions", "SELECT row_key, " + ", ".join(f"round(c_{c}, 6) AS c_{c}" for c in COEF) + " FROM contrib",
       {**EVAL, "contrib": CONTRIB})
def _(v):
    names = [f"c_{c}" for c in COEF]
    return rounded(contributions(v).select("row_key", *names), names)


@query("attribution_by_regime", """
SELECT regime, feature, round(mean_abs, 6) AS mean_abs, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY mean_abs DESC, feature) AS rank FROM (
""" + " UNION ALL ".join(
    f"SELECT regime, 'c_{c}' AS feature, avg(abs(c_{c})) AS mean_abs FROM contrib GROUP BY regime" for c in COEF
) + ")) WHERE rank <= 3", {**EVAL, "contrib": CONTRIB})
def _(v):
    out = evaluate.attribution_by_regime(contributions(v), [f"c_{c}" for c in COEF], 3)
    return rounded(out, ["mean_abs"])


@query("worst_misses", """
SELECT row_key, y, pred, round(abs(y - pred), 6) AS abs_error FROM scored ORDER BY abs(y - pred) DESC, row_key LIMIT 10""", EVAL)
def _(v):
    return rounded(evaluate.worst_misses(scored(v)).select("row_key", "y", "pred", "abs_error"), ["abs_error"])


@query("emblematic_cases", """
SELECT "case", row_key, y, pred, round(listeners_log, 6) AS listeners_log, round(abs(y - pred), 6) AS abs_error FROM (
 SELECT * FROM (SELECT 'predicted_hit' AS "case", * FROM scored WHERE pred >= 70 OR y > 70 ORDER BY CASE WHEN pred >= 70 THEN 1 ELSE 2 END, abs(y - pred), row_key LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'largest_error' AS "case", * FROM scored ORDER BY abs(y - pred) DESC, row_key LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'silent_artist' AS "case", * FROM scored WHERE y > 10 AND listeners_log <= 1e-1
   AND row_key <> (SELECT row_key FROM scored ORDER BY abs(y - pred) DESC, row_key LIMIT 1) ORDER BY y DESC, row_key LIMIT 1))""", EVAL)
def _(v):
    return rounded(evaluate.emblematic_cases(scored(v)), ["listeners_log", "abs_error"])


@query("top_importances", """
SELECT feature, round(abs(corr), 6) AS importance FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, CAST(song_popularity AS DOUBLE)) AS corr FROM tracks" for c in NUMERIC
) + ") ORDER BY abs(corr) DESC, feature LIMIT 8")
def _(v):
    corr = stats.target_correlations(v.tracks, NUMERIC)
    top = corr.orderBy(F.abs("corr").desc(), "feature").limit(8)
    return top.select("feature", F.round(F.abs("corr"), 6).alias("importance"))


@query("lift_vs_real", """
SELECT row_key, regime, CAST(greatest(0, least(100, round_even(pred, 0))) AS INT) AS forecast,
 CAST(greatest(0, least(100, round_even(pred, 0))) AS INT) - CAST(y AS INT) AS lift FROM scored""", EVAL)
def _(v):
    forecast = clip_round_prediction("pred")
    return scored(v).select(
        "row_key", "regime", forecast.alias("forecast"), (forecast - F.col("y").cast("int")).alias("lift"))


@query("union_results", """
SELECT 'median' AS model, split, count(*) AS n, CAST(NULL AS DOUBLE) AS mae FROM split_tracks GROUP BY split
UNION ALL SELECT 'line', split, CAST(NULL AS BIGINT), round(avg(abs(y - pred)), 6) FROM scored GROUP BY split""", EVAL)
def _(v):
    first = split_tracks(v).groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("model", F.lit("median"))
    second = scored(v).groupBy("split").agg(F.round(F.avg(evaluate.abs_error()), 6).alias("mae")).withColumn("model", F.lit("line"))
    return stats.union_all([first, second])


@query("dedup_keep_first_last", """
SELECT 'first' AS kept, track_id, min_by(row_key, (song_popularity, row_key)) AS row_key FROM tracks GROUP BY track_id
UNION ALL SELECT 'last', track_id, max_by(row_key, (song_popularity, row_key)) FROM tracks GROUP BY track_id""")
def _(v):
    rows = v.tracks.select("track_id", "row_key", F.struct("song_popularity", "row_key").alias("seq"))
    parts = [
        setops.keep_first_or_last(rows, "track_id", "seq", keep).select(F.lit(keep).alias("kept"), "track_id", "row_key")
        for keep in ("first", "last")
    ]
    return stats.union_all(parts)


@query("ordered_distinct", "SELECT song_name, min(row_key) AS first_position FROM tracks GROUP BY song_name")
def _(v):
    return setops.ordered_distinct(v.tracks, "song_name", "row_key")


@query("except_intersect_keys", """
SELECT artist_name, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_baseline' ELSE 'only_current' END AS place FROM (
 SELECT artist_name, bool_or(src = 1) AS a, bool_or(src = 2) AS b FROM (SELECT artist_name, 1 AS src FROM artists
  UNION ALL SELECT artist_name, 2 FROM artist_tags) GROUP BY artist_name)""")
def _(v):
    return setops.key_sets(v.artists, v.artist_tags, ["artist_name"])


@query("melt", "\nUNION ALL\n".join(
    f"SELECT row_key, '{c}' AS feature, {c} AS value FROM tracks" for c in ("energy", "valence", "tempo")))
def _(v):
    return v.tracks.select("row_key", "energy", "valence", "tempo").unpivot(
        ["row_key"], ["energy", "valence", "tempo"], "feature", "value")


