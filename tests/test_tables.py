"""Cleaning, splits, fitted state, quantiles, metrics, comparison, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from tunegauge.operators import clean, diff, discover, evaluate, features, lookup, quantiles, setops, split, stats
from tunegauge.schema import RAW_TRACKS
from tunegauge.session import shared_folder
from tunegauge.sources import io
from tunegauge.streaming import ingest


def test_years(spark):
    rows = [("1999-05-01", None), ("1999-05", 1998.0), ("1999", None), ("0000", 2000.0), ("n/a", None), (None, 1899.0), ("x", 1900.0)]
    frame = spark.createDataFrame(rows, "album_release_date string, album_release_year double")
    kept = clean.flag_suspect_year(clean.normalize_release_year(frame), 2020).collect()
    assert sorted((r["album_release_year"] or 0, r["release_year_missing_or_suspect"]) for r in kept) == [
        (0, True), (0, True), (1998.0, False), (1999.0, False), (1999.0, False)]


def test_dedup_breaks_ties(spark):
    frame = spark.createDataFrame([("a", 5, "z"), ("a", 5, "b"), ("a", 1, "a"), ("b", None, "q")], "k string, song_popularity int, r string")
    assert {(r["k"], r["r"]) for r in clean.dedup_keep_max(frame, "k", tie_break=["r"]).collect()} == {("a", "b"), ("b", "q")}


def test_contracts_raise(spark):
    frame = spark.createDataFrame([(1, 101)], "a int, song_popularity int")
    with pytest.raises(ValueError, match="missing required"):
        clean.require_columns(frame, ["a", "b"])
    with pytest.raises(ValueError, match="disallowed"):
        clean.forbid_columns(frame, ["a"])
    with pytest.raises(ValueError, match="outside 0..100"):
        clean.validate_target_range(frame)
    with pytest.raises(ValueError, match="no song_popularity"):
        clean.validate_target_range(frame.select(F.lit(None).cast("int").alias("song_popularity")))


def test_dtypes_round_half_even_and_overflow(spark):
    frame = spark.createDataFrame([("2.5", 130.0), ("3.5", 1.0), ("x", None)], "song_popularity string, key double")
    got = clean.enforce_dtypes(frame)
    assert [r["song_popularity"] for r in got.collect()] == [2, 4, None] and [r["key"] for r in got.collect()] == [None, 1, None]
    assert dict(got.dtypes) == {"song_popularity": "smallint", "key": "tinyint"}


def test_splits_do_not_depend_on_partitions(spark, views):
    one = split.random_split(views.tracks.coalesce(1), "row_key")
    many = split.random_split(views.tracks.repartition(8), "row_key")
    assert stats.content_hash(one).collect() == stats.content_hash(many).collect()
    shares = {r["split"]: r["pct"] for r in stats.value_counts(one, "split").collect()}
    assert abs(shares["train"] - 70) < 3 and abs(shares["val"] - 15) < 3


def test_missing_year_policies(spark):
    frame = spark.createDataFrame([(1999.0,), (2000.0,), (2001.0,), (None,), (2005.0,)], "album_release_year double")
    assert split.temporal_split(frame, 1999).count() == 4
    assert split.temporal_split(frame, 1999, missing_year="drop").count() == 3
    with pytest.raises(ValueError):
        split.temporal_split(frame, 1999, missing_year="error")
    with pytest.raises(ValueError, match="empty"):
        split.check_year_coverage(split.temporal_split(frame.where("album_release_year <> 2001"), 1999), 1999)


def test_fitted_state_ignores_test_rows(spark, views):
    rows = split.temporal_split(clean.flag_suspect_year(clean.normalize_release_year(views.tracks)), 1999)
    changed = rows.withColumn("tempo", F.when(F.col("split") == "test", 9999.0).otherwise(F.col("tempo"))).withColumn(
        "album_release_year", F.when(F.col("split") == "test", 2090.0).otherwise(F.col("album_release_year")))

    def state(frame):
        fitted = features.FeatureEstimator().fit(frame.where("split = 'train'")).fitted()
        years = fitted.pop("year_means")
        return {k: round(v, 9) for k, v in fitted.items()}, {k: round(v, 9) for k, v in years.items()}

    assert state(rows) == state(changed)


def test_feature_model_round_trip_and_missing_inputs(spark, views):
    train = views.tracks.where("album_release_year > 1900")
    model = features.FeatureEstimator().fit(train)
    path = shared_folder(spark, "feature-model")
    model.write().overwrite().save(path)
    again = features.FeatureModel.load(path)
    assert stats.content_hash(again.transform(train)).collect() == stats.content_hash(model.transform(train)).collect()
    with pytest.raises(ValueError, match="needs columns"):
        features.FeatureEstimator().fit(train.drop("tempo"))
    partial = features.FeatureEstimator(options='{"optional": true}').fit(train.drop("tempo")).transform(train.drop("tempo"))
    assert "vibe" in partial.columns and "rap_speed" not in partial.columns and "tempo_zscore" not in partial.columns


def test_year_trend_is_null_after_a_gap(spark):
    means = spark.createDataFrame([(1990, 1.0), (1991, 3.0), (1993, 4.0)], "year int, year_mean double")
    assert {r["year"]: r["year_trend"] for r in features.year_trend(means).collect()} == {1990: None, 1991: 2.0, 1993: None}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_exact_percentiles_of_many_values(spark, by):
    rows = spark.range(5000).select(
        (F.col("id") % 3).alias("g"),
        F.when(F.col("id") % 3 == 0, 0.5).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.abs(F.xxhash64("id") % 100003) / 7.0).alias("x"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    rows = rows.withColumn("g", F.when(F.col("g") > 0, F.col("g"))).withColumn("x", F.when(F.col("x") > 14_000, float("nan")).otherwise(F.col("x")))
    known = rows.where("x is not null and not isnan(x)")
    slow = known.groupBy(*by).agg(F.percentile("x", probs).alias("p")).select(*by, F.posexplode("p").alias("i", "value"))
    slow = slow.select(*by, F.element_at(F.lit(probs), F.col("i") + 1).alias("prob"), "value")
    fast = quantiles.exact_percentiles(rows, ["x"], probs, by)

    def key(frame):
        return sorted(((*[r[c] for c in by], r["prob"], round(r["value"], 6)) for r in frame.collect()), key=repr)

    assert key(slow) == key(fast) and len(key(fast)) == len(probs) * (3 if by else 1)


def test_metric_edges(spark):
    frame = spark.createDataFrame([("z", 0.0, -5.0), ("z", 0.0, 120.0), ("p", 50.0, 50.0)], "g string, y double, pred double")
    got = {r["g"]: r for r in evaluate.full_metrics(frame, ["g"]).collect()}
    assert got["z"]["r2"] is None and got["z"]["mae_pos"] is None and got["p"]["mae_zero"] is None
    clipped = {r["g"]: r for r in evaluate.clip_metrics(frame, ["g"]).collect()}
    assert clipped["z"]["mae_clip"] == 50.0 and clipped["z"]["mae_raw"] == 62.5
    bins = {r["bin"]: r["n"] for r in evaluate.binned_mae(frame).collect()}
    assert bins == {"[0,5]": 2, "(5,20]": 0, "(20,40]": 0, "(40,60]": 1, "(60,80]": 0, "(80,100]": 0}


def test_champion_without_baseline(spark):
    runs = spark.createDataFrame([("xgb", None, 3.0), ("huber", None, 2.0), ("old", 1.0, 1.0)], "tag string, mae_val double, mae_test double")
    row = evaluate.champion_select(runs, False).first()
    assert row["baseline_tag"] == "none" and row["champion"] == "huber"
    assert evaluate.champion_select(runs, True).isEmpty()


def test_emblematic_fallbacks(spark):
    rows = [("a", 80.0, 60.0, 5.0), ("b", 5.0, 65.0, 3.0), ("c", 7.0, 7.0, 1.0)]
    frame = spark.createDataFrame(rows, "row_key string, y double, pred double, listeners_log double")
    got = {r["case"]: r["row_key"] for r in evaluate.emblematic_cases(frame).collect()}
    assert got == {"predicted_hit": "a", "largest_error": "b", "silent_artist": "a"}


def test_compare_runs(spark):
    schema = "case_key string, title string, is_partial string, success string"
    old = spark.createDataFrame([("1", "a", "x", None), ("2", "b", "x", None), ("3", "c", None, "t")], schema)
    new = spark.createDataFrame([("1", "z", "x", None), ("3", "c", "y", "t"), ("4", "d", "x", None)], schema)
    got = {(r["case_key"], r["kind"], r["field"], r["severity"]) for r in diff.full_outer_compare(old, new, ["case_key"]).collect()}
    assert got == {("1", "changed", "title", "critical"), ("2", "missing_case", "", "critical"),
                   ("3", "changed", "is_partial", "warning"), ("4", "extra_case", "", "warning")}
    assert diff.verdict(diff.full_outer_compare(old, old, ["case_key"])).first()["verdict"] == "passed"
    with pytest.raises(Exception, match="duplicate case in baseline: 1"):
        diff.full_outer_compare(old.union(old.limit(1)), new, ["case_key"]).collect()


def test_own_results_are_stable(spark, views):
    one = evaluate.mae_by(views.tracks.select("artist_name", F.col("song_popularity").alias("y"), F.lit(40).alias("pred")), "artist_name")
    many = evaluate.mae_by(views.tracks.repartition(8).select("artist_name", F.col("song_popularity").alias("y"), F.lit(40).alias("pred")), "artist_name")
    assert diff.full_outer_compare(one, many, ["artist_name"], {"n": "critical"}).isEmpty()


def test_two_pass_and_pending(spark):
    credits = spark.createDataFrame([("1", "Duo & Co"), ("2", "A & B"), ("3", " A  & b ")], "credit_id string, raw string")
    known = spark.createDataFrame([("Duo & Co",), ("A",)], "artist_name string")
    got = {(r["credit_id"], r["name"], r["pass_no"], r["found"]) for r in lookup.two_pass_entities(credits, known).collect()}
    assert got == {("1", "Duo & Co", 1, True), ("2", "A", 2, True), ("2", "B", 2, False), ("3", "A", 2, True), ("3", "b", 2, False)}
    done = spark.createDataFrame([("A", "Q1", "done"), ("B", None, "done"), ("C", None, "invalid")], "k string, qid string, status string")
    keys = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("D",)], "k string")
    assert sorted(r["k"] for r in lookup.pending(keys, done, ["k"]).collect()) == ["B", "D"]


def test_keep_first_last(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2)], "tag string, seq int")
    assert setops.keep_first_or_last(frame, "tag", "seq", "last").first()["seq"] == 3
    assert setops.keep_first_or_last(frame, "tag", "seq").first()["seq"] == 1


def test_permutation_keeps_every_row(spark):
    frame = spark.range(500).select("id", F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    numbers = [r["_number"] for r in discover._numbered(frame, "id", 42).collect()]
    assert sorted(numbers) == list(range(1, 501))
    got = discover.permutation_importance(frame, ["x"], lambda f: f.withColumn("pred", F.col("x")), "id").first()
    assert got["mae_base"] == 0.0 and got["importance"] > 50


def test_keyed_json_and_csv(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "lookup.json").write_text('{"artists": {"A": {"tags": ["x"], "listeners": 5}, "B": {"listeners": null}}}')
    value = T.StructType([T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("listeners", T.LongType())])
    rows = io.read_keyed_json(spark, str(tmp_path / "lookup.json"), "artists", value).collect()
    assert {(r["key"], r["listeners"]) for r in rows} == {("A", 5), ("B", None)}
    (tmp_path / "bad.csv").write_text("spotify_id,energy\n1,0.5\n")
    with pytest.raises(ValueError, match="missing required"):
        io.read_raw_csv(spark, str(tmp_path / "bad.csv"))
    row = io.read_raw_csv(spark, str(tmp_path / "bad.csv"), RAW_TRACKS, ["spotify_id"]).first()
    assert row["energy"] == 0.5


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def land(name, rows):
        frame = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
        frame.withColumn("t", F.col("t").cast("timestamp_ntz")).withColumnRenamed("t", "ts").coalesce(1).write.parquet(f"{source}/{name}")

    def run():
        stream = ingest.event_stream(spark, f"{source}/*", "*.parquet")
        ingest.enrichment_ingest(stream, ["user_id"], ["ts", "event_id"], out, state)
        return sorted((r["user_id"], r["value"]) for r in spark.read.parquet(out).collect())

    land("a", [(1, "2024-01-01 00:01:00", 7, "x", 1.0, "{}"), (2, "2024-01-01 00:00:00", 7, "x", 2.0, "{}")])
    assert run() == [(7, 2.0)]
    land("b", [(3, "2024-01-01 00:02:00", 7, "x", 1.0, "{}"), (4, "2024-01-01 00:03:00", 8, "x", 1.0, "{}")])
    assert run() == [(7, 2.0), (8, 1.0)]
    assert run() == [(7, 2.0), (8, 1.0)]


def test_lookups_wait_for_the_ttl_of_the_last_one(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def land(name, times):
        rows = [(i, t, 7, "x", 1.0, "{}") for i, t in enumerate(times)]
        frame = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
        frame.withColumn("t", F.col("t").cast("timestamp_ntz")).withColumnRenamed("t", "ts").coalesce(1).write.parquet(f"{source}/{name}")

    def run():
        stream = ingest.event_stream(spark, f"{source}/*", "*.parquet")
        ingest.run_available(ingest.ttl_dedup(stream, ["user_id"], 3600), out, state)
        return sorted(str(r["asked_at"])[11:16] for r in spark.read.parquet(out).collect())

    land("a", ["2024-01-01 10:01:00", "2024-01-01 09:59:00", "2024-01-01 10:59:00"])
    assert run() == ["09:59", "10:59"]
    land("b", ["2024-01-01 11:30:00", "2024-01-01 11:59:00", "2024-01-01 15:00:00"])
    assert run() == ["09:59", "10:59", "11:59", "15:00"]


def test_champion_passes_over_untested_runs(spark):
    runs = spark.createDataFrame(
        [("baseline_a", None, 5.0), ("b", None, None), ("c", None, 4.0)], "tag string, mae_val double, mae_test double")
    row = evaluate.champion_select(runs, False).first()
    assert row["best_tag"] == "c" and row["champion"] == "c"


def test_listener_and_tag_block_replays_fitted_tags(spark):
    import json

    folder = shared_folder(spark, "lookups-test")
    spark.createDataFrame([("Ann", 99), ("Bob", None)], "artist_name string, listeners long").write.parquet(f"{folder}/artists")
    tags = [("Ann", "Hip Hop"), ("Ann", "hip_hop"), ("Ann", "rock"), ("Bob", "rock"), ("Cy", "jazz")]
    spark.createDataFrame(tags, "artist_name string, tag string").write.parquet(f"{folder}/tags")
    spark.createDataFrame([("t1", 1970)], "track_id string, proxy_year long").write.parquet(f"{folder}/proxies")
    rows = spark.createDataFrame([("t1", "Ann"), ("t2", "Bob"), ("t3", None), ("t4", "Cy")], "track_id string, artist_name string")
    tables = {name: f"{folder}/{name}" for name in ("artists", "tags", "proxies")}
    options = json.dumps({"tables": tables, "top_tags": 2})
    fitted = features.FeatureEstimator(blocks=["lastfm"], options=options).fit(rows.limit(1))
    path = shared_folder(spark, "listener-model")
    fitted.save(path)
    out = features.FeatureModel.load(path).transform(rows)
    assert out.columns == ["track_id", "artist_name", "artist_lastfm_listeners_log", "tag_hip_hop", "tag_rock", "lastfm_track_proxy"]
    got = {r["track_id"]: (round(r["artist_lastfm_listeners_log"], 4), r["tag_hip_hop"], r["tag_rock"], r["lastfm_track_proxy"]) for r in out.collect()}
    assert got == {"t1": (4.6052, 1, 1, 1970), "t2": (0.0, 0, 1, None), "t3": (0.0, 0, 0, None), "t4": (0.0, 0, 0, None)}
    with pytest.raises(ValueError, match="tables"):
        features.FeatureEstimator(blocks=["lastfm"]).fit(rows)
    assert features.FeatureEstimator(blocks=["lastfm"], options='{"optional": true}').fit(rows).transform(rows).columns == rows.columns
