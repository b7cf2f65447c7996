"""What several steps of a query read is computed once."""

from pyspark.sql import functions as F

from tunegauge.operators import catalog, discover
from tunegauge.plans import modeling


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tracks_are_joined_once(spark, views):
    import __spark_entry__ as spec

    stored = views.with_stored_tracks("row_key", "artist_name", "song_name", "song_popularity")
    for of in (stored.tracks, stored.requests, stored.album_tracks):
        assert "l_orderkey" not in plan(of)
    assert sorted(stored.requests.collect()) == sorted(views.requests.collect())
    for name in ("resolve_requests", "canonical_track_choice", "album_track_choice", "deep_scan_best", "title_contains_join",
                 "permutation_importance", "full_outer_compare", "field_diff", "linear_optimum", "cluster_rows", "cluster_nearest", "save_model"):
        assert "l_orderkey" not in plan(spec.queries()[name](spark, views.sf_dir)), name


def test_answers_are_parsed_once(views):
    assert plan(modeling.run_differences(views)).count("from_json(") == 2


def test_numbers_follow_the_hash_order(spark):
    frame = spark.range(1000).select("id", (F.col("id") % 7).alias("x")).repartition(5)
    ordered = frame.withColumn("h", discover.text_hash("id", F.lit(3))).orderBy("h", "id").collect()
    got = {r["id"]: r["_number"] for r in discover._numbered(frame, "id", 3).collect()}
    assert got == {r["id"]: i for i, r in enumerate(ordered, 1)}


def test_resolver_tiers(spark):
    tracks = spark.createDataFrame([
        ("ann lee", "blue moon", "k1", 5), ("ann lee", "blue moon", "k0", 5), ("ann lee", "red sun", None, 9), ("ann lee", None, "k4", 9),
        (None, "blue moon", "k5", 99), ("bob", "green", "k6", None), ("bob", "green", "k7", 0),
    ], "artist_name string, title string, track_key string, popularity int")
    asked = spark.createDataFrame([
        ("r1", "ann lee", "ann", "blue moon"), ("r1", "ann lee", "ann", "blue moon"), ("r2", "ann lee", "ann", "red sun"),
        ("r3", "bob", "nobody", "green fields"), ("r4", "bob", "nobody", "grey"), ("r5", "eve", "eve", "grey"), (None, "bob", "nobody", "green"),
    ], "request string, artist_name string, artist_query string, title_query string")
    artists = spark.createDataFrame([("ann lee",), ("bob",)], "artist_name string")
    got = sorted(map(tuple, catalog.resolve_requests(asked, tracks, artists).collect()), key=str)
    assert got == sorted([
        ("r1", 1, "k0"), ("r1", 1, "k0"), ("r2", 3, None), ("r3", 2, "k6"), ("r4", 3, None), ("r5", 4, None), (None, 3, None)], key=str)
