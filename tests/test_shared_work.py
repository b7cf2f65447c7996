"""What many requests or rows have in common is done once, with the rows of the plain way."""

from pyspark.sql import functions as F

from tunegauge.operators import catalog, match, ranking
from tunegauge.sources.views import Views


def as_rows(frame):
    return sorted(map(repr, frame.select(sorted(frame.columns)).collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def ranked_rows(spark):
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        (F.xxhash64("id") % 17).alias("score"), F.concat(F.lit("k"), F.col("id")).alias("id"))


def test_groups_of_few_and_of_many_rows_are_ranked_alike(spark, monkeypatch):
    rows = ranked_rows(spark)
    small = ranking.rank_per_group(rows, ["g"], [-F.col("score"), "id"], "rank", ["id"])
    assert "_piece" not in plan(small) and small.columns == ["g", "id", "rank"]
    monkeypatch.setattr(ranking, "HOT_ROWS", 200)
    hot = ranking.rank_per_group(rows, ["g"], [-F.col("score"), "id"], "rank", ["id"])
    assert "_piece" in plan(hot) and as_rows(hot) == as_rows(small) and small.count() == 3000
    every = ranking.rank_per_group(rows, [], [-F.col("score"), "id"], "rank")
    assert sorted(r["rank"] for r in every.collect()) == list(range(1, 3001))


def test_order_columns_that_are_kept_are_carried_once(spark):
    ranked = ranking.rank_per_group(ranked_rows(spark), ["g"], [-F.col("score"), "id"], "rank", ["id"])
    assert "_o1" not in plan(ranked) and "_o0" in plan(ranked)


def test_requests_that_read_the_same_are_asked_once(spark):
    rows = spark.createDataFrame([
        (f"k{i:02}", ("Ann Lee", "Bob", None)[i % 3], ("Blue Sky", "Blue Sky (Live)", "Sky - Remix", None)[i % 4], i % 5, f"C{i % 6}") for i in range(60)
    ], "track_key string, artist_name string, title string, popularity int, isrc string").withColumns({
        "text_score": F.col("popularity") + 60, "disambiguation": F.lit(None).cast("string"), "release_count": F.col("popularity")})
    asks = spark.createDataFrame([
        ("a", "Ann", "Blue Sky"), ("b", "ann", "blue sky (feat. Bob)"), ("c", "ANN", "Blue  Sky [x]"), ("d", "bob", "sky"), (None, "Bob", "SKY"),
        ("twice", "ann", "sky"), ("twice", "bob", "sky"), ("again", "bob", "sky"), ("again", "bob", "sky"), ("e", "", "sky"), ("f", "ann", None), ("g", "eve", "sky"),
    ], "request string, artist_query string, title_query string")
    asked, members = match.alike(asks)
    assert asked.count() == 7 and members.count() == 8  # three readings, and two requests with two rows each
    every = catalog.candidate_score_order(match.title_contains_join(asks, rows), ["request", "track_key"])
    once = match.for_members(catalog.candidate_score_order(match.title_contains_join(asked, rows), ["request", "track_key"]), members)
    assert as_rows(once) == as_rows(every) and every.where("request = 'twice'").count() > 20
    codes = F.array("isrc", F.lit(""))
    every, once = (catalog.first_k_distinct_codes(catalog.candidate_score_order(match.title_contains_join(a, rows), ["request", "isrc"]).withColumn("codes", codes), 3)
                   for a in (asks, asked))
    assert as_rows(match.for_members(once, members)) == as_rows(every)


CATALOG = ("track_key string, artist_name string, title string, popularity int, album_title string, album_type string, album_popularity int, "
           "album_year string, isrc string")


def variants_of(spark):
    titles = ["Blue Sky", "Blue Sky (Live)", "Blue Sky - Remix", "Blue Sky (feat. Ann)", "BLUE  SKY", "Night [Demo]", None]
    albums = [("Best of Ann", "Compilation"), ("Sky", "Album"), ("Live at Reading", "Album"), (None, None)]
    rows = [(f"k{i % 190:03}", ("Ann", "Bob", None)[i % 3], titles[i % 7], (None, 1, 2, 3)[i % 4], *albums[i % 11 % 4], i % 2, ("1990", "x", None)[i % 5 % 3], f"C{i}")
            for i in range(200)]
    asks = [(f"{a} | {t}", a, t) for a in ("Ann", "Bob", None) for t in titles] + [
        ("twice", "Ann", "Blue Sky"), ("twice", "Bob", "Blue Sky"), ("again", "Bob", "night"), ("again", "Bob", "night"), (None, "Ann", "Blue Sky (Live)")]
    return spark.createDataFrame(rows, CATALOG), spark.createDataFrame(asks, "request string, artist_name string, title_query string")


def test_requests_in_one_row_need_no_second_choice_of_variants(spark):
    frame, asks = variants_of(spark)
    every, best = catalog.variant_candidates(asks, frame), catalog.variant_candidates(asks, frame, catalog.best_copies)
    assert as_rows(catalog.variant_representative(best)) == as_rows(catalog.variant_representative(every))
    single = asks.where("request NOT IN ('twice', 'again')")
    chosen = catalog.variant_representative(catalog.variant_candidates(single, frame, catalog.best_copies))
    assert plan(chosen).count("WindowGroupLimit") == 1 and as_rows(chosen) == as_rows(catalog.variant_representative(catalog.variant_candidates(single, frame)))


def test_requests_of_one_base_title_share_a_menu(spark):
    frame, asks = variants_of(spark)
    every = catalog.menu_best_version(catalog.variant_candidates(asks, frame), ["request", "track_key"])
    asked, members = catalog.asked_alike(asks)
    assert asked.count() == 8 and members.count() == 15  # two artists and base titles each, and two requests with two rows each
    once = catalog.menu_best_version(catalog.variant_candidates(asked, frame, catalog.popular_copies), ["request", "track_key"])
    assert as_rows(match.for_members(once, members)) == as_rows(every) and every.where("request = 'twice'").count() > 2


def test_variants_are_thinned_by_numbers(spark):
    frame, _ = variants_of(spark)
    seen = []
    rows = catalog.judged(frame, lambda r: seen.extend(r.columns) or catalog.best_copies(r))
    assert {"_variant", "_menu", "_named"} <= set(seen) and not {"title", "normalized_title", "album_title"} & set(seen)
    assert {"title", "normalized_title", "album_title", "canonicality_tags"} <= set(rows.columns)


def joined(v):
    albums = v.albums.select(
        "album_id", F.col("title").alias("album_title"), F.col("type").alias("album_type"),
        F.col("popularity").alias("album_popularity"), F.col("year").alias("album_year"))
    return v.album_tracks.join(albums, "album_id")


def test_catalog_reads_the_lines_once(spark, views):
    assert plan(views.catalog).count("Relation [l_orderkey") == 1
    assert as_rows(views.catalog) == as_rows(joined(views))
    stored = views.with_stored_catalog("track_key", "artist_name", "title", "popularity")
    assert "l_orderkey" not in plan(stored.requests) and as_rows(stored.requests) == as_rows(views.requests)


def test_catalog_of_lines_without_numbers(spark, views, tmp_path):
    for name in ("lineitem", "orders", "part", "supplier"):
        frame = getattr(views, name)
        if name == "lineitem":
            none = F.when(F.col("l_orderkey") % 5 != 0, F.col("l_linenumber"))
            price = F.when(F.col("l_orderkey") % 5 == 0, (F.col("l_suppkey") / 100)).when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice"))
            frame = frame.withColumns({"l_linenumber": none, "l_extendedprice": price}).union(frame.limit(50))
        if name == "part":
            frame = frame.union(frame.limit(20).withColumn("p_brand", F.lit("Brand#0")))
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    v = Views(spark, tmp_path)
    assert v.odd_lines and as_rows(v.catalog) == as_rows(joined(v)) and v.catalog.count() > 0
    assert as_rows(v.with_stored_catalog("artist_name", "title").requests) == as_rows(v.requests)
