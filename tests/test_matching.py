"""Matching joins against brute force on small frames, hot groups against one plain window."""

import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from test_text import python_basic
from tunegauge.operators import catalog, match
from tunegauge.operators.ranking import rank_per_group, top_per_group

NEEDLES = ["a", "ab", "love", "the love", "zz", "", "b c", "ção", "love me do"]
HAYS = ["love me do", "the lovely one", "abba", "canção", "ab c", "", "zebra", "b c d", "all you need is love"]


def test_containment_pairs(spark):
    got = match.containment_pairs(
        spark.createDataFrame([(n,) for n in NEEDLES], "needle string"),
        spark.createDataFrame([(h,) for h in HAYS], "hay string"))
    wanted = {(n, h) for n, h in itertools.product(NEEDLES, HAYS) if n and n in h}
    assert {(r["needle"], r["hay"]) for r in got.collect()} == wanted


@pytest.fixture(scope="module")
def music(spark):
    rng = random.Random(7)
    words = ["love", "me", "do", "blue", "sky", "a", "night", "live"]
    artists = ["The Beat Les", "Les Amis", "Beatrix", "A Ha", "Sky Night"]
    rows = [
        (f"k{i:03d}", rng.choice(artists), " ".join(rng.sample(words, rng.randint(1, 3))) + rng.choice(["", " (Live)", " - Remix"]),
         rng.randint(0, 5)) for i in range(120)]
    asks = [(f"r{i:02d}", rng.choice(["beat", "les", "Sky", "ha a", "the", "none", "Beat Sky"]), " ".join(rng.sample(words, rng.randint(1, 2))))
            for i in range(40)]
    catalog_rows = spark.createDataFrame(rows, "track_key string, artist_name string, title string, popularity int")
    requests = spark.createDataFrame(asks, "request string, artist_query string, title_query string")
    return rows, asks, catalog_rows, requests


def accepted(rows, asks):
    for (key, artist, title, pop), (request, artist_query, title_query) in itertools.product(rows, asks):
        t, a = python_basic(title_query), python_basic(artist_query)
        if t in python_basic(title) and any(w in python_basic(artist) for w in a.split()):
            yield request, key, title, pop, t


def test_title_contains_join(music):
    rows, asks, catalog_rows, requests = music
    got = match.title_contains_join(requests, catalog_rows).select("request", "track_key").collect()
    wanted = sorted((r, k) for r, k, *_ in accepted(rows, asks))
    assert sorted((r["request"], r["track_key"]) for r in got) == wanted and wanted


def test_best_contained_equals_choice_over_all_hits(music):
    _, _, catalog_rows, requests = music
    hits = match.title_contains_join(requests, catalog_rows).withColumn("album_given", F.lit(False))
    slow = {(r["request"], r["track_key"]) for r in catalog.canonical_track_choice(hits).collect()}
    fast = {(r["request"], r["track_key"]) for r in match.best_contained(requests, catalog_rows).collect()}
    assert fast == slow and fast


def test_requests_that_name_an_album_take_any_variant(music):
    _, asks, catalog_rows, requests = music
    given = requests.withColumn("album_given", F.when(F.col("request") < "r20", F.col("request") < "r10"))
    hits = match.title_contains_join(given, catalog_rows).join(given.select("request", "album_given"), "request")
    slow = {(r["request"], r["track_key"]) for r in catalog.canonical_track_choice(hits).collect()}
    index = match.catalog_index(catalog_rows)
    fast = {(r["request"], r["track_key"]) for r in match.best_contained(given, index).collect()}
    plain = {(r["request"], r["track_key"]) for r in match.best_contained(requests, index).collect()}
    assert fast == slow and fast != plain and {x for x in fast if x[0] >= "r10"} == {x for x in plain if x[0] >= "r10"}


def test_oldest_contained(music):
    rows, asks, catalog_rows, requests = music
    years = {k: (None if i % 5 == 0 else 1950 + i * 7 % 60) for i, (k, *_) in enumerate(rows)}
    known = catalog_rows.withColumn("year", F.when(F.substring("track_key", 2, 3).cast("int") % 5 != 0, 1950 + F.substring("track_key", 2, 3).cast("int") * 7 % 60))
    wanted = {}
    for request, key, *_ in accepted(rows, asks):
        wanted[request] = min((y for y in (wanted.get(request), years[key]) if y is not None), default=None)
    assert {r["request"]: r["oldest_year"] for r in match.oldest_contained(requests, known).collect()} == wanted


def test_inner_texts(spark):
    got = match.inner_texts(spark.createDataFrame([(h,) for h in HAYS], "hay string"), spark.createDataFrame([(n,) for n in NEEDLES], "needle string"))
    assert {(r["needle"], r["hay"]) for r in got.collect()} == {(n, h) for n, h in itertools.product(NEEDLES, HAYS) if n and n in h}


def test_deep_scan_in_both_directions_and_ways(spark):
    rng = random.Random(11)
    words = ["love", "me", "do", "sky", "a", "live", "ox"]
    title = lambda: " ".join(rng.choices(words, k=rng.randint(1, 4)))
    rows = [(f"k{i:04}", rng.choice(["Hot", "Hot", "Ann", "Bob", "Cy"]), title(), rng.choice([None, 0, 1, 2, 3])) for i in range(300)]
    asks = [(f"r{i:03}", rng.choice(["Hot", "Ann", "Bob", "Cy", "None", None]), rng.choice([title(), title(), "a", "ox", "", None])) for i in range(120)]
    frame = spark.createDataFrame(rows, "track_key string, artist_name string, title string, popularity int")
    wanted = {}
    for r, artist, t in asks:
        found = [(-(p or 0), k) for k, own, title_, p in rows if own == artist and t and (t.lower() in title_ or title_ in t.lower())]
        if found:
            wanted[r] = (min(found)[1], -min(found)[0])
    got = match.deep_scan_best(spark.createDataFrame(asks, "request string, artist_name string, title_query string"), frame).collect()
    assert {r["request"]: (r["track_key"], r["popularity"]) for r in got} == wanted


def python_score(query, candidate):
    q, c = query.lower(), candidate.lower()
    if q == c:
        return 100
    a, b = set(q.split()), set(c.split())
    if a == b:
        return 95
    return 80 if a <= b else int(len(a & b) / len(a) * 60)


@pytest.mark.parametrize("min_score", [95, 80, 40, 20, 1])
def test_token_overlap_join(spark, min_score):
    rng = random.Random(3)
    words = ["the", "the", "a", "beat", "les", "sky", "night", "blue"]
    mentions = sorted({" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(60)})
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(60)})
    got = match.token_overlap_join(
        spark.createDataFrame([(m,) for m in mentions], "mention string"),
        spark.createDataFrame([(n,) for n in names], "name string"), min_score)
    wanted = {(m, n, python_score(m, n)) for m in mentions for n in names if python_score(m, n) >= min_score}
    assert {(r["mention"], r["name"], r["score"]) for r in got.collect()} == wanted


def test_rank_of_hot_groups(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        (F.xxhash64("id") % 17).alias("score"), "id")
    got = rank_per_group(rows, ["g"], [-F.col("score"), F.col("id")], "rank")
    window = Window.partitionBy("g").orderBy(-F.col("score"), F.col("id"))
    wanted = rows.withColumn("rank", F.row_number().over(window))
    assert got.count() == 3000 and got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()


def test_top_per_group_limits_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 5).alias("g"), "id")
    top = top_per_group(rows, ["g"], ["id"], 2)
    assert top.count() == 10
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_best_release_rules(spark):
    kinds = "array<struct<releases:array<struct<title:string,date:string,status:string,type:string,secondary_types:array<string>,track_number:string,track_count:int>>>>"
    official = ("b", "1999-05-01", "Official", "Album", [], "A12", 10)
    rows = [
        (1, [([("a", "1999", "Official", "Single", [], "3", 2), official],)]),
        (2, [([("c", "", "Bootleg", "Album", ["Live"], "x", 1)],)]),
        (3, [([("d", "1990", "Official", "Album", ["Live"], "1", 1), ("e", "2001", "Official", "EP", [], "2", 4)],)]),
        (4, []),
        (5, [([("f", "1980", "Official", "Album", ["Compilation"], "1", 9)],)]),
    ]
    frame = spark.createDataFrame(rows, f"id int, recordings {kinds}")
    got = {r["id"]: r for r in catalog.best_release(frame, ["id"]).collect()}
    assert got[1]["release_title"] == "b" and got[1]["track_number"] == 12
    assert got[2]["release_title"] == "c" and got[2]["track_number"] is None
    assert got[3]["release_title"] == "e" and got[4]["found"] is False
    assert got[5]["release_type"] == "Compilation"


def test_missing_popularity_never_wins(spark):
    rows = spark.createDataFrame(
        [("k1", "Ann", "Song", None), ("k2", "Ann", "Song", 3)], "track_key string, artist_name string, title string, popularity int")
    asks = spark.createDataFrame([("r", "Ann", "ann", "song")], "request string, artist_name string, artist_query string, title_query string")
    assert match.best_contained(asks.drop("artist_name"), rows).first()["track_key"] == "k2"
    assert match.deep_scan_best(asks.drop("artist_query"), rows).first()["track_key"] == "k2"


@pytest.fixture(scope="module")
def copies(spark):
    """Many copies of few titles on albums of several kinds, with ties, missing popularity and rows that come twice."""
    rng = random.Random(5)
    titles = ["Blue Sky", "Blue Sky (Live)", "Blue Sky - Remix", "Blue Sky (feat. Ann)", "BLUE  SKY", "Night", "Night [Demo]", "(Live)", None]
    albums = [("Best of Ann", "Compilation"), ("Sky", "Album"), ("Live at Reading", "Album"), ("Sky Remixes", "Ep"), ("Sky", "Single"), (None, None)]
    rows = []
    for i in range(500):
        album, kind = rng.choice(albums)
        rows.append((f"k{i:03}", rng.choice(["Ann", "Ann", "Bob", None]), rng.choice(titles), rng.choice([None, 0, 1, 2, 3]), f"A{i % 9}",
                     album, kind, rng.choice([None, 0, 1]), rng.choice([None, "0000", "1990", "2001", "x"]), f"C{i % 7}"))
    rows += rng.sample(rows, 40)
    frame = spark.createDataFrame(rows, "track_key string, artist_name string, title string, popularity int, album_id string, album_title string, "
                                        "album_type string, album_popularity int, album_year string, isrc string")
    asks = [(f"{a} | {t}", a, t) for a in ("Ann", "Bob", None, "Cy") for t in titles]
    return frame, spark.createDataFrame(asks, "request string, artist_name string, title_query string")


def as_rows(frame):
    return sorted(map(repr, frame.select(sorted(frame.columns)).collect()))


def test_thinned_candidates_give_the_results_of_all_candidates(copies):
    frame, asks = copies
    every = catalog.variant_candidates(asks, frame)
    best, best3 = (catalog.variant_candidates(asks, frame, lambda rows, k=k: catalog.best_copies(rows, k)) for k in (1, 3))
    popular, counted = (catalog.variant_candidates(asks, frame, f) for f in (catalog.popular_copies, catalog.counted_copies))
    assert best.count() < every.count() / 3 and popular.count() < every.count() / 3
    wanted = as_rows(catalog.variant_ranking(every))
    assert as_rows(catalog.variant_ranking(best)) == wanted and wanted
    assert as_rows(catalog.menu_projection(catalog.variant_representative(best))) == as_rows(catalog.menu_projection(catalog.variant_representative(every)))
    assert as_rows(catalog.menu_best_version(popular)) == as_rows(catalog.menu_best_version(every))
    resolvable = frame.where("popularity > 2").select("track_key")
    assert as_rows(catalog.catalog_rescue(best3, resolvable)) == as_rows(catalog.catalog_rescue(every, resolvable))
    keys = ["match_quality", "track_type", "track_type_source"]
    assert as_rows(counted.groupBy(*keys).agg(F.sum("copies").alias("n"))) == as_rows(every.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))


def test_candidates_are_judged_by_title_then_album(copies):
    from tunegauge.functions.variants import album_canonicality, contextual_track_type

    rows = catalog.judged(copies[0])
    kind, canon = contextual_track_type("title", "album_title"), album_canonicality("album_title", "album_type")
    wrong = ~(F.struct("track_type", F.col("track_type_source").alias("source")).eqNullSafe(kind)
              & F.struct("canonicality_score", "canonicality_tags", "is_editorial_context").eqNullSafe(canon))
    assert rows.count() == copies[0].count() and rows.where(wrong).isEmpty()


def test_best_artist_in_track_row_by_row(spark):
    rng = random.Random(9)
    names = ["Ann", "Bob", "Ann Lee", "lee ann", "Éva", "", None]
    rows = [(rng.choice(["r1", "r2", None]), rng.choice(["ann", "Lee Ann", "eva", "", None]), f"k{i % 110:03}",
             rng.choice([None, [], [rng.choice(names) for _ in range(rng.randint(1, 3))]]), rng.choice([None, 0, 5])) for i in range(150)]
    frame = spark.createDataFrame(rows, "request string, artist_query string, track_key string, artists array<string>, popularity int")
    plain = {None: "", "Éva": "eva"}
    wanted = []
    for request, query, key, artists, popularity in rows:
        q = plain.get(query, (query or "").lower())
        options = []
        for i, a in enumerate(artists or []):
            c = plain.get(a, (a or "").lower())
            score = 0 if not q or not c else python_score(q, c)
            options.append((score, int(i == 0), int(len(artists) == 1), popularity or 0, -i, a))
        if options:
            best = max(options, key=lambda o: o[:5])
            wanted.append((request, key, *best[:4], best[5]))
    got = catalog.best_artist_in_track(frame).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted)) and wanted


def test_ascii_names_are_not_translated(spark):
    from tunegauge.functions.text import fold_accents, normalize_artist_name

    plan = spark.range(1).select(fold_accents(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN RLIKE" in plan and plan.index("RLIKE") < plan.index("translate")
    rows = spark.createDataFrame([("plain #1",), ("Súpplier ½ ﬁx",), ("",), (None,)], "name string")
    assert [r[0] for r in rows.select(normalize_artist_name("name")).collect()] == ["plain 1", "supplier 1 2 fix", "", ""]


def test_thinned_hits_give_the_results_of_all_hits(music, spark):
    rows, asks, catalog_rows, requests = music
    n = F.substring("track_key", 2, 3).cast("int")
    every = catalog_rows.unionByName(catalog_rows.where(n % 4 == 0)).withColumns({
        "text_score": F.when(n % 9 != 0, F.col("popularity") + 60), "disambiguation": F.when(n % 3 == 0, "LIVE in studio"),
        "release_count": F.when(n % 5 != 0, n % 6), "release_date": F.when(n % 7 != 0, F.concat((F.lit(1990) + n % 13).cast("string"), F.lit("-01")))})
    requests = requests.union(spark.createDataFrame([("r90", "Sky", "love live"), ("r91", "les", "live"), ("r92", "none", "x")], requests.schema))

    def best(found):
        return as_rows(top_per_group(catalog.candidate_scores(found), ["request"], [F.col("score").desc(), "track_key"], 3).select("request", "track_key", "score"))

    few = catalog.best_scored(every, 3)
    assert few.count() < every.count()
    wanted = best(match.title_contains_join(requests, every))
    assert best(match.title_contains_join(requests, few)) == wanted and wanted
    oldest = as_rows(catalog.oldest_release_year(match.title_contains_join(requests, every)))
    assert as_rows(catalog.oldest_release_year(match.title_contains_join(requests, catalog.oldest_rows(every)))) == oldest and oldest
    narrow = catalog.candidate_score_order(match.title_contains_join(requests, every), ["request", "track_key"])
    assert narrow.columns == ["request", "track_key", "position"]
