"""Album catalogs, track variants, canonical releases and the request resolver, for all artists in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegauge.functions.text import (
    digits_of, normalize_artist_name, normalize_basic_text, token_score, tokens, two_way_contains,
)
from tunegauge.functions.variants import (
    MATCH_RANK, TITLE_TERMS, TYPE_RANK, album_words, base_title, canonicality_of_words, full_title, has_album_penalty, has_words,
    is_non_studio, match_quality, rank_in, recording_score, track_type_of_words,
)
from tunegauge.operators.match import asked_once, best_contained, best_track, catalog_index, deep_scan_best
from tunegauge.operators.quantiles import same
from tunegauge.operators.ranking import rank_per_group, top_per_group
from tunegauge.session import written

# Release filters and preference of release kinds.
PRIMARY_TYPES = ["Album", "EP", "Single"]
BAD_SECONDARY = ["Compilation", "Live", "Mixtape/Street", "DJ-mix", "Broadcast", "Interview"]
ALBUM_TYPES = ["Album", "Single", "Compilation"]


def catalog_dedup(albums: DataFrame) -> DataFrame:
    """One album per artist and lower-case title: the most popular, then the first id; untitled albums go."""
    keyed = albums.where(F.trim(F.coalesce("title", F.lit(""))) != "").withColumn("_title", F.lower(F.trim("title")))
    return top_per_group(keyed, ["artist_id", "_title"], [F.col("popularity").desc(), "album_id"]).drop("_title")


def known(popularity: str) -> Column:
    """A missing popularity counts as 0."""
    return F.coalesce(F.col(popularity), F.lit(0))


def sortable_year(year: Column) -> Column:
    return F.when(year.rlike("^[0-9]+$"), year).otherwise("0000")


def catalog_order(albums: DataFrame) -> DataFrame:
    """Position of each album in its artist's catalog, newest first; unknown years last."""
    year = sortable_year(F.col("year")).cast("int")
    order = [-year, -known("popularity"), "album_id"]
    return rank_per_group(albums, ["artist_id"], order, "position")


def type_distribution(albums: DataFrame) -> DataFrame:
    """Albums per type as one row per artist; types outside the list count as unknown, absent types as 0."""
    known = F.col("type").isin(ALBUM_TYPES)
    return albums.groupBy("artist_id").agg(
        *[F.count_if(F.col("type") == t).alias(t.lower()) for t in ALBUM_TYPES],
        F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown"),
    )


def best_album_per_year(albums: DataFrame) -> DataFrame:
    dated = albums.where(F.col("year") != "0000")
    return top_per_group(dated, ["artist_id", "year"], [F.col("popularity").desc(), "album_id"])


def first_track(tracks: DataFrame) -> DataFrame:
    """(album_id, track_key): lowest track number, then the first key; partial minimum before the shuffle."""
    return tracks.groupBy("album_id").agg(F.min(F.struct("track_number", "track_key")).alias("t")).select(
        "album_id", "t.track_key", "t.track_number")


def artist_evolution(albums: DataFrame, tracks: DataFrame, audio: DataFrame) -> DataFrame:
    """Sound of every artist by year: first track of the most popular album of each year.

    ``audio`` has (track_key, energy, acousticness, valence, danceability).
    """
    chosen = best_album_per_year(albums).select("artist_id", "album_id", "year", F.col("title").alias("key_album"))
    # only tracks of chosen albums are read into the minimum
    opening = first_track(tracks.join(chosen.select("album_id"), "album_id", "left_semi"))
    return chosen.join(opening, "album_id").join(audio, "track_key").select(
        "artist_id", F.col("year").cast("int").alias("year"), "key_album",
        *[F.col(c).alias(f"avg_{c}") for c in ("energy", "acousticness", "valence", "danceability")],
    )


def _numbered(frame: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The different values of some columns, as _b0.., with a number each; stored, so that the numbers stay."""
    different = frame.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(columns)]).distinct()
    return written(different.withColumn(name, F.monotonically_increasing_id()), name.strip("_"))


def judged(catalog: DataFrame, thin: Callable[[DataFrame], DataFrame] | None = None, stored: bool = False) -> DataFrame:
    """The tracks of a catalog with the words, variant and album standing of each, before anything is asked.

    Titles and albums repeat, so all text work is done once per different title and once per different (album title, type). ``thin``
    sees numbers for texts: ``_variant`` for (base title, normalised title), ``_menu`` for (base title, basic title), ``_named`` for the
    album's title; the texts are joined to the rows that it keeps. ``stored`` tells that the catalog is a table already.
    """
    catalog = catalog if stored else written(catalog, "variant-catalog")
    titles = catalog.select("title").distinct().select(
        "title", full_title("title").alias("normalized_title"), base_title("title").alias("variant_group_key"),
        normalize_basic_text("title").alias("basic_title"))
    own = track_type_of_words(F.col("normalized_title"), F.lit(""))
    titles = written(titles.withColumns({
        "is_featured_variant": has_words(F.col("normalized_title"), TITLE_TERMS["featured"]), "_own": own,
        "_title": F.monotonically_increasing_id()}), "variant-titles")
    for columns, name in ((["variant_group_key", "normalized_title"], "_variant"), (["variant_group_key", "basic_title"], "_menu")):
        titles = titles.join(_numbered(titles, columns, name), same(columns)).drop("_b0", "_b1")
    titles = written(titles, "numbered-titles")
    albums = catalog.select("album_title", "album_type").distinct().withColumn("_words", album_words("album_title"))
    albums = albums.select(
        "album_title", "album_type", track_type_of_words(F.lit(""), F.col("_words")).alias("_context"),
        canonicality_of_words(F.col("_words"), "album_type").alias("_canon"), F.monotonically_increasing_id().alias("_album"))
    albums = written(albums, "variant-albums")
    albums = albums.join(_numbered(albums, ["album_title"], "_named"), same(["album_title"])).drop("_b0")
    albums = written(albums, "numbered-albums")
    year = F.when(F.col("album_year").rlike("^[0-9]+$"), F.col("album_year")).try_cast("int")
    rows = catalog.join(
        titles.select(F.col("title").alias("_b0"), "_title", "_variant", "_menu", "_own"), same(["title"])).drop("_b0")
    rows = rows.join(
        albums.select(F.col("album_title").alias("_b0"), F.col("album_type").alias("_b1"), "_album", "_named", "_context", "_canon.canonicality_score"),
        same(["album_title", "album_type"])).drop("_b0", "_b1")
    kind = F.when(F.col("_own.source") == "default", F.col("_context")).otherwise(F.col("_own"))  # the title decides first
    rows = rows.withColumns({
        "track_type": kind["track_type"], "track_type_source": kind["source"], "year": F.coalesce(year, F.lit(0)),
    }).drop("_own", "_context", "album_year", "title", "album_title", "album_type")
    rows = thin(rows) if thin else rows
    words = ["variant_group_key", "normalized_title", "is_featured_variant"]
    if "_title" not in rows.columns:  # only the variants are left
        return rows.join(titles.select("_variant", *words).distinct(), "_variant").drop("_variant")
    canon = [F.col(f"_canon.{c}").alias(c) for c in ("canonicality_tags", "is_editorial_context")]
    return rows.join(titles.select("_title", "title", *words, "basic_title"), "_title").join(
        albums.select("_album", "album_title", "album_type", *canon), "_album").drop("_title", "_variant", "_menu", "_album", "_named")


#: What a request tells apart among the tracks of an artist and base title: rows equal in these match it equally well.
MATCHED_BY = ["artist_name", "_variant", "track_type", "track_type_source"]


def best_copies(rows: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` best of the judged rows that any request matches equally well: no others are among the ``k`` best of a variant or request.

    A title that names no type of its own leaves it to the album, so a variant and type have one source: one row is the only one
    of its variant, which column ``_sole`` tells.
    """
    best = top_per_group(rows, MATCHED_BY, copy_order(), k)
    return best.withColumn("_sole", F.lit(True)) if k == 1 else best


def popular_copies(rows: DataFrame) -> DataFrame:
    """The most popular judged row of each base title, normalised title and album of an artist: the only one that a menu shows."""
    best = top_per_group(rows, ["artist_name", "_menu", "_named"], [F.col("popularity").desc(), "track_key"])
    return best.withColumn("_sole", F.lit(True))


def counted_copies(rows: DataFrame) -> DataFrame:
    """One row, with their number ``copies``, for the judged rows that any request matches equally well."""
    return rows.groupBy(*MATCHED_BY).agg(F.count(F.lit(1)).alias("copies"))


def asked_alike(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``match.alike`` for menus, which requests of one artist and base title share: (asked, members)."""
    requests = written(requests.select("request", "artist_name", "title_query"), "menu-requests")
    titles = written(requests.select("title_query").distinct(), "asked-titles").select(
        F.col("title_query").alias("_b0"), base_title("title_query").alias("variant_group_key"))
    rows = requests.where("artist_name IS NOT NULL").join(titles.where("variant_group_key <> ''"), same(["title_query"])).drop("_b0")
    return asked_once(requests, rows, ["artist_name", "variant_group_key"], ["artist_name", "title_query"])


def variant_candidates(
    requests: DataFrame, catalog: DataFrame, thin: Callable[[DataFrame], DataFrame] | None = None, stored: bool = False
) -> DataFrame:
    """Tracks with the base title of a request, classified and scored in their album's context.

    ``requests``: (request, artist_name, title_query); ``catalog``: one row per album track with (artist_name,
    track_key, title, popularity, album_title, album_type, album_popularity, album_year), ``stored`` if it is a table already.
    ``thin`` reduces the judged catalog to what can matter to the asker, such as ``best_copies``, before requests multiply it.
    A column ``_alone`` then tells rows that are the only one of their variant for their request.
    """
    rows = judged(catalog, thin, stored)
    requests = written(requests, "variant-requests")
    # stored, as the condition would otherwise be tested, with all its text work, on every row before titles become distinct
    asked_titles = written(requests.select("title_query").distinct(), "asked-titles").select(
        F.col("title_query").alias("_b0"), full_title("title_query").alias("_asked"), base_title("title_query").alias("variant_group_key"))
    asked_titles = asked_titles.where("variant_group_key <> ''").withColumn("_asked_featured", has_words(F.col("_asked"), TITLE_TERMS["featured"]))
    asked = requests.join(asked_titles, same(["title_query"])).drop("_b0")
    quality = match_quality(
        F.col("normalized_title"), F.col("_asked"), F.col("is_featured_variant"), F.col("_asked_featured"),
        F.col("track_type"), F.col("track_type_source"))
    alone = None
    if "_sole" in rows.columns:
        rows, alone = rows.drop("_sole"), F.lit(True)
        several = requests.groupBy("request").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        several = written(several.select(F.col("request").alias("_b0"), F.lit(True).alias("_several")), "several")
        if not several.isEmpty():
            asked, alone = asked.join(several, same(["request"]), "left").drop("_b0"), F.col("_several").isNull()
    found = asked.join(rows, ["artist_name", "variant_group_key"]).withColumn("match_quality", quality)
    found = found if alone is None else found.withColumn("_alone", alone)
    return found.drop("_asked", "_asked_featured", "_several")


def _first_of(candidates: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first candidate of each group; rows known to be the only one of theirs are not shuffled for it."""
    if "_alone" not in candidates.columns:
        return top_per_group(candidates, keys, order)
    alone, others = (candidates.where(c).drop("_alone") for c in ("_alone", "NOT _alone"))
    return alone.union(top_per_group(others, keys, order))


def copy_order(unknown_year: int = 9999) -> list:
    """Best copy first among the tracks that a request matches equally well."""
    return [
        -F.col("canonicality_score"), -known("popularity"), -known("album_popularity"),
        F.when(F.col("year") > 0, F.col("year")).otherwise(unknown_year), "track_key",
    ]


def variant_order(unknown_year: int = 9999) -> list:
    """Best variant first, as ascending expressions that end in a unique key."""
    return [rank_in(F.col("match_quality"), MATCH_RANK), rank_in(F.col("track_type"), TYPE_RANK), *copy_order(unknown_year)]


def variant_representative(candidates: DataFrame) -> DataFrame:
    """One row per variant of a request: copies on compilations and reissues collapse into the best one."""
    keys = ["request", "variant_group_key", "track_type", "is_featured_variant", "normalized_title"]
    return _first_of(candidates, keys, variant_order())


def variant_ranking(candidates: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rank of each variant within its request, with the columns ``keep``, all by default."""
    return rank_per_group(variant_representative(candidates), ["request"], variant_order(), "rank", keep)


def menu_best_version(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Most popular version per (request, normalised title, album), ranked by popularity within the request."""
    keyed = rows.withColumn("_title", F.col("basic_title") if "basic_title" in rows.columns else normalize_basic_text("title"))
    best = _first_of(keyed, ["request", "_title", "album_title"], [F.col("popularity").desc(), "track_key"])
    return rank_per_group(
        best.drop("_title"), ["request"], [-known("popularity"), "track_key"], "position", keep)


def menu_projection(variants: DataFrame) -> DataFrame:
    """Variants in the shape of the curator menu."""
    return variants.select(
        "request", F.col("track_key").alias("id"), "title", F.coalesce("popularity", F.lit(0)).alias("popularity"),
        F.coalesce("album_title", F.lit("Unknown Album")).alias("album"),
        F.when(F.col("year") > 0, F.col("year").cast("string")).otherwise("????").alias("year"),
        F.coalesce("isrc", F.lit("")).alias("isrc"), F.coalesce("track_type", F.lit("other")).alias("track_type"),
        F.coalesce("track_type_source", F.lit("unknown")).alias("track_type_source"),
        F.coalesce("match_quality", F.lit("base_variant")).alias("match_quality"),
        F.coalesce("canonicality_score", F.lit(0)).alias("canonicality_score"), "canonicality_tags",
    )


def catalog_rescue(candidates: DataFrame, resolvable: DataFrame) -> DataFrame:
    """First of the three best candidates per request that can be resolved (is in ``resolvable``)."""
    top = rank_top(candidates, 3)
    return top_per_group(
        top.join(resolvable.select("track_key").distinct(), "track_key", "left_semi"), ["request"], ["_rank"]
    ).withColumnRenamed("_rank", "rank")


def rank_top(candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` best candidates per request with their rank; at most ``k`` rows per request and task are shuffled."""
    from pyspark.sql import Window

    window = Window.partitionBy("request").orderBy(*variant_order())
    return candidates.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k)


def best_release(df: DataFrame, keep: list[str], recordings: str = "recordings") -> DataFrame:
    """The canonical release out of a nested lookup answer, per row and without a shuffle.

    Official releases of allowed kinds with a date come first by (year, kind, date); without any, the very first
    release of the first recording is taken. A row without releases has found = false.
    """
    rows = F.flatten(F.transform(recordings, lambda r: r["releases"]))
    allowed = F.array(*[F.lit(t) for t in PRIMARY_TYPES])
    bad = F.array(*[F.lit(t) for t in BAD_SECONDARY])
    good = F.filter(rows, lambda r: (
        (r["status"] == "Official") & F.array_contains(allowed, r["type"]) & (F.length(r["date"]) >= 4)
        & ~F.coalesce(F.arrays_overlap(r["secondary_types"], bad), F.lit(False))))
    ordered = F.transform(good, lambda r, i: F.struct(
        F.substring(r["date"], 1, 4).alias("y"), F.array_position(allowed, r["type"]).alias("k"),
        r["date"].alias("d"), i.alias("i"), r.alias("r")))
    fallback = F.get(F.get(F.col(recordings), F.lit(0))["releases"], F.lit(0))
    release = F.coalesce(F.array_min(ordered)["r"], fallback)
    df = df.withColumn("_r", release)
    kind = F.when(F.array_contains(F.col("_r.secondary_types"), "Compilation"), "Compilation").otherwise(
        F.coalesce("_r.type", F.lit("unknown")))
    found = F.col("_r").isNotNull()
    return df.select(
        *keep, found.alias("found"), F.when(found, F.col("_r.title")).alias("release_title"),
        F.when(found, F.coalesce("_r.date", F.lit("unknown"))).alias("release_date"),
        F.when(found, kind).alias("release_type"), digits_of("_r.track_number").alias("track_number"),
        F.col("_r.track_count").alias("track_count"),
    )


def best_album_penalised(albums: DataFrame, by: list[str]) -> DataFrame:
    """Best album per group: names of compilations and live records rank last, then popularity, then position."""
    order = [F.when(has_album_penalty("title"), 1).otherwise(0), F.col("popularity").desc(), "album_id"]
    return top_per_group(albums, by, order)


def best_artist_in_track(tracks: DataFrame) -> DataFrame:
    """Best matching artist of each track for the asked name: score, then primary, solo, order of names.

    ``tracks``: (request, artist_query, track_key, artists ARRAY<STRING>, popularity). Names and credits repeat, so each
    different (artist_query, artists) is matched once.
    """
    tracks = written(tracks.select("request", "artist_query", "track_key", "artists", "popularity"), "credited-tracks")
    pairs = written(tracks.select("artist_query", "artists").distinct(), "credits")
    named = pairs.withColumns({
        "_q": normalize_artist_name("artist_query"),
        "_names": F.transform("artists", lambda a: F.struct(a.alias("artist"), normalize_artist_name(a).alias("c"))),
    })
    worded = named.withColumns({
        "_qt": tokens("_q"),
        "_names": F.transform("_names", lambda n: F.struct(n["artist"].alias("artist"), n["c"].alias("c"),
                                                           tokens(n["c"]).alias("ct"))),
    })
    solo = (F.size("artists") == 1).cast("int")
    options = F.transform("_names", lambda n, i: F.struct(
        token_score(F.col("_q"), n["c"], F.col("_qt"), n["ct"]).alias("score"), (i == 0).cast("int").alias("is_primary"),
        solo.alias("is_solo"), (-i).alias("o"), n["artist"].alias("artist")))
    found = written(worded.select(F.col("artist_query").alias("_b0"), F.col("artists").alias("_b1"), F.array_max(options).alias("_b")), "matched-credits")
    best = tracks.join(found.where("_b IS NOT NULL"), same(["artist_query", "artists"]))
    return best.select(
        "request", "track_key", "_b.score", "_b.is_primary", "_b.is_solo", known("popularity").alias("popularity"), "_b.artist")


def best_artist(track_bests: DataFrame, min_score: int = 80) -> DataFrame:
    """Best artist per request over its tracks; requests below ``min_score`` stay unresolved."""
    key = F.struct(-F.col("score"), -F.col("is_primary"), -F.col("is_solo"), -known("popularity"), "track_key", "artist")
    return track_bests.groupBy("request").agg(F.min(F.struct(key.alias("k"), "score", "artist", "track_key")).alias("b")).select(
        "request", "b.artist", "b.score", "b.track_key").where(F.col("score") >= min_score)


def first_k_distinct_codes(candidates: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` distinct codes per request, by the position of the candidate and of the code in it."""
    codes = candidates.select("request", "position", F.posexplode("codes").alias("i", "code")).where("code <> ''")
    first = codes.groupBy("request", "code").agg(F.min(F.struct("position", "i")).alias("at"))
    return top_per_group(first, ["request"], ["at", "code"], k).select(
        "request", "code", F.col("at.position").alias("position"))


def candidate_scores(hits: DataFrame) -> DataFrame:
    """Score of each accepted recording: text score, live penalty, releases."""
    score = recording_score(
        F.col("text_score"), F.col("title"), F.col("disambiguation"), F.col("q_title"), F.col("release_count"))
    return hits.withColumn("score", score)


def best_scored(rows: DataFrame, k: int) -> DataFrame:
    """The tracks that can be among the ``k`` best hits of a request.

    A request sets the scores of live and of other recordings of one title and artist apart by one amount at most, so their
    order within each of the two is the same for all requests.
    """
    live = F.lower(F.coalesce(F.col("disambiguation"), F.lit(""))).contains("live")
    order = [-(F.coalesce("text_score", F.lit(0)) + F.coalesce("release_count", F.lit(0)) * 10), "track_key"]
    return top_per_group(rows.withColumn("_live", live), ["title", "artist_name", "_live"], order, k).drop("_live")


def candidate_score_order(hits: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Position of each hit within its request, best score first, with the columns ``keep``, all by default."""
    return rank_per_group(
        candidate_scores(hits), ["request"], [-F.col("score"), "track_key"], "position", keep)


def prioritise_context(albums: DataFrame, context: str = "context") -> DataFrame:
    """Albums that match a context title first, the rest after; the catalog order is kept within both."""
    hit = two_way_contains(normalize_basic_text("title"), normalize_basic_text(context))
    flagged = albums.withColumn("matches_context", hit)
    order = [F.when(F.col("matches_context"), 0).otherwise(1), "position"]
    return rank_per_group(flagged, ["artist_id"], order, "scan_position")


def canonical_track_choice(hits: DataFrame) -> DataFrame:
    """Most popular candidate; studio titles first unless the request names a variant or an album."""
    asks_variant = is_non_studio("q_title") | F.coalesce(F.col("album_given"), F.lit(False))
    penalty = F.when(~asks_variant & is_non_studio("title"), 1).otherwise(0)
    return top_per_group(hits, ["request"], [penalty, F.col("popularity").desc(), "track_key"])


def known_year(date: str) -> Column:
    return F.when(F.substring(date, 1, 4).rlike("^[0-9]{4}$"), F.substring(date, 1, 4).cast("int"))


def oldest_rows(rows: DataFrame, date: str = "release_date") -> DataFrame:
    """The track with the least known year of each title and artist, any track if none is known."""
    return top_per_group(rows, ["title", "artist_name"], [known_year(date).asc_nulls_last(), "track_key"])


def oldest_release_year(hits: DataFrame, date: str = "release_date") -> DataFrame:
    year = known_year(date)
    return hits.groupBy("request").agg(F.min(year).alias("oldest_year"))


def resolve_requests(requests: DataFrame, catalog: DataFrame, artists: DataFrame) -> DataFrame:
    """(request, tier, track_key, title): the decision list of the resolver over a table of requests.

    Tier 1: a catalog track whose title and artist match as text. Tier 2: a track of the named artist whose title
    contains the asked title or lies inside it. Tier 3: only the artist is known. Tier 4: nothing matches.
    """
    # both tiers read the requests and, of the catalog, the best track of each title and artist: no other can win
    requests = written(requests, "resolver-requests")
    index = catalog_index(catalog, best=best_track())
    best = index.stored.select("artist_name", "title", "best.track_key", (-F.col("best.p")).alias("popularity"))
    direct = best_contained(requests, index).select("request", F.col("track_key").alias("t1"), F.lit(True).alias("_direct"))
    asked = written(requests.select("request", "artist_name", "title_query").join(direct, "request", "left"), "direct")
    rest = asked.where("_direct IS NULL").drop("t1")
    scan = deep_scan_best(rest, best).select("request", F.col("track_key").alias("t2"))
    found = asked.where("_direct").select("request", "artist_name", "t1", F.lit(None).cast(scan.schema["t2"].dataType).alias("t2"))
    left = rest.join(scan, "request", "left").select("request", "artist_name", F.lit(None).cast(scan.schema["t2"].dataType).alias("t1"), "t2")
    named = artists.select("artist_name").distinct().withColumn("_known", F.lit(True))
    joined = found.union(left).join(named, "artist_name", "left")
    tier = F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(F.col("_known"), 3).otherwise(4)
    return joined.select("request", tier.alias("tier"), F.coalesce("t1", "t2").alias("track_key"))
