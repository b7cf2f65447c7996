"""Queries: text matching, track variants, album catalogs, canonical releases and the resolver."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunegauge.functions import text, variants
from tunegauge.operators import catalog, match
from tunegauge.operators.quantiles import same
from tunegauge.operators.ranking import top_per_group
from tunegauge.plans.featuring import BASIC, NAMES, CREDITS, SPLIT_NAMES, credits
from tunegauge.plans.registry import query
from tunegauge.session import written


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(trim({x})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def has(x: str, words: str) -> str:
    return rf"regexp_matches({x}, '\b(?:{words})\b')"


def base(x: str) -> str:
    """SQL for the base title of a title."""
    words = r"live|ao vivo|acoustic|acústico|unplugged|demo|rehearsal|remaster(?:ed)?|remix|mix|radio edit|edit|version|instrumental"
    out = f"lower(trim({x}))"
    for p in (r"\((?:feat|ft|featuring)\.?\s+[^)]*\)", r"\[(?:feat|ft|featuring)\.?\s+[^\]]*\]",
              r"\s+(?:feat|ft|featuring)\.?\s+.+$", rf"\([^)]*\b(?:{words})\b[^)]*\)",
              rf"\[[^\]]*\b(?:{words})\b[^\]]*\]", rf"\s*-\s*.*\b(?:{words})\b.*$"):
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    return norm(out)


ALBUM_LIVE = "live|ao vivo|broadcast|unplugged|reading|paramount|festival|concert"
TYPE_SQL = f"""CASE WHEN {has('n', 'live|ao vivo')} THEN 'live' WHEN {has('n', 'remix|mix')} THEN 'remix' WHEN {has('n', 'acoustic|unplugged')} THEN 'acoustic'
 WHEN {has('n', 'demo|rehearsal')} THEN 'demo' WHEN {has('n', 'instrumental')} THEN 'instrumental' WHEN {has('an', ALBUM_LIVE)} THEN 'live'
 WHEN {has('an', 'remix|remixes|mix')} THEN 'remix' WHEN {has('an', 'acoustic|unplugged')} THEN 'acoustic'
 WHEN {has('an', 'demo|rehearsal|outtake|boombox')} THEN 'demo' WHEN {has('an', 'instrumental')} THEN 'instrumental' ELSE 'studio' END"""
SOURCE_SQL = f"""CASE WHEN {has('n', 'live|ao vivo|remix|mix|acoustic|unplugged|demo|rehearsal|instrumental')} THEN 'track_title'
 WHEN {has('an', ALBUM_LIVE + '|remix|remixes|mix|acoustic|demo|rehearsal|outtake|boombox|instrumental')} THEN 'album_context' ELSE 'default' END"""
PENALTIES = [
    ("compilation_title", -140, "collection|greatest hits|best of|essential|icon|anthology|playlist"),
    ("regional_variant", -80, "international version"),
    ("live_context", -120, "live|broadcast|unplugged|reading|paramount|festival|concert"),
    ("remix_context", -70, "remix|remixes|mix"), ("demo_context", -90, "demo|rehearsal|outtake|boombox"),
    ("reissue_context", -20, "deluxe|super deluxe|anniversary"), ("remaster_context", -10, "remaster|remastered"),
]
CANON_SQL = "CASE lower(trim(album_type)) WHEN 'album' THEN 40 WHEN 'single' THEN 35 WHEN 'ep' THEN 30 WHEN 'compilation' THEN -120 ELSE 0 END" + "".join(
    f" + CASE WHEN {has('an', w)} THEN {p} ELSE 0 END" for _, p, w in PENALTIES)
TAGS_SQL = "list_filter([CASE WHEN lower(trim(album_type)) IN ('album', 'single', 'ep', 'compilation') THEN lower(trim(album_type)) ELSE 'unknown_type' END, " + ", ".join(
    f"CASE WHEN {has('an', w)} THEN '{t}' END" for t, _, w in PENALTIES) + "], lambda t: t IS NOT NULL)"

FULL_CATALOG = f"""
SELECT t.*, a.title AS album_title, a.type AS album_type, a.popularity AS album_popularity, a.year AS album_year,
 {norm('t.title')} AS n, {norm('a.title')} AS an, {base('t.title')} AS base FROM album_tracks t JOIN albums a ON t.album_id = a.album_id"""
VARIANTS = f"""
SELECT r.request, c.track_key, c.title, c.base AS variant_group_key, c.n AS normalized_title, c.popularity, c.album_popularity, c.album_title, c.isrc,
 CASE WHEN regexp_full_match(c.album_year, '[0-9]+') THEN CAST(c.album_year AS INT) ELSE 0 END AS year, {TYPE_SQL} AS track_type, {SOURCE_SQL} AS track_type_source,
 {CANON_SQL} AS canonicality_score, {has('n', 'feat|ft|featuring')} AS is_featured_variant, rn, {has('rn', 'feat|ft|featuring')} AS rf
FROM (SELECT *, {base('title_query')} AS base, {norm('title_query')} AS rn FROM requests) r JOIN full_catalog c ON r.artist_name = c.artist_name AND r.base = c.base WHERE r.base <> ''"""
RATED = """
SELECT *, CASE WHEN normalized_title = rn AND track_type <> 'studio' AND track_type_source = 'album_context' THEN 'base_variant'
 WHEN normalized_title = rn THEN 'exact' WHEN is_featured_variant <> rf THEN 'featured_variant' ELSE 'base_variant' END AS match_quality FROM variant_rows"""
ORDER = """CASE match_quality WHEN 'exact' THEN 0 WHEN 'featured_variant' THEN 1 ELSE 2 END, list_position(['studio', 'acoustic', 'live', 'demo', 'remix', 'instrumental'], track_type),
 canonicality_score DESC, popularity DESC, album_popularity DESC, CASE WHEN year > 0 THEN year ELSE 9999 END, track_key"""
REPS = f"""
SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY request, variant_group_key, track_type, is_featured_variant, normalized_title ORDER BY {ORDER}) = 1"""
HITS = f"""
SELECT r.request, r.q_title, c.* FROM (SELECT *, {BASIC.format('title_query')} AS q_title, {BASIC.format('artist_query')} AS q_artist FROM requests) r
JOIN (SELECT *, {BASIC.format('title')} AS c_title, {BASIC.format('artist_name')} AS c_artist FROM album_tracks) c
 ON c.artist_name = r.artist_name AND contains(c.c_title, r.q_title) AND contains(c.c_artist, r.q_artist) WHERE r.q_title <> ''"""
M = {"full_catalog": FULL_CATALOG, "variant_rows": VARIANTS, "rated": RATED, "reps": REPS, "hits": HITS}


def asked(v):
    return v.requests.select("request", "artist_name", "title_query")


def candidates(v, thin=catalog.best_copies, requests=None):
    return catalog.variant_candidates(asked(v) if requests is None else requests, v.catalog, thin, stored=True)


def catalogued(v):
    """Views over a stored catalog with the columns that candidates are made of."""
    return v.with_stored_catalog(
        "track_key", "artist_name", "title", "popularity", "isrc", "album_title", "album_type", "album_popularity", "album_year")


def hit_rows(v):
    return v.album_tracks.select("artist_name", "title", "track_key", "popularity", "isrc", "album_id", "track_number")


def hits(v, rows=None, asked=None):
    return match.title_contains_join(v.requests.drop("artist_name") if asked is None else asked, hit_rows(v) if rows is None else rows)


def asked_alike(v):
    return match.alike(v.requests.drop("artist_name"))


def named_tracks(v):
    """Views over stored tracks with the columns that requests and album tracks are made of."""
    return v.with_stored_tracks("row_key", "artist_name", "song_name", "song_popularity")


# ---- scalar text functions ---------------------------------------------------------------------------------------------

@query("variant_terms", f"""
SELECT song_name, {has('n', 'live|ao vivo')} AS live, {has('n', 'acoustic|unplugged')} AS acoustic, {has('n', 'demo|rehearsal')} AS demo,
 {has('n', 'remix|mix')} AS remix, {has('n', 'remaster|remastered')} AS remaster, {has('n', 'edit|radio edit')} AS edit, {has('n', 'version')} AS version,
 {has('n', 'instrumental')} AS instrumental, {has('n', 'feat|ft|featuring')} AS featured, n AS normalized_title FROM (
 SELECT song_name, {norm('song_name')} AS n FROM (SELECT DISTINCT song_name FROM tracks))""")
def _(v):
    terms = v.tracks.select("song_name").distinct().select(
        "song_name", variants.variant_terms("song_name").alias("t"), variants.full_title("song_name").alias("normalized_title"))
    return terms.select("song_name", "normalized_title", "t.*")


@query("base_title", f"SELECT row_key, {base('song_name')} AS base_title FROM tracks")
def _(v):
    return v.tracks.select("row_key", variants.base_title("song_name").alias("base_title"))


@query("contextual_track_type", f"""
SELECT track_key, {TYPE_SQL} AS track_type, {SOURCE_SQL} AS source FROM full_catalog""", M)
def _(v):
    worded = v.catalog.select(
        "track_key", variants.full_title("title").alias("n"), variants.album_words("album_title").alias("a"))
    kind = variants.track_type_of_words(F.col("n"), F.col("a"))
    return worded.select("track_key", kind.alias("k")).select("track_key", "k.*")


@query("album_flags", f"""
SELECT album_id, {has('an', ALBUM_LIVE)} AS live, {has('an', 'remix|remixes|mix')} AS remix, {has('an', 'acoustic|unplugged')} AS acoustic,
 {has('an', 'demo|rehearsal|outtake|boombox')} AS demo, {has('an', 'instrumental')} AS instrumental, lower(type) = 'compilation'
 OR {has('an', 'collection|greatest hits|best of|essential|icon|international version')} AS compilation_like FROM (SELECT *, {norm('title')} AS an FROM albums)""")
def _(v):
    return v.albums.select("album_id", variants.album_flags("title", "type").alias("f")).select("album_id", "f.*")


@query("album_canonicality", f"""
SELECT album_id, {CANON_SQL} AS canonicality_score, array_to_string({TAGS_SQL}, ',') AS canonicality_tags,
 list_has_any({TAGS_SQL}, ['compilation', 'compilation_title', 'regional_variant']) AS is_editorial_context
FROM (SELECT *, {norm('title')} AS an, type AS album_type FROM albums)""")
def _(v):
    worded = v.albums.select("album_id", variants.album_words("title").alias("w"), "type")
    return worded.select("album_id", variants.canonicality_of_words(F.col("w"), "type").alias("c")).select(
        "album_id", "c.canonicality_score", F.array_join("c.canonicality_tags", ",").alias("canonicality_tags"),
        "c.is_editorial_context")


@query("simple_track_type", """
SELECT row_key, CASE WHEN contains(t, 'live') OR contains(t, 'ao vivo') THEN 'live' WHEN contains(t, 'mix') THEN 'remix'
 WHEN contains(t, 'acoustic') OR contains(t, 'unplugged') THEN 'acoustic' WHEN contains(t, 'instrumental') THEN 'instrumental'
 WHEN contains(t, 'demo') THEN 'demo' ELSE 'studio' END AS track_type FROM (SELECT row_key, lower(song_name) AS t FROM tracks)""")
def _(v):
    return v.tracks.select("row_key", variants.simple_track_type("song_name").alias("track_type"))


@query("variant_key", f"""
SELECT base AS variant_group_key, {TYPE_SQL} AS track_type, {has('n', 'feat|ft|featuring')} AS is_featured_variant, n AS normalized_title, count(*) AS n_tracks
FROM full_catalog GROUP BY ALL""", M)
def _(v):
    # titles repeat, so rows are counted per (title, album title) before any text is normalised
    counted = v.catalog.groupBy("title", "album_title").agg(F.count(F.lit(1)).alias("m"))
    kind = variants.contextual_track_type("title", "album_title")
    keys = variants.variant_key(F.col("title"), kind["track_type"])
    return counted.select(*keys, "m").groupBy(
        "variant_group_key", "track_type", "is_featured_variant", "normalized_title").agg(F.sum("m").alias("n_tracks"))


@query("is_non_studio", """
SELECT doc_id, list_bool_or([contains(lower(text), w) FOR w IN ['live', 'ao vivo', 'acoustic', 'acústico', 'unplugged', 'demo', 'remaster', 'remix', 'edit', 'version',
 'mix', 'best', 'hits', 'essential', 'collection', 'online', 'party', 'nostalgia', 'throwback', 'but...']]) AS non_studio FROM documents""")
def _(v):
    return v.documents.select("doc_id", variants.is_non_studio("text").alias("non_studio"))


@query("two_way_contains", """
SELECT row_key, p_name <> '' AND (contains(lower(song_name), lower(p_name)) OR contains(lower(p_name), lower(song_name))) AS hit
FROM tracks JOIN part ON p_partkey = CAST(split_part(row_key, '-', 3) AS BIGINT) + 1""")
def _(v):
    rows = v.tracks.select("row_key", "song_name", F.split("row_key", "-")[2].cast("bigint").alias("k"))
    joined = rows.join(v.part.select((F.col("p_partkey") - 1).alias("k"), "p_name"), "k")
    return joined.select("row_key", text.two_way_contains(F.lower("song_name"), F.lower("p_name")).alias("hit"))


# ---- matching joins ----------------------------------------------------------------------------------------------------

@query("title_contains_join", "SELECT request, track_key FROM hits", M)
def _(v):
    v = named_tracks(v)
    return hits(v).select("request", "track_key")


@query("base_title_join", "SELECT request, track_key, variant_group_key FROM variant_rows", M)
def _(v):
    return match.base_title_join(asked(v), v.album_tracks).select("request", "track_key", "variant_group_key")


MATCH_SQL = r"""
SELECT mention, s_name AS name, CAST(CASE WHEN q = c THEN 100 WHEN list_sort(qt) = list_sort(ct) THEN 95 ELSE 80 END AS INT) AS score FROM (
 SELECT mention, q, string_split(q, ' ') AS qt, unnest(string_split(q, ' ')) AS token FROM (SELECT DISTINCT mention,
  trim(regexp_replace(regexp_replace(strip_accents(lower(trim(mention))), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM mentions)) m
JOIN (SELECT s_name, replace(lower(s_name), '#', ' ') AS c, string_split(replace(lower(s_name), '#', ' '), ' ') AS ct FROM supplier) n
 ON token = ct[2] WHERE list_has_all(ct, qt)"""


@query("token_overlap_join", MATCH_SQL)
def _(v):
    return match.token_overlap_join(v.mentions, v.supplier.select(F.col("s_name").alias("name")))


@query("topk_candidates", """
SELECT mention, name, score, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, name) AS rn FROM matches) WHERE rn <= 2""",
       {"matches": MATCH_SQL})
def _(v):
    from pyspark.sql import Window

    pairs = match.token_overlap_join(v.mentions, v.supplier.select(F.col("s_name").alias("name")))
    order = Window.partitionBy("mention").orderBy(F.col("score").desc(), "name")
    return pairs.withColumn("rank", F.row_number().over(order)).where("rank <= 2")


@query("album_track_fanout", "SELECT a.album_id, artist_id, track_key, track_number FROM albums a JOIN (SELECT album_id, track_key, track_number FROM album_tracks) USING (album_id)")
def _(v):
    return v.albums.select("album_id", "artist_id").join(
        v.album_tracks.select("album_id", "track_key", "track_number"), "album_id")


# ---- album catalogs ----------------------------------------------------------------------------------------------------

BEST_TITLE = """
SELECT * FROM albums QUALIFY row_number() OVER (PARTITION BY artist_id, lower(trim(title)) ORDER BY popularity DESC, album_id) = 1"""


@query("catalog_dedup", "SELECT artist_id, album_id, title, popularity FROM dedup_albums", {"dedup_albums": BEST_TITLE})
def _(v):
    return catalog.catalog_dedup(v.albums).select("artist_id", "album_id", "title", "popularity")


@query("catalog_order", """
SELECT artist_id, album_id, CAST(row_number() OVER (PARTITION BY artist_id ORDER BY CAST(year AS INT) DESC, popularity DESC, album_id) AS INT) AS position FROM dedup_albums""",
       {"dedup_albums": BEST_TITLE})
def _(v):
    return catalog.catalog_order(catalog.catalog_dedup(v.albums)).select("artist_id", "album_id", "position")


@query("type_distribution", """
SELECT artist_id, count(*) FILTER (WHERE type = 'Album') AS album, count(*) FILTER (WHERE type = 'Single') AS single,
 count(*) FILTER (WHERE type = 'Compilation') AS compilation, count(*) FILTER (WHERE type NOT IN ('Album', 'Single', 'Compilation')) AS unknown
FROM dedup_albums GROUP BY artist_id""", {"dedup_albums": BEST_TITLE})
def _(v):
    return catalog.type_distribution(catalog.catalog_dedup(v.albums))


BEST_YEAR = """
SELECT * FROM albums WHERE year <> '0000' QUALIFY row_number() OVER (PARTITION BY artist_id, year ORDER BY popularity DESC, album_id) = 1"""
FIRST_TRACK = "SELECT album_id, min_by(track_key, (track_number, track_key)) AS track_key, min(track_number) AS track_number FROM album_tracks GROUP BY album_id"


@query("best_album_per_year", "SELECT artist_id, year, album_id FROM best_year", {"best_year": BEST_YEAR})
def _(v):
    return catalog.best_album_per_year(v.albums).select("artist_id", "year", "album_id")


@query("first_track_of_album", "SELECT * FROM first_track", {"first_track": FIRST_TRACK})
def _(v):
    return catalog.first_track(v.album_tracks)


@query("artist_evolution", """
SELECT artist_id, CAST(year AS INT) AS year, title AS key_album, energy AS avg_energy, acousticness AS avg_acousticness, valence AS avg_valence,
 danceability AS avg_danceability FROM best_year JOIN first_track USING (album_id) JOIN tracks ON row_key = track_key""",
       {"best_year": BEST_YEAR, "first_track": FIRST_TRACK})
def _(v):
    audio = v.tracks.select(
        F.col("row_key").alias("track_key"), "energy", "acousticness", "valence", "danceability")
    return catalog.artist_evolution(v.albums, v.album_tracks, audio)


@query("least_popular_albums", """
SELECT artist_id, album_id, title, popularity FROM dedup_albums
QUALIFY row_number() OVER (PARTITION BY artist_id ORDER BY popularity, album_id) <= 5""", {"dedup_albums": BEST_TITLE})
def _(v):
    worst = top_per_group(catalog.catalog_dedup(v.albums), ["artist_id"], ["popularity", "album_id"], 5)
    return worst.select("artist_id", "album_id", "title", "popularity")


@query("best_album_penalised", """
SELECT artist_id, album_id, title, popularity FROM albums QUALIFY row_number() OVER (PARTITION BY artist_id ORDER BY
 CASE WHEN regexp_matches(lower(title), 'best|hits|essential|live|collection|online|version|remix|party|nostalgia|throwback') THEN 1 ELSE 0 END, popularity DESC, album_id) = 1""")
def _(v):
    return catalog.best_album_penalised(v.albums, ["artist_id"]).select("artist_id", "album_id", "title", "popularity")


@query("prioritise_context", """
SELECT artist_id, album_id, hit AS matches_context, CAST(row_number() OVER (PARTITION BY artist_id ORDER BY CASE WHEN hit THEN 0 ELSE 1 END, CAST(year AS INT) DESC, popularity DESC, album_id) AS INT) AS scan_position
FROM (SELECT *, contains(title, 'Live at Reading') AS hit FROM dedup_albums)""", {"dedup_albums": BEST_TITLE})
def _(v):
    ordered = catalog.catalog_order(catalog.catalog_dedup(v.albums)).withColumn("context", F.lit("live AT reading"))
    return catalog.prioritise_context(ordered).select("artist_id", "album_id", "matches_context", "scan_position")


# ---- variants ----------------------------------------------------------------------------------------------------------

@query("match_quality", """
SELECT match_quality, track_type, track_type_source, count(*) AS n FROM rated GROUP BY ALL""", M)
def _(v):
    rows = candidates(catalogued(v), catalog.counted_copies)
    return rows.groupBy("match_quality", "track_type", "track_type_source").agg(F.sum("copies").alias("n"))


@query("variant_representative", "SELECT request, track_key, track_type, match_quality, canonicality_score FROM reps", M)
def _(v):
    return catalog.variant_representative(candidates(catalogued(v))).select(
        "request", "track_key", "track_type", "match_quality", "canonicality_score")


@query("variant_ranking", f"""
SELECT request, track_key, CAST(row_number() OVER (PARTITION BY request ORDER BY {ORDER}) AS INT) AS rank FROM reps""", M)
def _(v):
    return catalog.variant_ranking(candidates(catalogued(v)), ["request", "track_key"])


@query("menu_projection", """
SELECT request, track_key AS id, title, popularity, album_title AS album, CASE WHEN year > 0 THEN CAST(year AS VARCHAR) ELSE '????' END AS year, isrc, track_type,
 track_type_source, match_quality, canonicality_score FROM reps""", M)
def _(v):
    return catalog.menu_projection(catalog.variant_representative(candidates(catalogued(v)))).drop("canonicality_tags")


@query("menu_best_version", f"""
SELECT request, track_key, CAST(row_number() OVER (PARTITION BY request ORDER BY popularity DESC, track_key) AS INT) AS position FROM (
 SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY request, {BASIC.format('title')}, album_title ORDER BY popularity DESC, track_key) = 1)""", M)
def _(v):
    v = catalogued(v)
    requests, members = catalog.asked_alike(asked(v))
    menus = catalog.menu_best_version(candidates(v, catalog.popular_copies, requests), ["request", "track_key"])
    return match.for_members(menus, members)


@query("catalog_rescue", f"""
SELECT request, track_key, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY {ORDER}) AS rank FROM rated)
WHERE rank <= 3 AND popularity > 60 QUALIFY row_number() OVER (PARTITION BY request ORDER BY rank) = 1""", M)
def _(v):
    v = catalogued(v)
    resolvable = v.album_tracks.where("popularity > 60").select("track_key")
    return catalog.catalog_rescue(candidates(v, lambda rows: catalog.best_copies(rows, 3)), resolvable).select("request", "track_key", "rank")


# ---- candidates of the resolver ----------------------------------------------------------------------------------------

SCORES = """
SELECT request, track_key, title, popularity, q_title, 60 + popularity - CASE WHEN (contains(c_title, 'live') OR track_number = 3) AND NOT contains(q_title, 'live') THEN 5000 ELSE 0 END
 + track_number * 10 AS score FROM hits"""


def scored_hits(v, thin=None, asked=None):
    rows = hit_rows(v).withColumns({
        "text_score": F.col("popularity") + 60,
        "disambiguation": F.when(F.col("track_number") == 3, "LIVE in studio"),
        "release_count": F.col("track_number"),
    })
    return hits(v, thin(rows) if thin else rows, asked)


@query("recording_score", "SELECT request, track_key, score FROM scores", {**M, "scores": SCORES})
def _(v):
    v = named_tracks(v)
    return catalog.candidate_scores(scored_hits(v)).select("request", "track_key", "score")


@query("candidate_score_order", """
SELECT request, track_key, CAST(row_number() OVER (PARTITION BY request ORDER BY score DESC, track_key) AS INT) AS position FROM scores""", {**M, "scores": SCORES})
def _(v):
    v = named_tracks(v)
    asked, members = asked_alike(v)
    return match.for_members(catalog.candidate_score_order(scored_hits(v, asked=asked), ["request", "track_key"]), members)


@query("top_15_candidates", """
SELECT request, track_key FROM scores QUALIFY row_number() OVER (PARTITION BY request ORDER BY score DESC, track_key) <= 15""", {**M, "scores": SCORES})
def _(v):
    v = named_tracks(v)
    asked, members = asked_alike(v)
    # a track with 15 better ones of its own title and artist is in no request's list
    rated = catalog.candidate_scores(scored_hits(v, lambda rows: written(catalog.best_scored(rows, 15), "best-scored"), asked))
    top = top_per_group(rated, ["request"], [F.col("score").desc(), "track_key"], 15).select("request", "track_key")
    return match.for_members(top, members)


@query("first_k_distinct_codes", """
SELECT request, code, CAST(position AS INT) AS position FROM (
 SELECT request, code, min(position * 10 + i) AS place, min(position) AS position FROM (
  SELECT request, position, generate_subscripts([1, 2, 3], 1) - 1 AS i, unnest([isrc, concat(isrc, 'x'), '']) AS code FROM (
   SELECT r.request, isrc, row_number() OVER (PARTITION BY request ORDER BY score DESC, track_key) AS position FROM scores r JOIN (SELECT track_key, isrc FROM album_tracks) USING (track_key)))
 WHERE code <> '' GROUP BY request, code) QUALIFY row_number() OVER (PARTITION BY request ORDER BY place, code) <= 5""", {**M, "scores": SCORES})
def _(v):
    v = named_tracks(v)
    asked, members = asked_alike(v)
    ordered = catalog.candidate_score_order(scored_hits(v, asked=asked), ["request", "isrc"])
    codes = F.array("isrc", F.concat("isrc", F.lit("x")), F.lit(""))
    return match.for_members(catalog.first_k_distinct_codes(ordered.withColumn("codes", codes)), members)


@query("canonical_track_choice", """
SELECT request, track_key FROM hits QUALIFY row_number() OVER (PARTITION BY request ORDER BY
 CASE WHEN NOT regexp_matches(q_title, 'live|acoustic|unplugged|demo|remaster|remix|edit|version|mix|best|hits|essential|collection|online|party|nostalgia|throwback')
  AND regexp_matches(lower(title), 'live|acoustic|unplugged|demo|remaster|remix|edit|version|mix|best|hits|essential|collection|online|party|nostalgia|throwback') THEN 1 ELSE 0 END,
 popularity DESC, track_key) = 1""", M)
def _(v):
    v = named_tracks(v)
    rows = v.album_tracks.select("artist_name", "title", "track_key", "popularity")
    return match.best_contained(v.requests.drop("artist_name"), rows)


@query("oldest_release_year", """
SELECT request, min(CASE WHEN regexp_matches(album_release_date, '^[0-9]{4}') THEN CAST(substring(album_release_date, 1, 4) AS INT) END) AS oldest_year
FROM hits JOIN tracks ON row_key = track_key GROUP BY request""", M)
def _(v):
    year = F.when(F.col("album_release_date").rlike("^[0-9]{4}"), F.substring("album_release_date", 1, 4).cast("int"))
    rows = v.tracks.select("artist_name", F.col("song_name").alias("title"), year.alias("year"))
    return match.oldest_contained(v.requests.drop("artist_name"), rows)


@query("oldest_release_hits", """
SELECT request, min(CASE WHEN regexp_matches(album_release_date, '^[0-9]{4}') THEN CAST(substring(album_release_date, 1, 4) AS INT) END) AS oldest_year
FROM hits JOIN tracks ON row_key = track_key GROUP BY request""", M)
def _(v):
    dates = v.tracks.select(F.col("row_key").alias("track_key"), F.col("album_release_date").alias("release_date"))
    # dates are joined, and the oldest track of each title and artist taken, before requests multiply the tracks
    rows = written(catalog.oldest_rows(hit_rows(v).join(dates, "track_key")), "oldest-rows")
    asked, members = asked_alike(v)
    return match.for_members(catalog.oldest_release_year(hits(v, rows, asked)), members)


@query("album_track_choice", """
SELECT request, track_key FROM hits QUALIFY row_number() OVER (PARTITION BY request ORDER BY
 CASE WHEN length(request) % 2 = 0 AND NOT regexp_matches(q_title, 'live|acoustic|unplugged|demo|remaster|remix|edit|version|mix|best|hits|essential|collection|online|party|nostalgia|throwback')
  AND regexp_matches(lower(title), 'live|acoustic|unplugged|demo|remaster|remix|edit|version|mix|best|hits|essential|collection|online|party|nostalgia|throwback') THEN 1 ELSE 0 END,
 popularity DESC, track_key) = 1""", M)
def _(v):
    v = named_tracks(v)
    # requests that name an album take the most popular track, studio or not
    rows = v.album_tracks.select("artist_name", "title", "track_key", "popularity")
    return match.best_contained(v.requests.drop("artist_name").withColumn("album_given", F.length("request") % 2 == 1), rows)


DEEP = """
SELECT request, min_by(track_key, (-popularity, track_key)) AS track_key, max(popularity) AS popularity FROM requests r JOIN album_tracks c ON r.artist_name = c.artist_name
 AND (contains(lower(c.title), lower(title_query)) OR contains(lower(title_query), lower(c.title))) GROUP BY request"""


@query("deep_scan_best", DEEP)
def _(v):
    v = named_tracks(v)
    return match.deep_scan_best(asked(v), v.album_tracks)


ODD = """
SELECT request, artist_name, CASE WHEN length(title_query) % 3 = 0 THEN artist_name ELSE artist_query END AS artist_query,
 CASE length(title_query) % 5 WHEN 0 THEN concat(title_query, ' take two') WHEN 1 THEN 'no such song' ELSE title_query END AS title_query FROM requests"""


@query("resolve_requests", """
SELECT r.request, CAST(CASE WHEN d.track_key IS NOT NULL THEN 1 WHEN s.track_key IS NOT NULL THEN 2 WHEN a.artist_name IS NOT NULL THEN 3 ELSE 4 END AS INT) AS tier,
 coalesce(d.track_key, s.track_key) AS track_key FROM odd r LEFT JOIN direct d USING (request) LEFT JOIN scan s USING (request) LEFT JOIN artists a USING (artist_name)""", {
    "odd": ODD,
    "odd_hits": f"""
SELECT r.request, r.q_title, c.track_key, c.title, c.popularity FROM (SELECT *, {BASIC.format('title_query')} AS q_title, string_split({BASIC.format('artist_query')}, ' ') AS words FROM odd) r
JOIN words_of w ON list_contains(r.words, w.word) JOIN (SELECT *, {BASIC.format('title')} AS c_title FROM album_tracks) c ON c.artist_name = w.artist_name AND contains(c.c_title, r.q_title)""",
    "words_of": """
SELECT s_name AS artist_name, unnest(string_split(replace(lower(s_name), '#', ' '), ' ')) AS word FROM supplier""",
    "direct": """
SELECT request, track_key FROM (SELECT DISTINCT * FROM odd_hits) QUALIFY row_number() OVER (PARTITION BY request ORDER BY
 CASE WHEN NOT regexp_matches(q_title, 'live|acoustic|remaster|remix|mix') AND regexp_matches(lower(title), 'live|acoustic|remaster|remix|mix') THEN 1 ELSE 0 END, popularity DESC, track_key) = 1""",
    "scan": """
SELECT request, min_by(track_key, (-popularity, track_key)) AS track_key FROM odd r JOIN album_tracks c ON r.artist_name = c.artist_name
 AND (contains(lower(c.title), lower(title_query)) OR contains(lower(title_query), lower(c.title))) GROUP BY request"""})
def _(v):
    v = named_tracks(v)
    n = F.length("title_query")
    odd = v.requests.select(
        "request", "artist_name",
        F.when(n % 3 == 0, F.col("artist_name")).otherwise(F.col("artist_query")).alias("artist_query"),
        F.when(n % 5 == 0, F.concat("title_query", F.lit(" take two"))).when(n % 5 == 1, "no such song")
        .otherwise(F.col("title_query")).alias("title_query"))
    return catalog.resolve_requests(odd, v.album_tracks, v.artists)


# ---- artists in tracks, releases, payloads -----------------------------------------------------------------------------

PEOPLE = {"credits": CREDITS, "split_names": SPLIT_NAMES, "names": NAMES}
IN_TRACK = r"""
SELECT request, track_key, score, is_primary, is_solo, popularity, artist FROM (
 SELECT *, CAST(CASE WHEN qt = ct THEN 100 WHEN list_has_all(ct, qt) AND len(ct) = len(qt) THEN 95 WHEN list_has_all(ct, qt) THEN 80
   ELSE floor(len(list_intersect(qt, ct)) / len(qt) * 60) END AS INT) AS score FROM (
  SELECT t.artist_name AS request, n.credit_id AS track_key, t.song_popularity AS popularity, u.artist, u.i, CAST(u.i = 1 AS INT) AS is_primary, CAST(len(n.names) = 1 AS INT) AS is_solo,
   list_reverse(string_split(replace(lower(t.artist_name), '#', ' '), ' ')) AS qt,
   string_split(trim(regexp_replace(regexp_replace(lower(u.artist), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS ct
  FROM names n JOIN tracks t ON t.row_key = n.credit_id, LATERAL (SELECT unnest(n.names) AS artist, generate_subscripts(n.names, 1) AS i) u))
QUALIFY row_number() OVER (PARTITION BY track_key ORDER BY score DESC, is_primary DESC, is_solo DESC, i) = 1"""


def artists_in_tracks(v):
    """Every track with its credited names, asked for by the reversed spelling of its artist."""
    given = credits(v).select(F.col("credit_id").alias("track_key"), "raw")
    # credit texts repeat, so each is split once
    split = written(given.select("raw").distinct(), "credit-texts").select(F.col("raw").alias("_b0"), text.split_collaborations("raw").alias("artists"))
    names = given.join(split, same(["raw"])).select("track_key", "artists")
    tracks = v.tracks.select(
        F.col("row_key").alias("track_key"), F.col("artist_name").alias("request"),
        F.regexp_replace("artist_name", "^([A-Za-z]+)#(.*)$", "$2 $1").alias("artist_query"),
        F.col("song_popularity").alias("popularity"))
    return tracks.join(names, "track_key")


@query("best_artist_in_track", "SELECT * FROM in_track", {**PEOPLE, "in_track": IN_TRACK})
def _(v):
    return catalog.best_artist_in_track(artists_in_tracks(v))


@query("best_artist", """
SELECT request, artist, score, track_key FROM in_track WHERE score >= 80
QUALIFY row_number() OVER (PARTITION BY request ORDER BY score DESC, is_primary DESC, is_solo DESC, popularity DESC, track_key, artist) = 1""",
       {**PEOPLE, "in_track": IN_TRACK})
def _(v):
    return catalog.best_artist(catalog.best_artist_in_track(artists_in_tracks(v)))


@query("collaborators", """
SELECT credit_id, array_to_string(names, '|') AS collaborators, coalesce(names[2], names[1], 'Unknown') AS display_name, len(names) AS n FROM names""", PEOPLE)
def _(v):
    names = text.split_collaborations("raw")
    people = F.transform(names, lambda n, i: F.struct(n.alias("name"), (i == 1).alias("is_context_target")))
    rows = credits(v).select("credit_id", people.alias("people"))
    target = F.get(F.filter("people", lambda p: p["is_context_target"]), F.lit(0))["name"]
    shown = F.coalesce(target, F.get("people", F.lit(0))["name"], F.lit("Unknown"))
    return rows.select(
        "credit_id", F.array_join(F.transform("people", lambda p: p["name"]), "|").alias("collaborators"),
        shown.alias("display_name"), F.size("people").cast("bigint").alias("n"))


RELEASE_ROWS = """
SELECT row_key, rec, pos, title, date, status, type, sec, num, cnt FROM (
 SELECT row_key, unnest([{'rec': 0, 'pos': 0, 'title': 'first', 'date': album_release_date, 'status': CASE WHEN key % 4 = 0 THEN 'Bootleg' ELSE 'Official' END,
   'type': CASE WHEN mode = 1 THEN 'Single' ELSE 'Album' END, 'sec': CASE WHEN key % 3 = 0 THEN 'Live' ELSE '' END, 'num': concat('A', CAST(key AS VARCHAR)), 'cnt': 12},
  {'rec': 0, 'pos': 1, 'title': 'second', 'date': CASE WHEN key % 5 = 0 THEN '' ELSE '1996-05' END, 'status': 'Official', 'type': CASE WHEN key % 2 = 0 THEN 'EP' ELSE 'Other' END, 'sec': '', 'num': '7', 'cnt': 5},
  {'rec': 1, 'pos': 2, 'title': 'third', 'date': '1996', 'status': CASE WHEN time_signature = 2 THEN 'Official' ELSE 'Promotion' END, 'type': 'Album', 'sec': CASE WHEN key = 1 THEN 'Compilation' ELSE '' END, 'num': 'B', 'cnt': 9}],
  recursive := true) FROM tracks)"""


@query("best_release", """
SELECT row_key, true AS found, title AS release_title, date AS release_date, CASE WHEN sec = 'Compilation' THEN 'Compilation' ELSE type END AS release_type,
 TRY_CAST(nullif(regexp_replace(num, '[^0-9]', '', 'g'), '') AS INT) AS track_number, CAST(cnt AS INT) AS track_count FROM (
 SELECT *, status = 'Official' AND type IN ('Album', 'EP', 'Single') AND sec = '' AND length(date) >= 4 AS good FROM release_rows)
QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY CASE WHEN good THEN 0 ELSE 1 END, CASE WHEN good THEN substring(date, 1, 4) END,
 CASE WHEN good THEN list_position(['Album', 'EP', 'Single'], type) END, CASE WHEN good THEN date END, pos) = 1""", {"release_rows": RELEASE_ROWS})
def _(v):
    key, none = F.col("key"), F.array().cast("array<string>")

    def release(title, date, status, kind, secondary, number, count):
        return F.struct(
            F.lit(title).alias("title"), date.alias("date"), status.alias("status"), kind.alias("type"),
            secondary.alias("secondary_types"), number.alias("track_number"), F.lit(count).alias("track_count"))

    def named(text_, condition):
        return F.when(condition, F.array(F.lit(text_))).otherwise(none)

    first = release(
        "first", F.col("album_release_date"), F.when(key % 4 == 0, "Bootleg").otherwise("Official"),
        F.when(F.col("mode") == 1, "Single").otherwise("Album"), named("Live", key % 3 == 0),
        F.concat(F.lit("A"), key.cast("string")), 12)
    second = release(
        "second", F.when(key % 5 == 0, "").otherwise("1996-05"), F.lit("Official"),
        F.when(key % 2 == 0, "EP").otherwise("Other"), none, F.lit("7"), 5)
    third = release(
        "third", F.lit("1996"), F.when(F.col("time_signature") == 2, "Official").otherwise("Promotion"), F.lit("Album"),
        named("Compilation", key == 1), F.lit("B"), 9)
    recordings = F.array(F.struct(F.array(first, second).alias("releases")), F.struct(F.array(third).alias("releases")))
    return catalog.best_release(v.tracks.withColumn("recordings", recordings), ["row_key"])


