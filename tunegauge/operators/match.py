"""Matching joins without cross products.

Substring and word matches are first narrowed by an index on rare character or word groups. The narrowing only drops
pairs that cannot match, so results are complete.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegauge.functions.text import normalize_artist_name, normalize_basic_text, token_score, tokens
from tunegauge.functions.variants import base_title, is_non_studio
from tunegauge.operators.quantiles import same
from tunegauge.session import written

GRAM = 3


def _pieces(text: Column, size: int) -> Column:
    """The different runs of ``size`` letters of a text, as hashes: equal runs meet, and ``contains`` decides in the end."""
    last = F.length(text) - size + 1
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.substring(text, i, F.lit(size))))
    return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


@dataclass
class Postings:
    """Which texts hold a piece, (within..., gram, hay), stored and read by many joins, and how many do, (within..., gram, df)."""

    rows: DataFrame
    sizes: DataFrame
    within: list[str]


def indexed(hays: DataFrame, within: list[str] | None = None, short: bool = True) -> Postings:
    """Postings of the 3-letter pieces of the different texts in ``hay``; with ``short`` of the shorter pieces too.

    Needles of one or two letters are looked up whole and need the shorter pieces.
    """
    within, hay = within or [], F.col("hay")
    pieces = F.flatten(F.array(*[_pieces(hay, n) for n in (range(1, GRAM + 1) if short else [GRAM])]))
    texts = hays.select(*within, "hay").where(hay != "").distinct()
    rows = written(texts.select(*within, "hay", F.explode(pieces).alias("gram")), "postings")
    return Postings(rows, rows.groupBy(*within, "gram").agg(F.count(F.lit(1)).alias("df")), within)


def rarest_pieces(needles: DataFrame, index: Postings) -> DataFrame:
    """(within..., needle, gram, df): the piece of each needle that fewest texts hold; needles with an unknown piece are left out."""
    needle, key = F.col("needle"), [*index.within, "gram"]
    asked = needles.select(*index.within, "needle").where(needle != "").distinct()
    own = F.when(F.length(needle) < GRAM, F.array(F.xxhash64(needle))).otherwise(_pieces(needle, GRAM))
    probes = asked.select(*index.within, "needle", F.size(own).alias("wanted"), F.explode(own).alias("gram"))
    found = probes.join(index.sizes, key).groupBy(*index.within, "needle", "wanted").agg(
        F.count(F.lit(1)).alias("known"), F.min(F.struct("df", "gram")).alias("r"))
    return found.where("known = wanted").select(*index.within, "needle", F.col("r.gram").alias("gram"), F.col("r.df").alias("df"))


def contained(needles: DataFrame, index: Postings) -> DataFrame:
    """All (within..., needle, hay) with an indexed ``hay`` containing ``needle``; empty needles match nothing.

    Every text that contains a needle also contains the needle's rarest piece, so needles are looked up by that one only.
    Texts meet only where ``within`` is equal.
    """
    rare = rarest_pieces(needles, index).drop("df")
    return rare.join(index.rows, [*index.within, "gram"]).where(F.col("hay").contains(F.col("needle"))).select(*index.within, "needle", "hay")


def containment_pairs(needles: DataFrame, hays: DataFrame, within: list[str] | None = None) -> DataFrame:
    """``contained`` for texts that are indexed for this one join."""
    return contained(needles, indexed(hays, within))


def inner_texts(hays: DataFrame, needles: DataFrame) -> DataFrame:
    """All (needle, hay) with ``hay`` containing ``needle``, by cutting the hays: for few hays and many needles.

    A hay of n letters has at most n * (n + 1) / 2 runs, so no needle meets more hays than those that hold it. Only
    runs as long as some needle are cut.
    """
    needle, hay = F.col("needle"), F.col("hay")
    asked = needles.select("needle").where(needle != "").distinct()
    lengths = asked.agg(F.collect_set(F.length(needle)).alias("l")).scalar()  # at most as many as the longest needle has letters
    each = hays.select("hay").where(hay != "").distinct().select("hay", F.explode(lengths).alias("n")).where(F.col("n") <= F.length(hay))
    cut = F.transform(F.sequence(F.lit(1), F.length(hay) - F.col("n") + 1), lambda i: F.xxhash64(F.substring(hay, i, F.col("n"))))
    runs = each.select("hay", F.explode(F.array_distinct(cut)).alias("run"))
    return runs.join(asked.withColumn("run", F.xxhash64(needle)), "run").where(hay.contains(needle)).select("needle", "hay")


def _normal_forms(texts: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name) of the different texts of a column: texts repeat, so each is normalised once."""
    return texts.select(column).distinct().withColumn(name, normalize_basic_text(column))


def _normal_requests(requests: DataFrame) -> DataFrame:
    """(request, q_title, q_artist, free): requests that can match; ``free`` ones name a variant or, in ``album_given``, an album."""
    given = F.coalesce(F.col("album_given").cast("boolean"), F.lit(False)) if "album_given" in requests.columns else F.lit(False)
    raw = written(requests.select("request", "title_query", "artist_query", given.alias("album_given")), "requests")
    titles = _normal_forms(raw, "title_query", "q_title").withColumn("named", is_non_studio("q_title"))
    artists = _normal_forms(raw, "artist_query", "q_artist")
    asked = raw.join(titles.where("q_title <> ''"), "title_query").join(artists.where("q_artist <> ''"), "artist_query")
    return asked.select("request", "q_title", "q_artist", (F.col("album_given") | F.col("named")).alias("free"))


def alike(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, members): requests that read the same once normalised are asked as one, as they have the same hits.

    ``requests`` has (request, artist_query, title_query). ``asked`` has the same columns with a number for ``request``, ``members``
    (_asked, request) tells which requests each number stands for. A request that comes in several rows has a number of its own
    and keeps its rows. Requests that match nothing are left out.
    """
    raw = written(requests.select("request", "title_query", "artist_query"), "requests")
    titles, artists = _normal_forms(raw, "title_query", "q_title"), _normal_forms(raw, "artist_query", "q_artist")
    rows = raw.join(titles.where("q_title <> ''"), "title_query").join(artists.where("q_artist <> ''"), "artist_query")
    return asked_once(raw, rows, ["q_title", "q_artist"], ["title_query", "artist_query"])


def asked_once(requests: DataFrame, rows: DataFrame, keys: list[str], given: list[str]) -> tuple[DataFrame, DataFrame]:
    """(asked, members): one number as ``request`` for all requests of one row that are equal in ``keys``, with the columns ``given`` of
    one of them, and (_asked, request), which requests each number stands for.

    ``rows`` are the requests that can match, with ``keys``. A request in several of these rows has a number of its own and keeps
    all its rows.
    """
    fields = list(dict.fromkeys([*keys, *given]))
    labels = rows.groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*fields)).alias("one"))
    labels = written(labels, "request-labels")
    single = labels.where("n = 1").select("request", "one.*")
    number = F.monotonically_increasing_id()
    readings = single.groupBy(*keys).agg(F.min(F.struct(*given)).alias("_given"))
    readings = written(readings.select(*keys, "_given", number.alias("_asked")), "readings")
    several = written(labels.where("n > 1").select(F.col("request").alias("_b0"), (-number - 1).alias("_asked")), "several")
    asked = readings.select(F.col("_asked").alias("request"), "_given.*").union(
        requests.join(several, same(["request"])).select("_asked", *given))
    members = single.join(readings.drop("_given"), keys).select("_asked", "request").union(
        several.select("_asked", F.col("_b0").alias("request")))
    return asked, written(members, "members")


def for_members(found: DataFrame, members: DataFrame) -> DataFrame:
    """Rows found for the requests of ``alike``, for each of the requests that they stand for."""
    return found.withColumnRenamed("request", "_asked").join(members, "_asked").drop("_asked")


@dataclass
class CatalogIndex:
    """A catalog (artist_name, title, ...) with stored postings of its titles and artists, built once for all lookups.

    ``texts``: each different (title, artist_name) with its number of rows n, its normal forms (c_title, c_artist), whether
    it names no studio recording (off), and whatever else was asked to be kept per text. ``stored``: the same without the
    forms, with NULL titles and artists too.
    """

    rows: DataFrame
    stored: DataFrame
    texts: DataFrame
    titles: Postings
    artists: Postings


def catalog_index(catalog: DataFrame, **kept: Column) -> CatalogIndex:
    """The index of a catalog; ``kept`` are aggregates per (title, artist_name) that go with the texts, from the same scan."""
    texts = catalog.groupBy("title", "artist_name").agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in kept.items()])
    texts = written(texts, "catalog-texts")
    titles, artists = _normal_forms(texts, "title", "c_title"), _normal_forms(texts, "artist_name", "c_artist")
    titles = titles.withColumn("off", is_non_studio("title").cast("int"))
    return CatalogIndex(
        catalog, texts, texts.join(titles, "title").join(artists, "artist_name"),
        indexed(titles.select(F.col("c_title").alias("hay"))), indexed(artists.select(F.col("c_artist").alias("hay"))))


def _with_kept(catalog: DataFrame | CatalogIndex, name: str, value: Column) -> CatalogIndex:
    if not isinstance(catalog, CatalogIndex):
        return catalog_index(catalog, **{name: value})
    if name in catalog.texts.columns:
        return catalog
    more = catalog.rows.groupBy("title", "artist_name").agg(value.alias(name))
    return replace(catalog, texts=catalog.texts.join(more, ["title", "artist_name"]))


def title_contains_join(requests: DataFrame, catalog: DataFrame | CatalogIndex) -> DataFrame:
    """Catalog rows whose title contains the asked title and whose artist contains any word of the asked artist.

    ``requests`` has (request, artist_query, title_query); ``catalog`` has (artist_name, title, ...). Both conditions
    are substring tests on normalised text. Each distinct request takes the cheapest of three exact ways: by matching
    (title, artist) combinations, by matching titles, or by matching artists.
    """
    index = catalog if isinstance(catalog, CatalogIndex) else catalog_index(catalog)
    asked = _normal_requests(requests).drop("free")
    queries = written(asked.select("q_title", "q_artist").distinct(), "asked")
    combos = index.texts.groupBy("c_title", "c_artist").agg(F.sum("n").alias("n"))
    by_title = written(contained(queries.select(F.col("q_title").alias("needle")), index.titles).withColumnsRenamed(
        {"needle": "q_title", "hay": "c_title"}), "by-title")
    words = queries.select("q_artist").distinct().select("q_artist", F.explode(tokens("q_artist")).alias("needle"))
    by_artist = written(words.join(contained(words, index.artists), "needle").select(
        "q_artist", F.col("hay").alias("c_artist")).distinct(), "by-artist")

    def cost(pairs: DataFrame, query: str, text: str, short: str) -> DataFrame:
        sizes = index.texts.groupBy(text).agg(F.sum("n").alias("n"))
        return pairs.join(sizes, text).groupBy(query).agg(F.count(F.lit(1)).alias(f"{short}_pairs"), F.sum("n").alias(f"{short}_rows"))

    both = F.col("t_pairs") * F.col("a_pairs")
    routed = queries.join(cost(by_title, "q_title", "c_title", "t"), "q_title").join(cost(by_artist, "q_artist", "c_artist", "a"), "q_artist")
    routed = written(routed.select(
        "q_title", "q_artist",
        F.when(both <= F.least("t_rows", "a_rows"), "both")
        .when(F.col("t_rows") <= F.col("a_rows"), "title").otherwise("artist").alias("way"),
    ), "routes")

    def way(name: str) -> DataFrame:
        return routed.where(F.col("way") == name).drop("way")

    # first the (title, artist) combinations that satisfy both conditions, then the rows that carry them
    word_hit = F.exists(tokens("q_artist"), lambda t: F.contains(F.col("c_artist"), t))
    keys = ["q_title", "q_artist", "c_title", "c_artist"]
    known = combos.drop("n")
    found = (
        way("both").join(by_title, "q_title").join(by_artist, "q_artist").join(known, ["c_title", "c_artist"]).select(*keys)
        .union(way("title").join(by_title, "q_title").join(known, "c_title").where(word_hit).select(*keys))
        .union(way("artist").join(by_artist, "q_artist").join(known, "c_artist")
               .where(F.contains(F.col("c_title"), F.col("q_title"))).select(*keys))
    )
    found = found.join(index.texts.select("title", "artist_name", "c_title", "c_artist"), ["c_title", "c_artist"])
    hits = asked.join(found, ["q_title", "q_artist"])
    return hits.select("request", "q_title", "title", "artist_name", "c_title").join(index.rows, ["title", "artist_name"])


def least_contained(asked: DataFrame, index: CatalogIndex, best: DataFrame) -> DataFrame:
    """(request, b): the least value among all rows ``title_contains_join`` would return, flagged ones last unless ``free``.

    ``asked`` has (request, q_title, q_artist, free), ``best`` (c_title, c_artist, off, b): the least value per text and
    flag. Minima are taken per (title, artist) before titles are paired, and requests that share a word or a title share
    the work; the full list of hits is never built.
    """
    words = written(asked.select("q_title", F.explode(tokens("q_artist")).alias("word"), "free", "request"), "asked-words")
    wanted = words.select("q_title", "word").distinct()
    by_title = contained(words.select(F.col("q_title").alias("needle")), index.titles).withColumnsRenamed(
        {"needle": "q_title", "hay": "c_title"})
    by_word = contained(words.select(F.col("word").alias("needle")), index.artists).withColumnsRenamed(
        {"needle": "word", "hay": "c_artist"})
    strict, free = F.struct("off", "b"), F.struct(F.lit(0).alias("off"), "b")
    per_artist = by_title.join(best, "c_title").groupBy("q_title", "c_artist").agg(F.min(strict).alias("strict"), F.min(free).alias("free"))
    # an asked word is paired with the artists that hold it, then with the titles asked with that word only
    per_word = wanted.join(by_word, "word").join(per_artist, ["q_title", "c_artist"]).groupBy("q_title", "word").agg(
        F.min("strict").alias("strict_best"), F.min("free").alias("free_best"))
    value = F.when(F.col("free"), F.col("free_best")).otherwise(F.col("strict_best"))
    return words.join(per_word, ["q_title", "word"]).groupBy("request").agg(F.min(value).alias("v")).select("request", "v.b")


def best_track() -> Column:
    """The most popular of several catalog rows, then the one of the least key: (p, track_key) with the popularity negated."""
    return F.min(F.struct((-F.coalesce("popularity", F.lit(0))).alias("p"), "track_key"))


def best_contained(requests: DataFrame, catalog: DataFrame | CatalogIndex) -> DataFrame:
    """(request, track_key): the canonical choice among all rows ``title_contains_join`` would return.

    The most popular track, then the least key. Studio titles come first unless the request names a variant or, in
    column ``album_given``, an album.
    """
    index = _with_kept(catalog, "best", best_track())
    best = index.texts.groupBy("c_title", "c_artist", "off").agg(F.min("best").alias("b"))
    return least_contained(_normal_requests(requests), index, best).select("request", "b.track_key")


def oldest_contained(requests: DataFrame, catalog: DataFrame | CatalogIndex, year: str = "year") -> DataFrame:
    """(request, oldest_year): the least known ``year`` among all rows ``title_contains_join`` would return; NULL if none is known."""
    index = _with_kept(catalog, "oldest", F.min(year))
    best = index.texts.groupBy("c_title", "c_artist").agg(F.min("oldest").alias("y"))
    missing = F.col("y").isNull().cast("int").alias("none")  # a struct, so that texts without a year still count as hits
    best = best.select("c_title", "c_artist", F.lit(0).alias("off"), F.struct(missing, "y").alias("b"))
    return least_contained(_normal_requests(requests), index, best).select("request", F.col("b.y").alias("oldest_year"))


def base_title_join(requests: DataFrame, catalog: DataFrame, artist: str = "artist_name") -> DataFrame:
    """Catalog rows of the same artist with the same base title as the request."""
    asked = requests.withColumn("_base", base_title("title_query")).where("_base <> ''")
    return asked.join(catalog.withColumn("_base", base_title("title")), [artist, "_base"]).withColumnRenamed(
        "_base", "variant_group_key")


def token_overlap_join(mentions: DataFrame, names: DataFrame, min_score: int = 80) -> DataFrame:
    """(mention, name, score) for all pairs scoring at least ``min_score`` (1..100).

    A score above 60 needs all words of the mention in the name; a lower score needs a share of them. A pair with that
    many shared words also shares one of the mention's rarest words, so only those are looked up.
    """
    if not 1 <= min_score <= 100:
        raise ValueError("min_score must be within 1..100")
    asked = mentions.select("mention").distinct().withColumn("q", normalize_artist_name("mention")).where("q <> ''")
    known = names.select("name").distinct().withColumn("c", normalize_artist_name("name")).where("c <> ''")
    queries = asked.select("q").distinct().withColumn("q_tokens", tokens("q"))
    targets = known.select("c").distinct().withColumn("c_tokens", tokens("c"))
    postings = targets.select("c", "c_tokens", F.explode("c_tokens").alias("token"))
    sizes = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = (
        queries.select("q", F.explode("q_tokens").alias("token")).join(sizes, "token", "left")
        .groupBy("q").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("w"))
    )  # a list of the words of one name
    total = F.size("w")
    needed = total if min_score > 60 else F.greatest(F.lit(1), F.ceil(total * min_score / 60).cast("int"))
    probes = ranked.select("q", F.explode(F.slice("w", F.lit(1), total - needed + 1)).alias("p")).select("q", "p.token")
    pairs = probes.join(postings, "token").drop("token").distinct().join(queries, "q")
    score = token_score(F.col("q"), F.col("c"), F.col("q_tokens"), F.col("c_tokens"))
    hits = pairs.withColumn("score", score).where(F.col("score") >= min_score).select("q", "c", "score")
    return asked.join(hits, "q").join(known, "c").select("mention", "name", "score")


def deep_scan_best(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per request the most popular track of its artist whose title contains the asked title or lies inside it.

    ``requests`` has (request, artist_name, title_query), ``catalog`` (artist_name, title, track_key, popularity).
    Only the best track of each (artist, title) of an asked artist can win. Titles inside asked titles come from cutting
    the asked ones. For titles around an asked one, each asked title takes the cheaper of two exact ways: the titles that
    hold its rarest piece, once for all its requests, or all titles of the artists it is asked for.
    """
    asked = written(requests.select("request", "artist_name", F.lower("title_query").alias("q_title")), "asked-titles")
    best = catalog.join(asked.select("artist_name").distinct(), "artist_name", "left_semi")
    best = written(best.groupBy("artist_name", F.lower("title").alias("c_title")).agg(best_track().alias("b")), "best-titles")
    needles = asked.select(F.col("q_title").alias("needle"))
    titles = best.select(F.col("c_title").alias("hay")).distinct()
    index = indexed(titles)
    around = inner_texts(needles.withColumnRenamed("needle", "hay"), titles.withColumnRenamed("hay", "needle")).select(
        F.col("hay").alias("q_title"), F.col("needle").alias("c_title"))

    owned = best.groupBy("artist_name").agg(F.count(F.lit(1)).alias("owned"))
    scans = asked.join(owned, "artist_name").groupBy("q_title").agg(F.count(F.lit(1)).alias("asks"), F.sum("owned").alias("scan"))
    rare = rarest_pieces(needles, index).withColumnRenamed("needle", "q_title")
    ways = written(rare.join(scans, "q_title").select(
        "q_title", "gram", (F.col("df") * F.col("asks") <= F.col("scan")).alias("by_piece")), "title-ways")
    inside = ways.where("by_piece").join(index.rows, "gram").where(F.col("hay").contains(F.col("q_title"))).select(
        "q_title", F.col("hay").alias("c_title"))
    pairs = written(inside.union(around).distinct(), "title-pairs")
    paired = asked.join(pairs, "q_title").join(best, ["artist_name", "c_title"]).select("request", "b")
    # stored, so that Spark knows if there are few of them and sends them to the titles
    left = written(asked.join(ways.where("NOT by_piece").select("q_title"), "q_title"), "title-scans")
    scanned = left.join(best, "artist_name").where(
        F.col("c_title").contains(F.col("q_title"))).select("request", "b")
    return paired.union(scanned).groupBy("request").agg(F.min("b").alias("b")).select(
        "request", "b.track_key", (-F.col("b.p")).alias("popularity"))
