"""Benchmark decontamination over a distributed positional inverted index, with DataFrame functions only.

The index is a stored table of postings (row, word, pos) of the training words that some benchmark item uses, and one entry
per document that holds its length. A window of consecutive item words is looked up by its rarest words; their lists, and then
those of its other words, are intersected at positions adjusted by their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunegauge.llm.tables import stored

#: Rows of a table that may be sent to all executors; a larger one is joined by shuffling. The result is the same.
SENT_ROWS = 400_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """Words of a text: what lies between ASCII characters that are no letter or digit, A-Z lowered. Null has none."""
    given = F.coalesce(F.col(text), F.lit(""))
    low = F.when(F.octet_length(given) == F.length(given), F.lower(given)).otherwise(F.translate(given, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def sent(df: DataFrame) -> DataFrame:
    """The stored frame, marked for sending to all executors if it is small enough for that."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def windows(benchmark: DataFrame, size: int = 13, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, item, first, terms): each run of ``size`` words of an item; all words of a shorter one. No words give no window.

    ``window`` is the words joined by blanks, so windows of equal words share it.
    """
    items = benchmark.select(F.col(item_id).alias("item"), words(text).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - size, F.lit(0)))
    cut = items.select("item", "all", F.explode(starts).alias("first"))
    cut = cut.select("item", "first", F.slice("all", F.col("first") + 1, F.lit(size)).alias("terms"))
    return cut.withColumn("window", F.array_join("terms", " "))


def index(docs: DataFrame, vocabulary: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored postings (row, word, pos) of the vocabulary's words, and per document one with the empty word.

    The latter has the number of words as ``pos``, the id as ``doc`` and the text's digest. ``row`` numbers rows of ``docs``, so
    null and repeated ids are kept apart.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.concat(words(text), F.array(F.lit(""))).alias("all"),
    )
    postings = rows.select("row", "doc", "digest", F.posexplode("all").alias("pos", "word"))
    kept = postings.join(sent(stored(vocabulary.union(docs.sparkSession.sql("select ''")).toDF("word").distinct(), "vocabulary")), "word")
    whole = lambda c: F.when(F.col("word") == "", F.col(c)).alias(c)
    return stored(kept.select("row", "word", "pos", whole("doc"), whole("digest")), "postings")


def pivots(postings: DataFrame, cut: DataFrame, count: int = 3) -> DataFrame:
    """Stored (number, window, terms, rare): each different window with its ``count`` rarest words as (n, offset, word).

    Words are ranked by their posting counts. Windows with a word that no document has are left out, as they can't occur.
    """
    frequency = stored(postings.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n")), "frequencies")
    each = cut.select("window", "terms").distinct()
    placed = each.select("window", "terms", F.posexplode("terms").alias("offset", "word")).join(frequency, "word", "left")
    ranked = placed.groupBy("window").agg(
        F.sort_array(F.collect_list(F.struct("n", "offset", "word"))).alias("rare"), F.count("n").alias("known"), F.first("terms").alias("terms"),
    )
    ranked = ranked.filter(F.col("known") == F.size("terms")).select(
        F.monotonically_increasing_id().alias("number"), "window", "terms", F.slice("rare", 1, count).alias("rare")
    )
    return stored(ranked, "pivots")


def phrases(postings: DataFrame, cut: DataFrame) -> DataFrame:
    """Stored (row, start, window, length): where a window's words stand one after the other in a document.

    The lists of a window's three rarest words are intersected first, at positions adjusted by their offsets; places that all
    three give stay if the lists of the other words have a posting at the adjusted position too.
    """
    chosen = pivots(postings, cut)
    rare = chosen.select("number", F.size("rare").alias("wanted"), F.explode("rare").alias("r"))
    rare = stored(rare.select("number", "wanted", F.col("r.offset").alias("offset"), F.col("r.word").alias("word")), "rare-words")
    places = postings.join(sent(rare), "word").select("row", "number", "wanted", (F.col("pos") - F.col("offset")).alias("start"))
    places = places.filter("start >= 0").groupBy("row", "start", "number", "wanted").agg(F.count("*").alias("n"))
    found = places.filter("n = wanted").select("row", "start", "number")
    found = stored(found.join(sent(chosen.select("number", "window", "terms")), "number"), "candidates")
    needed = found.select("row", "start", "window", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "word"))
    needed = needed.withColumn("pos", F.col("start") + F.col("offset"))
    asked = stored(needed.select("row", "pos", "word").distinct(), "asked")
    there = stored(postings.select("row", "pos", "word").join(sent(asked), ["row", "pos", "word"]), "answered")
    full = needed.join(there, ["row", "pos", "word"]).groupBy("row", "start", "window", "length").agg(F.count("*").alias("n"))
    return stored(full.filter("n = length").drop("n"), "phrases")


def proximity(postings: DataFrame, cut: DataFrame, slack: int = 4, terms: int = 3) -> DataFrame:
    """(row, window, start, stretch): where a window's rarest words stand within ``slack`` words of the places the phrase gives them.

    ``start`` is where the rarest word puts the phrase, ``stretch`` the largest difference from it; exact phrases have stretch 0.
    A window of fewer words uses those it has. Slots of slack + 1 positions make this an equality join.
    """
    rare = pivots(postings, cut, terms).select("window", F.posexplode("rare").alias("rank", "r"), F.size("rare").alias("wanted"))
    rare = rare.select("window", "rank", "wanted", F.col("r.offset").alias("offset"), F.col("r.word").alias("word"))
    at = postings.join(rare, "word").select("row", "window", "rank", "wanted", (F.col("pos") - F.col("offset")).alias("start"))
    at = stored(at.withColumn("slot", F.floor(F.col("start") / (slack + 1))), "rare-places")
    first = at.filter("rank = 0").select("row", "window", "wanted", "start", F.explode(F.array(*[F.col("slot") + d for d in (-1, 0, 1)])).alias("slot"))
    others = at.filter("rank > 0").select("row", "window", "slot", "rank", F.col("start").alias("other"))
    near = first.join(others, ["row", "window", "slot"]).withColumn("off", F.abs(F.col("start") - F.col("other"))).filter(F.col("off") <= slack)
    near = near.groupBy("row", "window", "wanted", "start", "rank").agg(F.min("off").alias("off"))
    near = near.groupBy("row", "window", "wanted", "start").agg(F.count("*").alias("n"), F.max("off").alias("stretch"))
    alone = at.filter("rank = 0 and wanted = 1").select("row", "window", "start", F.lit(0).cast("long").alias("stretch"))
    return near.filter("n = wanted - 1").select("row", "window", "start", F.col("stretch").cast("long").alias("stretch")).union(alone)


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per row of ``docs``: doc, digest (MD5 of the text), n_words, n_hit, items (sorted list of ids as text), contaminated.

    A word is hit if it lies in an occurrence of a window. ``contaminated``: hit words exist and are at least one in ``share``.
    Null and empty texts have no words. Items with a null id count for hits but are not listed; repeated items count once.
    """
    cut = stored(windows(benchmark, size, item_id, item_text), "windows")
    postings = index(docs, cut.select(F.explode("terms")).distinct(), doc_id, text)
    found = phrases(postings, cut)
    hit = found.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    hit = hit.groupBy("row").agg(F.count("*").alias("n_hit"))
    items = found.select("row", "window").distinct().join(cut.select("window", "item").distinct(), "window").select("row", "item").distinct()
    items = items.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    marks = stored(hit.join(items, "row"), "hits")
    documents = postings.filter("word = ''").select("row", "doc", "digest", F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return documents.join(marks, "row", "left").select(
        "doc", "digest", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; equal texts get equal decisions."""
    found = contamination(docs, benchmark, text=text, **options)
    bad = stored(found.filter("contaminated").select(F.col("digest").alias("_digest")).distinct(), "contaminated")
    return docs.join(bad, F.md5(F.coalesce(docs[text], F.lit(""))) == bad["_digest"], "left_anti")
