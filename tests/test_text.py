"""Edge rules of text functions, checked against plain Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tunegauge.functions import scalars, text, variants

TITLES = [
    "Song (Live)", "Song [Acoustic]", "Song - Remastered 2011", "Song feat. X", "Canção (Ao Vivo)", "Mixed Feelings",
    "Alive", "", None, "Song (feat. Ana) - Radio Edit", "Ação_1!  dois", "A B",
]


def values(spark, rows, column, name="t"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string")
    return [r["out"] for r in frame.select("i", column.alias("out")).orderBy("i").collect()]


def python_basic(value):
    if not value:
        return ""
    value = re.sub(r"\[[^\]]*\]", " ", re.sub(r"\([^)]*\)", " ", value))
    return " ".join(re.sub(r"[^\w\s]", " ", value.lower()).split())


def test_basic_text(spark):
    assert values(spark, TITLES, text.normalize_basic_text("t")) == [python_basic(t) for t in TITLES]


@pytest.mark.parametrize("exact", [False, True])
def test_artist_name(spark, exact):
    names = ["João", "AC/DC", "  Beyoncé ", "Sigur Rós", "Mötley Crüe", None, "", "A_B", "Đorđe"]

    def plain(v):
        v = unicodedata.normalize("NFKD", (v or "").strip().lower())
        return " ".join(re.sub(r"[^\w\s]", " ", "".join(c for c in v if not unicodedata.combining(c))).split())

    assert values(spark, names, text.normalize_artist_name("t", exact)) == [plain(n) for n in names]


def test_exact_folding_expands_ligatures(spark):
    assert values(spark, ["ﬁne", "½"], text.fold_accents("t", True)) == ["fine", "1⁄2"]


def test_folding_takes_apart_only_where_it_must(spark):
    source, target, marks, pairs = text._folds()
    special = pairs[0][0]
    assert len(text._wide(special)) < 700  # not a range for each run of special characters
    safe = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), text._wide(special)))
    assert all(safe.match(c) for c in special)

    def plain(v):
        return "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))

    texts = [f"é{c}a{c}{c} \U0001F600{c}" for c in special[::37]] + ["½", "a½", "½a", "… 가나 \U0001F100é\U0001F600", "à… " * 30_000]
    assert values(spark, texts, text.fold_accents("t")) == [plain(t) for t in texts]


def test_match_score(spark):
    pairs = [("João", "Joao"), ("a b", "B A"), ("a", "a b"), ("a b c", "a x"), ("a", "b"), ("", "b"), ("x", None),
             ("a b c", "a b z")]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, q string, c string")
    got = [r["s"] for r in frame.select("i", text.artist_name_match_score("q", "c").alias("s")).orderBy("i").collect()]
    assert got == [100, 95, 80, 20, 0, 0, 0, 40]


def test_collaborations(spark):
    raw = ["AC/DC", "A / B feat. C", "A & a", "A x B", "A vs. B", " ", None, "Max with X presents Y", "A  FEAT B ft. C"]
    assert values(spark, raw, text.split_collaborations("t")) == [
        ["AC/DC"], ["A", "B", "C"], ["A"], ["A", "B"], ["A", "B"], [], [], ["Max", "X", "Y"], ["A", "B", "C"]]


def test_variant_terms_and_base_title(spark):
    live = values(spark, TITLES, variants.variant_terms("t")["live"])
    assert live == [True, False, False, False, True, False, False, False, False, False, False, False]
    bases = values(spark, TITLES, variants.base_title("t"))
    assert bases == ["song", "song", "song", "song", "canção", "mixed feelings", "alive", "", "", "song", "ação_1 dois", "a b"]


def test_track_type_and_simple_type(spark):
    rows = [("Song", "Live at Reading"), ("Song (Demo)", "Live"), ("Song", "Remixes"), ("Song", "Plain"), ("Mixed", "x")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, a string")
    got = frame.select("i", variants.contextual_track_type("t", "a").alias("k"), variants.simple_track_type("t").alias("s"))
    out = [(r["k"]["track_type"], r["k"]["source"], r["s"]) for r in got.orderBy("i").collect()]
    assert out == [
        ("live", "album_context", "studio"), ("demo", "track_title", "demo"), ("remix", "album_context", "studio"),
        ("studio", "default", "studio"), ("studio", "default", "remix")]


def test_canonicality(spark):
    rows = [("Greatest Hits", "Compilation"), ("X (Deluxe)", "ALBUM"), ("Live Demo Remaster", "other"),
            ("International Version", "ep"), (None, None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, k string")
    got = [r["c"] for r in frame.select("i", variants.album_canonicality("t", "k").alias("c")).orderBy("i").collect()]
    assert [(c["canonicality_score"], c["is_editorial_context"]) for c in got] == [
        (-260, True), (20, False), (-220, False), (-50, True), (0, False)]
    assert got[2]["canonicality_tags"] == ["unknown_type", "live_context", "demo_context", "remaster_context"]


def test_bins_regimes_and_keys(spark):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 2.0, 2.1, 5.0, 10.0, 11.0, None])], "i int, x double")
    bins = [r["b"] for r in frame.select("i", scalars.right_closed_bin(F.col("x"), [2, 5, 10]).alias("b")).orderBy("i").collect()]
    assert bins == [0, 0, 1, 1, 2, 3, None]
    logs = spark.createDataFrame([(i, x) for i, x in enumerate([8.8, 8.81, 13.08, 13.09, None])], "i int, x double")
    assert [r["r"] for r in logs.select("i", scalars.regime_id("x").alias("r")).orderBy("i").collect()] == [0, 1, 1, 2, None]
    keys = spark.createDataFrame([(0, 1, 0), (1, 12, 1), (2, -1, 1), (3, 11, 1)], "i int, k int, m int")
    assert [r["n"] for r in keys.select("i", scalars.pitch_key_name("k", "m").alias("n")).orderBy("i").collect()] == [
        "C# Min", "Unknown", "Unknown", "B Maj"]


def test_recency_policies(spark):
    frame = spark.createDataFrame([(None,)], "y double")
    row = frame.select(
        scalars.recency_weight("y", 2020, null_policy="none").alias("n"),
        scalars.recency_weight("y", 2020, null_policy="median", median_year=2010).alias("m"),
        scalars.recency_weight("y", 2020, null_policy="current").alias("c")).first()
    assert row["n"] is None and abs(row["m"] - 2.718281828 ** -0.5) < 1e-6 and row["c"] == 1.0
    with pytest.raises(Exception, match="missing year"):
        frame.select(scalars.recency_weight("y", 2020, null_policy="error").alias("e")).collect()


def test_every_letter_is_folded_like_its_decomposition(spark):
    """All code points up to U+FFFF and some above, alone and in a name."""

    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF] + [chr(c) for c in range(0x1D400, 0x1D480)] + [chr(0x1F600)]
    frame = spark.createDataFrame([(c, f"a{c}b") for c in chars] + [(None, None)], "c string, name string").repartition(8)
    got = frame.select("c", text.fold_accents("c").alias("one"), text.fold_accents("name").alias("two")).collect()
    fold = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
    wrong = [r for r in got if r["c"] is not None and (r["one"] != fold(r["c"]) or r["two"] != fold(f"a{r['c']}b"))]
    assert not wrong, [(hex(ord(r["c"])), r["one"], fold(r["c"])) for r in wrong[:5]]
    assert [r["one"] for r in got if r["c"] is None] == [None]
