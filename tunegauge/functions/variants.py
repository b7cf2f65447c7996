"""Track variants (live, remix, ...) and how canonical an album is, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunegauge.functions.text import col, normalize_basic_text, words_only

# Words and phrases that mark a variant in a title.
TITLE_TERMS = {
    "live": ["live", "ao vivo"],
    "acoustic": ["acoustic", "acústico", "unplugged"],
    "demo": ["demo", "rehearsal"],
    "remix": ["remix", "mix"],
    "remaster": ["remaster", "remastered"],
    "edit": ["edit", "radio edit"],
    "version": ["version"],
    "instrumental": ["instrumental"],
    "featured": ["feat", "ft", "featuring"],
}
# Words and phrases that mark the context of an album.
ALBUM_TERMS = {
    "live": ["live", "ao vivo", "broadcast", "unplugged", "reading", "paramount", "festival", "concert"],
    "remix": ["remix", "remixes", "mix"],
    "acoustic": ["acoustic", "acústico", "unplugged"],
    "demo": ["demo", "rehearsal", "outtake", "boombox"],
    "instrumental": ["instrumental"],
    "compilation_like": ["collection", "greatest hits", "best of", "essential", "icon", "international version"],
}
# Points by album type, and penalties by words in the album title.
TYPE_POINTS = {"album": 40, "single": 35, "ep": 30, "compilation": -120}
TITLE_PENALTIES = [
    ("compilation_title", -140,
     ["collection", "greatest hits", "best of", "essential", "icon", "anthology", "playlist"]),
    ("regional_variant", -80, ["international version"]),
    ("live_context", -120, ["live", "broadcast", "unplugged", "reading", "paramount", "festival", "concert"]),
    ("remix_context", -70, ["remix", "remixes", "mix"]),
    ("demo_context", -90, ["demo", "rehearsal", "outtake", "boombox"]),
    ("reissue_context", -20, ["deluxe", "super deluxe", "anniversary"]),
    ("remaster_context", -10, ["remaster", "remastered"]),
]
EDITORIAL_TAGS = ["compilation", "compilation_title", "regional_variant"]
# Order of track types in rankings, and the order in which a type is decided.
TYPE_RANK = ["studio", "acoustic", "live", "demo", "remix", "instrumental", "other"]
TYPE_DECISION = ["live", "remix", "acoustic", "demo", "instrumental"]
MATCH_RANK = ["exact", "featured_variant", "base_variant"]
# Substrings that mark a title as not the studio recording, and album names ranked last.
NON_STUDIO = [
    "live", "ao vivo", "acoustic", "acústico", "unplugged", "demo", "remaster", "remix", "edit", "version", "mix",
    "best", "hits", "essential", "collection", "online", "party", "nostalgia", "throwback", "but...",
]
ALBUM_PENALTY = [
    "best", "hits", "essential", "live", "collection", "online", "version", "remix", "party", "nostalgia", "throwback",
]
# Patterns removed from a title to get its base title.
VARIANT_WORDS = (
    "live|ao vivo|acoustic|acústico|unplugged|demo|rehearsal|"
    "remaster(?:ed)?|remix|mix|radio edit|edit|version|instrumental"
)
BASE_TITLE_PATTERNS = [
    r"\((?:feat|ft|featuring)\.?\s+[^)]*\)",
    r"\[(?:feat|ft|featuring)\.?\s+[^\]]*\]",
    r"\s+(?:feat|ft|featuring)\.?\s+.+$",
    rf"\([^)]*\b(?:{VARIANT_WORDS})\b[^)]*\)",
    rf"\[[^\]]*\b(?:{VARIANT_WORDS})\b[^\]]*\]",
    rf"\s*-\s*.*\b(?:{VARIANT_WORDS})\b.*$",
]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def has_words(normalized: Column, phrases: list[str]) -> Column:
    """True when a squeezed, punctuation-free text holds one of the phrases as whole words."""
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))
    return any_of([padded.contains(f" {p} ") for p in phrases])


def has_substring(text: Column, parts: list[str]) -> Column:
    return any_of([text.contains(p) for p in parts])


def full_title(title: str | Column) -> Column:
    """Lower-case words of a title, bracketed parts kept."""
    return words_only(F.lower(F.trim(F.coalesce(col(title), F.lit("")))))


def variant_terms(title: str | Column) -> Column:
    """Struct of nine flags, one per kind of variant named in the title."""
    text = full_title(title)
    return F.struct(*[has_words(text, words).alias(kind) for kind, words in TITLE_TERMS.items()])


def is_featured(title: str | Column) -> Column:
    return has_words(full_title(title), TITLE_TERMS["featured"])


def base_title(title: str | Column) -> Column:
    """Title without featured artists, bracketed variants, dash variants and punctuation."""
    text = F.lower(F.trim(F.coalesce(col(title), F.lit(""))))
    for pattern in BASE_TITLE_PATTERNS:
        text = F.regexp_replace(text, "(?iU)" + pattern, " ")
    return words_only(text)


def album_flags(album_title: str | Column, album_type: str | Column) -> Column:
    """Struct of six flags about the album a track comes from."""
    text = album_words(album_title)
    kind = F.lower(F.trim(F.coalesce(col(album_type), F.lit(""))))
    flags = {name: has_words(text, words) for name, words in ALBUM_TERMS.items()}
    flags["compilation_like"] = (kind == "compilation") | flags["compilation_like"]
    return F.struct(*[flag.alias(name) for name, flag in flags.items()])


def album_words(album_title: str | Column) -> Column:
    return words_only(F.lower(F.coalesce(col(album_title), F.lit(""))))


def track_type_of_words(title_words: Column, album_title_words: Column) -> Column:
    """Struct(track_type, source) from already normalised titles: the title decides first, then the album."""
    steps = [(has_words(title_words, TITLE_TERMS[k]), k, "track_title") for k in TYPE_DECISION]
    steps += [(has_words(album_title_words, ALBUM_TERMS[k]), k, "album_context") for k in TYPE_DECISION]
    kind, source = F.lit("studio"), F.lit("default")
    for condition, name, origin in reversed(steps):
        kind = F.when(condition, name).otherwise(kind)
        source = F.when(condition, origin).otherwise(source)
    return F.struct(kind.alias("track_type"), source.alias("source"))


def contextual_track_type(title: str | Column, album_title: str | Column) -> Column:
    """Struct(track_type, source): the title decides first, then the album, else the track counts as studio."""
    return track_type_of_words(full_title(title), album_words(album_title))


def canonicality_of_words(album_title_words: Column, album_type: str | Column) -> Column:
    """Struct(canonicality_score, canonicality_tags, is_editorial_context) from a normalised album title."""
    kind = F.lower(F.trim(F.coalesce(col(album_type), F.lit(""))))
    points, tag = F.lit(0), F.lit("unknown_type")
    for name, value in TYPE_POINTS.items():
        points = F.when(kind == name, value).otherwise(points)
        tag = F.when(kind == name, name).otherwise(tag)
    hits = [(has_words(album_title_words, words), value, label) for label, value, words in TITLE_PENALTIES]
    for hit, value, _ in hits:
        points = points + F.when(hit, value).otherwise(0)
    tags = F.array_compact(F.array(tag, *[F.when(hit, F.lit(label)) for hit, _, label in hits]))
    editorial = kind == "compilation"
    for hit, _, label in hits:
        if label in EDITORIAL_TAGS:
            editorial = editorial | hit
    return F.struct(
        points.alias("canonicality_score"), tags.alias("canonicality_tags"), editorial.alias("is_editorial_context"))


def album_canonicality(album_title: str | Column, album_type: str | Column) -> Column:
    """Struct(canonicality_score, canonicality_tags, is_editorial_context) of an album."""
    return canonicality_of_words(album_words(album_title), album_type)


def simple_track_type(title: str | Column) -> Column:
    """Track type by substrings of the title alone ("mixed" counts as a remix)."""
    text = F.lower(col(title))
    return (
        F.when(has_substring(text, ["live", "ao vivo"]), "live")
        .when(has_substring(text, ["remix", "mix"]), "remix")
        .when(has_substring(text, ["acoustic", "acústico", "unplugged"]), "acoustic")
        .when(text.contains("instrumental"), "instrumental")
        .when(text.contains("demo"), "demo")
        .otherwise("studio")
    )


def is_non_studio(title: str | Column) -> Column:
    return has_substring(F.lower(F.coalesce(col(title), F.lit(""))), NON_STUDIO)


def has_album_penalty(name: str | Column) -> Column:
    return has_substring(F.lower(F.coalesce(col(name), F.lit(""))), ALBUM_PENALTY)


def rank_in(value: Column, order: list[str]) -> Column:
    """Position of a label in a fixed order; an unknown label ranks last."""
    position = F.array_position(F.array(*[F.lit(o) for o in order]), value)
    return F.when(position > 0, (position - 1).cast("int")).otherwise(99)


def match_quality(
    candidate_title: Column, target_title: Column, candidate_featured: Column, target_featured: Column,
    track_type: Column, source: Column,
) -> Column:
    """How well a candidate fits the target; an exact title inside a live/remix album is only a variant."""
    exact = candidate_title == target_title
    return (
        F.when(exact & (track_type != "studio") & (source == "album_context"), "base_variant")
        .when(exact, "exact")
        .when(candidate_featured != target_featured, "featured_variant")
        .otherwise("base_variant")
    )


def recording_score(score: Column, title: Column, disambiguation: Column, query_title: Column,
                    release_count: Column) -> Column:
    """Text score, minus 5000 for live recordings nobody asked for, plus 10 per release."""
    live = normalize_basic_text(title).contains("live") | F.lower(F.coalesce(disambiguation, F.lit(""))).contains("live")
    asked = normalize_basic_text(query_title).contains("live")
    return (
        F.coalesce(score, F.lit(0))
        - F.when(live & ~asked, 5000).otherwise(0)
        + F.coalesce(release_count, F.lit(0)) * 10
    )


def variant_key(title: Column, track_type: Column) -> list[Column]:
    """The four grouping columns that collapse copies of one variant across albums."""
    return [
        base_title(title).alias("variant_group_key"),
        track_type.alias("track_type"),
        is_featured(title).alias("is_featured_variant"),
        full_title(title).alias("normalized_title"),
    ]


