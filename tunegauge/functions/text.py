"""Text functions for matching titles and artist names, as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators between collaborating artists, and what counts as punctuation.
NON_WORD = r"[^\p{L}\p{N}_\s]"
COLLABORATION = (
    r"(?iU)\s+feat\.?\s+|\s+ft\.?\s+|\s+&\s+|\s+x\s+|\s+with\s+|\s+vs\.?\s+|\s+presents\s+|\s+features\s+"
)


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def squeeze(text: str | Column) -> Column:
    """Every run of white space becomes one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def words_only(text: str | Column) -> Column:
    """Punctuation becomes blanks, then blanks are squeezed."""
    return squeeze(F.regexp_replace(col(text), NON_WORD, " "))


def normalize_basic_text(text: str | Column) -> Column:
    """Lower-case words of a title without its bracketed parts; missing text becomes ''."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\([^)]*\)", " "), r"\[[^\]]*\]", " ")
    return words_only(F.lower(plain))


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, str, list[tuple[str, str]]]:
    """Accent folds from the Unicode character data: single letters (from, to), marks to drop, and expansions.

    An expansion of n letters is in the first n pairs (from, to) of the list: pair k gives the kth letter.
    """
    source, target, marks, longer = [], [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != char:
            source.append(char)
            target.append(plain)
        elif not plain:
            marks.append(char)
        elif len(plain) > 1:
            longer.append((char, plain))
    pairs = []
    for k in range(max(len(plain) for _, plain in longer)):
        some = [(char, plain[k]) for char, plain in longer if len(plain) > k]
        pairs.append(("".join(c for c, _ in some), "".join(x for _, x in some)))
    return "".join(source), "".join(target), "".join(marks), pairs


def _wide(chars: str, width: int = 100) -> str:
    """A short character class that holds the given characters and their near neighbours: all but the wide gaps between them."""
    codes = sorted(map(ord, chars))
    gaps = [(a + 1, b - 1) for a, b in zip([-1, *codes], [*codes, sys.maxunicode + 1]) if b - a > width]
    return "[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in gaps) + "]"


def fold_accents(text: str | Column, exact: bool = True) -> Column:
    """Drop accents, and write ligatures, fractions and composed scripts letter by letter (compatibility decomposition).

    ASCII texts are left as they are, and other texts are taken apart only before characters that may stand for several
    letters. ``exact`` stays for callers that name it: there is one form of folding, the exact one.
    """
    source, target, marks, pairs = _folds()
    first = pairs[0]
    some = _wide(first[0])

    def spelled(char: Column) -> Column:
        letters = [F.translate(char, *first)]
        for chars, letter in pairs[1:]:  # characters without a kth letter have no letter here: all others are deleted
            letters.append(F.when(F.translate(char, chars, "") == "", F.translate(char, chars, letter)).otherwise(""))
        return F.concat(*letters)

    def piece(p: Column) -> Column:
        char = F.substring(p, F.lit(1), F.lit(1))  # no other one of the piece has several letters
        return F.when(F.translate(char, first[0], "") == "", F.concat(spelled(char), F.substring(p, F.lit(2), F.length(p)))).otherwise(p)

    def fold(given: Column) -> Column:
        whole = F.array_join(F.transform(F.split(given, f"(?={some})"), piece), "")
        # characters of ``marks`` have no counterpart in the replacement, so translate deletes them
        folded = F.translate(F.when(F.translate(given, first[0], "") != given, whole).otherwise(given), source + marks, target)
        return F.when(given.rlike(r"[^\x00-\x7F]"), folded).otherwise(given)

    return F.get(F.transform(F.array(col(text)), fold), F.lit(0))  # so that ``text`` is computed once, not in every branch


def normalize_artist_name(name: str | Column, exact: bool = True) -> Column:
    """Accent-free lower-case words of an artist name; a missing name becomes ''."""
    return words_only(fold_accents(F.lower(F.trim(F.coalesce(col(name), F.lit("")))), exact))


def tokens(normalized: str | Column) -> Column:
    """Distinct words of an already normalised text; an empty text has none."""
    return F.array_distinct(F.filter(F.split(col(normalized), " "), lambda t: t != ""))


def token_score(query: Column, candidate: Column, query_tokens: Column, candidate_tokens: Column) -> Column:
    """Match score of two normalised names, given their words."""
    shared = F.size(F.array_intersect(query_tokens, candidate_tokens))
    wanted = F.size(query_tokens)
    return (
        F.when((query == "") | (candidate == "") | (wanted == 0), 0)
        .when(query == candidate, 100)
        .when((shared == wanted) & (wanted == F.size(candidate_tokens)), 95)
        .when(shared == wanted, 80)
        .otherwise(F.floor(shared / wanted * 60).cast("int"))
    )


def artist_name_match_score(query: str | Column, candidate: str | Column) -> Column:
    """100 equal, 95 same words, 80 all query words present, else the shared part of the query words times 60."""
    q, c = normalize_artist_name(query), normalize_artist_name(candidate)
    return token_score(q, c, tokens(q), tokens(c))


def split_collaborations(raw: str | Column) -> Column:
    """Names in a collaboration string, in order, without repeats that differ only in case."""
    chunks = F.split(F.coalesce(col(raw), F.lit("")), " / ")
    names = F.flatten(F.transform(chunks, lambda c: F.split(c, COLLABORATION)))
    names = F.filter(F.transform(names, squeeze), lambda n: n != "")
    return F.filter(
        names, lambda n, i: F.array_position(F.transform(names, lambda m: F.lower(m)), F.lower(n)) == i + 1
    )


def merge_nationalities(*names: Column) -> Column:
    """Join distinct trimmed names with `` / ``, in order; NULL when there is none."""
    parts = F.array_distinct(F.transform(F.array_compact(F.array(*names)), lambda n: F.trim(n)))
    return F.nullif(F.concat_ws(" / ", parts), F.lit(""))


def extract_code(url: str | Column) -> Column:
    """First ``Q`` number in a link, else NULL."""
    return F.nullif(F.regexp_extract(col(url), r"Q\d+", 0), F.lit(""))


def digits_of(text: str | Column) -> Column:
    """The digits of a text such as ``A12`` as a number, else NULL."""
    return F.nullif(F.regexp_replace(col(text), "[^0-9]", ""), F.lit("")).try_cast("int")


def two_way_contains(a: str | Column, b: str | Column) -> Column:
    """True when one normalised text contains the other; empty texts match nothing."""
    left, right = col(a), col(b)
    return (left != "") & (right != "") & (left.contains(right) | right.contains(left))


def year_of(date: str | Column) -> Column:
    """Year of a date text of any grain (``YYYY``, ``YYYY-MM``, ``YYYY-MM-DD``), else NULL."""
    return F.nullif(F.regexp_extract(col(date), "^([0-9]{4})", 1), F.lit("")).try_cast("int")


def tag_column(tag: str | Column) -> Column:
    """The one tag spelling used for training and scoring: lower case with ``_`` for blanks."""
    return F.replace(F.lower(col(tag)), F.lit(" "), F.lit("_"))


def composite_key(artist: str | Column, song: str | Column) -> Column:
    """Printable key of an (artist, song) pair. Joins use the two columns, not this text."""
    return F.concat_ws(" || ", squeeze(artist), squeeze(song))
