"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser reads what
expression a tag holds.

Words are runs of letters, digits and non-ASCII characters of the text with A-Z lowered. A phrase is found where its words
stand one after the other, whatever stands between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegauge.llm.tables import slices

#: The phrases of the base rule and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases, and the identifier each stands for.
NOTICES = {
    "gnu general public license version 3": "gpl-3.0", "gnu general public license version 2": "gpl-2.0",
    "gnu affero general public license": "agpl-3.0", "gnu lesser general public license": "lgpl",
    "mozilla public license version 2": "mpl-2.0", "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd", "boost software license": "bsl-1.0",
    "permission is hereby granted free of charge": "mit", "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0-1.0", "public domain dedication": "public-domain",
    "all rights reserved": "all-rights-reserved", "this is free and unencumbered software": "unlicense",
}
#: A tag is these words followed by an expression on the same line.
TAG = "spdx license identifier"
#: Lower-cased ASCII bytes; all that is no letter or digit is a blank, bytes of non-ASCII characters stay.
PLAIN = bytes(
    b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower()
)
EXPRESSION = re.compile(r"\s*[:=]?\s*([A-Za-z0-9.+() \t-]+)")
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+-]+")
#: Operators and how strongly they bind.
BINDS = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=4)
def automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def parse(text: str) -> list[str]:
    """Licence expression to postfix order by the shunting-yard rule; stops at the first word that does not fit.

    An expression that ends in an operator or leaves a parenthesis open is cut back to the part that is complete.
    """
    out, stack, done, operand = [], [], [], True
    for m in TOKEN.finditer(text):
        token, low = m.group(), m.group().lower()
        if token == "(" and operand:
            stack.append("(")
        elif token == ")" and not operand and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in BINDS and not operand:
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif token not in "()" and low not in BINDS and operand:
            out.append(low)
            operand = False
        else:
            break
        if not operand and "(" not in stack:
            done = out + stack[::-1]
    return done


def evaluate(postfix: list[str], most: int = 64) -> list[frozenset[str]]:
    """The ways to comply: each is a set of licences that hold together. ``with`` adds an exception to a licence.

    More than ``most`` ways are merged into one that names every licence.
    """
    stack: list[list[frozenset[str]]] = []
    for token in postfix:
        if token not in BINDS:
            stack.append([frozenset([token])])
            continue
        b, a = stack.pop(), stack.pop()
        if token == "or":
            ways = a + b
        elif token == "and":
            ways = [x | y for x in a for y in b]
        else:
            ways = [frozenset(f"{p} with {q}" for p in x for q in y) for x in a for y in b]
        ways = list(dict.fromkeys(ways))
        stack.append(ways if len(ways) <= most else [frozenset().union(*ways)])
    return stack[0] if stack else []


def scan(text: str | None) -> tuple[int, list[tuple[str, int, int, str]], list[str], float]:
    """Number of words; finds (kind, first word, number of words, label); expressions in postfix; score.

    ``kind`` is base, notice or tag. The score says how sure it is that the text states a licence: 1 for a tag that parses,
    0.9 with a base phrase, 0.7 with a notice, 0.3 for the bare word license or licence, else 0.
    """
    data = (text or "").encode("utf-8", "surrogatepass").translate(PLAIN)
    words = data.split()
    if not words:
        return 0, [], [], 0.0
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    finds, expressions = [], []
    at, seen = 0, 0
    for end, phrase in automaton((*BASE, *NOTICES, TAG)).iter(line):
        start = end - len(phrase) - 1
        if start >= seen:
            at += line.count(" ", seen, start)
        else:
            at -= line.count(" ", start, seen)
        seen = start
        length = phrase.count(" ") + 1
        if phrase in BASE:
            finds.append(("base", at, length, BASE[phrase]))
        elif phrase in NOTICES:
            finds.append(("notice", at, length, NOTICES[phrase]))
        else:
            finds.append(("tag", at, length, TAG))
    if any(f[0] == "tag" for f in finds):
        tags = [m.end() for m in re.finditer(r"(?i)spdx[^\w\n]+license[^\w\n]+identifier", text)]
        for m in (EXPRESSION.match(text, end) for end in tags):
            postfix = parse(m.group(1)) if m else []
            if postfix:
                expressions.append(" ".join(postfix))
    kinds = {f[0] for f in finds}
    score = 1.0 if expressions else 0.9 if "base" in kinds else 0.7 if "notice" in kinds else 0.3 if {b"license", b"licence"} & set(words) else 0.0
    return len(words), finds, expressions, score


FOUND = "n_words long, finds array<struct<kind:string,word:long,words:long,label:string>>, expressions array<string>, licences array<string>, score double"


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``n_words``, ``finds``, ``expressions`` (postfix), ``licences`` that some way to comply names, ``score``.

    Null and empty texts have no words and no finds. Repeated rows give a row each; other columns are not read.
    """
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema
    names = ["doc_id", "n_words", "finds", "expressions", "licences", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))
        for batch in slices(batches):
            rows = [scan(t) for t in batch.column(1).to_pylist()]
            licences = [sorted({x for e in r[2] for way in evaluate(e.split(" ")) for x in way}) for r in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([r[0] for r in rows], pa.int64()),
                pa.array([[dict(zip(("kind", "word", "words", "label"), f)) for f in r[1]] for r in rows], kinds),
                pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array(licences, pa.list_(pa.string())),
                pa.array([r[3] for r in rows], pa.float64()),
            ], names=names)

    kind = schema["doc_id"].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {FOUND}")
