"""How quality filters overlap: what each removes in every order, and what it removes on average over all orders.

The rows that fail any filter of a coalition are tabulated for all coalitions. Removing is a game whose value for a coalition
is that number; the average over all orders is the Shapley value. It is the exact solution of a least-squares problem: weights
by coalition size, one unknown per filter, and the sum of the unknowns held to the value of all filters together. Its normal
equations are solved in rationals, once, as they do not depend on data; a part then takes one product of whole numbers. What a
filter removes at a step is the difference of two coalitions.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegauge.llm.tables import stored

SEPARATORS = r"[\x20\x09-\x0D]+"


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """The solution of matrix * x = right, column by column, by elimination in rationals."""
    rows = [[*map(Fraction, a), *map(Fraction, b)] for a, b in zip(matrix, right)]
    for i in range(len(rows)):
        pivot = next(r for r in range(i, len(rows)) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r, row in enumerate(rows):
            if r != i and row[i]:
                rows[r] = [x - row[i] * y for x, y in zip(row, rows[i])]
    return [row[len(rows):] for row in rows]


def shapley_weights(count: int) -> list[list[int]]:
    """Whole numbers w with: sum over coalitions S of w[i][S] * value(S) = count! * Shapley value of i; the empty value is 0.

    Coalitions are bit masks. The last row and column of the system belong to the multiplier of the efficiency constraint.
    """
    whole = (1 << count) - 1
    kernel = {
        s: Fraction(count - 1, comb(count, s.bit_count()) * s.bit_count() * (count - s.bit_count())) for s in range(1, whole)
    }
    matrix = [
        [sum((k for s, k in kernel.items() if s >> i & s >> j & 1), Fraction(0)) for j in range(count)] + [Fraction(1)]
        for i in range(count)
    ] + [[Fraction(1)] * count + [Fraction(0)]]
    right = [[kernel.get(s, Fraction(0)) if s >> i & 1 else Fraction(0) for s in range(whole + 1)] for i in range(count)]
    right.append([Fraction(s == whole) for s in range(whole + 1)])
    return [[int(x * factorial(count)) for x in row] for row in solved(matrix, right)[:count]]


def interactions(rows: DataFrame, names: str, mask: str = "mask", part: str = "part", counts: dict[str, Column] | None = None) -> DataFrame:
    """One row per part, order of the filters and step, from rows with a bit mask of the filters that they fail.

    ``names`` has a letter per filter, the first for bit 1. Long counts: ``kept``, ``removed``, ``redundant`` (fails this
    filter, removed before), ``unique_fails`` (fails this one only), ``shapley`` (removed by this filter, summed over all
    orders), and ``<name>_lost`` for each further count. A null mask fails nothing. No rows give no rows.
    """
    counts, whole = counts or {}, (1 << len(names)) - 1
    failed = F.coalesce(F.col(mask), F.lit(0))
    cells = rows.groupBy(F.col(part).alias("part"), failed.alias("mask")).agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{k}") for k, c in counts.items()])

    def removals(column: str) -> Column:
        hit = lambda s: F.col("mask").bitwiseAND(s) != 0
        return F.array(*[F.sum(F.when(hit(s), F.col(column)).otherwise(0)) for s in range(whole + 1)])

    parts = cells.groupBy("part").agg(
        F.sum("n").alias("all"), removals("n").alias("v"), *[removals(f"n_{k}").alias(f"v_{k}") for k in counts])
    average = [" + ".join(f"{w} * v[{s}]" for s, w in enumerate(row) if w) for row in shapley_weights(len(names))]
    parts = parts.withColumn("average", F.expr(f"array({', '.join(average)})"))
    steps = []
    for order in permutations(range(len(names))):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append({"o": "".join(names[j] for j in order), "step": step, "i": i, "bit": 1 << i, "before": before})
            before |= 1 << i
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<o: string, step: int, i: int, bit: int, before: int>>")
    each = parts.withColumn("s", F.explode(listed))
    at = lambda v, s: F.get(F.col(v), s)
    before, bit = F.col("s.before"), F.col("s.bit")
    after = before.bitwiseOR(bit)
    removed = lambda v: at(v, after) - at(v, before)
    return each.select(
        "part", F.col("s.o").alias("filter_order"), F.col("s.step").alias("step"),
        (F.col("all") - at("v", after)).alias("kept"), removed("v").alias("removed"),
        (at("v", bit) - removed("v")).alias("redundant"),
        (F.lit(0) + at("v", F.lit(whole)) - at("v", F.lit(whole).bitwiseXOR(bit))).alias("unique_fails"),
        *[removed(f"v_{k}").alias(f"{k}_lost") for k in counts],
        F.get("average", F.col("s.i")).alias("shapley"),
    )


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Stored (id, part, mask) of each document: which of the filters A to E (bits 1 to 16) its whole text fails.

    A: under 50 words. B: under 65 different words of 100. C: over 5 capitals A-Z of 100 characters. D: holds one of #$%&*|.
    E: identical to the text of a smaller id anywhere in the table. Null texts are empty, null parts the empty string. A
    null id is smaller than none and has none smaller; rows of one id and text are no copies of each other.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(given, SEPARATORS), "")
    capitals = F.octet_length(given) - F.octet_length(F.regexp_replace(given, "[A-Z]+", ""))
    n, different = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    bits = {1: n < 50, 2: 100 * different < 65 * n, 4: 100 * capitals.cast("long") > 5 * F.length(given).cast("long"), 8: given.rlike(r"[#$%&*|]")}
    mask = sum((F.when(c, b).otherwise(0) for b, c in bits.items()), F.lit(0))
    own = stored(docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), mask.alias("mask"),
        F.unhex(F.sha2(given, 256)).alias("digest"),
    ), "filter-fails")
    # the smallest id of each text, found again by (text, id), which no group of copies makes hot
    least = own.groupBy(F.col("digest").alias("_digest")).agg(F.min("id").alias("_id")).filter("_id is not null").withColumn("first", F.lit(True))
    marked = own.join(least, (own["digest"] == least["_digest"]) & (own["id"] == least["_id"]), "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return marked.select("id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``interactions`` of the filters of ``failures``, with the documents that labels call good (quality 1) or toxic (1).

    A document without a label, with null labels or a null id counts as neither; of several labels for an id any one is enough.
    """
    known = labels.groupBy(F.col(doc_id).alias("_labelled")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    rows = failures(docs, doc_id, text, part)
    rows = rows.join(known, rows["id"] == known["_labelled"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return interactions(rows, "ABCDE", counts={"good": flag("good"), "toxic": flag("toxic")})
