"""Set operations on result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegauge.operators.ranking import top_per_group


def keep_first_or_last(df: DataFrame, key: str, sequence: str, keep: str = "first") -> DataFrame:
    """One row per key: the first or the last appended, by an explicit unique sequence column."""
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    order = F.col(sequence).asc() if keep == "first" else F.col(sequence).desc()
    return top_per_group(df, [key], [order])


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position of their first appearance."""
    return df.groupBy(value).agg(F.min(position).alias("first_position"))


def key_sets(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with where they occur: only in the baseline, only in the current table, or in both.

    One shuffle over both tables instead of one per set operation.
    """
    tagged = baseline.select(*keys, F.lit(1).alias("_b"), F.lit(0).alias("_c")).unionByName(
        current.select(*keys, F.lit(0).alias("_b"), F.lit(1).alias("_c"))
    )
    place = F.when((F.max("_b") == 1) & (F.max("_c") == 1), "both").when(F.max("_b") == 1, "only_baseline")
    return tagged.groupBy(*keys).agg(place.otherwise("only_current").alias("place"))
