"""Best-of-group and rank-in-group, safe for groups that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunegauge.operators.quantiles import same
from tunegauge.session import written

#: Rows of groups that are ranked after one shuffle by group, and into how many parts groups are dealt to count them.
HOT_ROWS, BUCKETS = 1_000_000, 4096


def _columns(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group.

    Spark limits every group to ``k`` rows per task before the shuffle, so a hot group costs one sort per map task
    and ships at most ``k`` rows per task. ``order`` must end in a unique key.
    """
    window = Window.partitionBy(*keys).orderBy(*_columns(order))
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= k).drop("_rn")


def rank_per_group(df: DataFrame, keys: list[str], order: list, name: str = "rank", keep: list[str] | None = None) -> DataFrame:
    """Add the position 1.. of each row in its group, by ascending ``order`` expressions that end in a unique key.

    ``keep`` names the columns to carry, all by default: rows are written once, so narrow ones are cheaper. Columns of ``keep``
    that ``order`` gives by name are not carried twice.

    Rows are stored and counted by a hash of their keys. Groups whose hash no more than ``HOT_ROWS`` rows share are ranked
    after one shuffle by group, all others by ``_rank_hot``, so that a group of any size spreads over tasks. NULL keys form a group.
    """
    columns = df.columns if keep is None else list(dict.fromkeys([*keys, *keep]))
    by = [c if isinstance(c, str) and c in columns else f"_o{i}" for i, c in enumerate(order)]
    extra = [c.alias(b) for b, c in zip(by, _columns(order)) if b not in columns]
    rows = df.select(*[F.col(f"`{c}`") for c in columns], *extra)
    if not keys:
        return _rank_hot(rows, keys, by, columns, name)
    stored = written(rows, "ranking")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    counted = stored.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    hot = [r["b"] for r in counted.where(F.col("n") > HOT_ROWS).collect()]  # as many as there are buckets at most
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).alias(name)
    if not hot:
        return stored.select(*columns, place)
    return stored.where(~bucket.isin(hot)).select(*columns, place).union(_rank_hot(stored.where(bucket.isin(hot)), keys, by, columns, name))


def _rank_hot(rows: DataFrame, keys: list[str], by: list[str], columns: list[str], name: str) -> DataFrame:
    """Positions by range-splitting rows on (keys, order): a row's rank is its position in the group's part of a piece plus what
    the group has in the pieces before."""
    spread = written(rows.repartitionByRange(*keys, *by).withColumn("_piece", F.spark_partition_id()), "ranking-pieces")
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    spans = spread.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    # A piece continues at most one group of the piece before, so there are fewer rows than pieces.
    continued = spans.withColumn("_before", F.sum("_n").over(before)).where("_before > 0").select(
        *[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_at"), "_before")
    place = F.row_number().over(Window.partitionBy("_piece", *keys).orderBy(*by))
    ranked = spread.withColumn("_place", place).join(
        F.broadcast(continued), same(keys) & (F.col("_piece") == F.col("_at")), "left")
    return ranked.select(*columns, (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("int").alias(name))
