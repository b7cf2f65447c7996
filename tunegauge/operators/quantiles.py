"""Exact quantiles that do not hold all distinct values of a column in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunegauge.session import written


def same(names: list[str], other: str = "_b"):
    """Join condition: equal values of ``names`` and of the renamed columns ``other``0.., where NULL equals NULL."""
    condition = F.lit(True)
    for i, name in enumerate(names):
        condition = condition & F.col(name).eqNullSafe(F.col(f"{other}{i}"))
    return condition


def exact_percentiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles as (by..., feature, prob, value). NULL and NaN are left out, NULL groups are kept.

    One scan counts the different values of all columns; they are range-split by group, column and value, so that no
    task holds a whole column. Counts per piece say which pieces hold the wanted ranks, and only these are numbered.
    """
    by = by or []
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*by, F.inline(pairs)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    group = [*by, "feature"]
    counted = long.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("m"))
    ranged = written(counted.repartitionByRange(*group, "value").withColumn("piece", F.spark_partition_id()), "quantiles")
    pieces = ranged.groupBy(*group, "piece").agg(F.sum("m").alias("n"))
    whole = Window.partitionBy(*group)
    pieces = pieces.select(
        *group, "piece", "n", (F.sum("n").over(whole.orderBy("piece")) - F.col("n")).alias("before"),
        F.sum("n").over(whole).alias("total"),
    )
    position = F.col("prob") * (F.col("total") - 1)
    wanted = pieces.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")).select(
        *[F.col(c).alias(f"_b{i}") for i, c in enumerate(group)], F.col("piece").alias("_piece"), "before", "n", "prob",
        position.alias("pos"), F.floor(position).alias("lo"), F.ceil(position).alias("hi"),
    ).where((F.col("before") <= F.col("hi")) & (F.col("before") + F.col("n") > F.col("lo")))
    found = ranged.join(wanted, same(group) & (F.col("piece") == F.col("_piece")))
    run = Window.partitionBy(*group, "piece", "prob").orderBy("value")
    found = found.withColumn("start", F.col("before") + F.sum("m").over(run) - F.col("m"))

    def at(rank: str):
        return F.max(F.when((F.col("start") <= F.col(rank)) & (F.col(rank) < F.col("start") + F.col("m")), F.col("value")))

    found = found.groupBy(*group, "prob", "pos", "lo").agg(at("lo").alias("v_lo"), at("hi").alias("v_hi"))
    value = F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("pos") - F.col("lo"))
    return found.select(*group, "prob", value.alias("value"))


def with_percentiles(
    stats: DataFrame, df: DataFrame, column: str, named: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """Add exact quantiles of one column to a small table of statistics with the same groups."""
    by = by or []
    long = exact_percentiles(df, [column], sorted(set(named.values())), by)
    wide = long.groupBy(*by).agg(*[
        F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(n) for n, p in named.items()
    ])
    if by:
        wide = wide.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], *named)
        return stats.join(wide, same(by), "left").select(*stats.columns, *named)
    return stats.select("*", *[wide.select(n).scalar().alias(n) for n in named])


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median per column, as fitted state on the driver (one number per column)."""
    return {r["feature"]: r["value"] for r in exact_percentiles(df, columns, [0.5]).collect()}
