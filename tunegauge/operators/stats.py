"""Descriptive statistics: one pass per table, long results."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegauge.functions.scalars import text_hash
from tunegauge.operators.quantiles import exact_percentiles, with_percentiles
from tunegauge.schema import TARGET


def _long(wide: DataFrame, columns: list[str], stats: list[str], name: str = "feature", ids: list[str] | None = None):
    """One row per column from a one-pass aggregate with columns ``<stat>__<column>``."""
    ids = ids or []
    rows = F.array(*[
        F.struct(F.lit(c).alias(name), *[F.col(f"{s}__{c}").alias(s) for s in stats]) for c in columns
    ])
    return wide.select(*ids, F.inline(rows))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std (sample), min, quartiles and max of numeric columns."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [
            F.count(x).alias(f"count__{c}"), F.avg(x).alias(f"mean__{c}"), F.stddev_samp(x).alias(f"std__{c}"),
            F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}"),
        ]
    long = _long(df.agg(*aggs), columns, ["count", "mean", "std", "min", "max"])
    quartiles = exact_percentiles(df, columns, [0.25, 0.5, 0.75]).groupBy("feature").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
        for n, p in [("q25", 0.25), ("q50", 0.5), ("q75", 0.75)]
    ])
    return long.join(quartiles, "feature", "left")


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n) of columns as text: values are counted before anything is shuffled."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns
    ]))
    return df.select(pairs.alias("p")).select("p.*").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def describe_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, unique, top and freq of text or flag columns; the smallest value wins a tie for top."""
    present = value_frequencies(df, columns).where("value IS NOT NULL")
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value")))
    return present.groupBy("feature").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("b")
    ).select("feature", "count", "unique", F.col("b.value").alias("top"), (-F.col("b.neg")).alias("freq"))


def missing_summary(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Missing values and their share per column, in one pass."""
    by = by or []
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"n_missing__{c}"))
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    for c in columns:
        wide = wide.withColumn(f"pct_missing__{c}", F.col(f"n_missing__{c}") * 100.0 / F.col("_rows"))
    return _long(wide, columns, ["n_missing", "pct_missing"], "feature", by)


def cardinality(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values with NULL as one value, and their share of all rows.

    The exact form counts values per column first (map-side), then counts the counts, so one column does not expand
    another. ``approximate=True`` uses HyperLogLog sketches in a single pass.
    """
    if approximate:
        aggs = [F.count(F.lit(1)).alias("_rows")]
        for c in columns:
            has_null = F.max(F.col(c).isNull().cast("int"))
            aggs.append((F.approx_count_distinct(c) + has_null).alias(f"n_unique__{c}"))
        wide = df.agg(*aggs)
        for c in columns:
            wide = wide.withColumn(f"unique_ratio__{c}", F.col(f"n_unique__{c}") / F.col("_rows"))
        return _long(wide, columns, ["n_unique", "unique_ratio"])
    return value_frequencies(df, columns).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_unique"), (F.count(F.lit(1)) / F.sum("n")).alias("unique_ratio")
    )


def duplicated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """Duplicated whole rows and duplicated keys."""
    whole = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    # the whole-row counts already hold every key, so the key counts start from them
    by_key = whole.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("row_copies"))
    return by_key.agg(
        F.sum("n").alias("n_rows"), F.sum("row_copies").alias("n_row_duplicates"),
        F.sum(F.col("n") - 1).alias("n_key_duplicates"), F.count_if(F.col("n") > 1).alias("n_duplicated_keys"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and share of all rows in percent."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def date_grain(date: Column) -> Column:
    return (
        F.when(date == "0000", "0000").when(date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "YYYY-MM-DD")
        .when(date.rlike("^[0-9]{4}-[0-9]{2}$"), "YYYY-MM").when(date.rlike("^[0-9]{4}$"), "YYYY").otherwise("other")
    )


def date_format_census(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(date_grain(F.col(column)).alias("grain")).agg(F.count(F.lit(1)).alias("n"))


def target_summary(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Shape of a zero-inflated target; quantiles are exact (the target has at most 101 distinct values)."""
    y = F.col(target).cast("double")
    positive = F.when(y > 0, y)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(y.isNull()).alias("n_missing"),
        F.count_distinct(y).alias("n_unique"), F.min(y).alias("min"), F.max(y).alias("max"), F.avg(y).alias("mean"),
        F.avg((y == 0).cast("double")).alias("zero_rate"), F.percentile(y, 0.25).alias("q25"),
        F.percentile(y, 0.5).alias("median"), F.percentile(y, 0.75).alias("q75"),
        F.avg(positive).alias("mean_positive"), F.percentile(positive, 0.5).alias("median_positive"),
    )


def target_correlations(df: DataFrame, columns: list[str], target: str = TARGET) -> DataFrame:
    """Pearson correlation of every feature with the target, in one pass."""
    y = F.col(target).cast("double")
    wide = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(f"corr__{c}") for c in columns])
    return _long(wide, columns, ["corr"])


def correlation_pairs(df: DataFrame, columns: list[str], min_abs: float = 0.0) -> DataFrame:
    """Upper triangle of the correlation matrix as (feature_1, feature_2, corr), one row per column pair.

    A pair counts the rows in which neither column is missing. One pass takes the means; in a second one tasks take products
    about them, by blocks of rows, so the plan stays small for many columns; a task passes on a row per pair and block. A
    constant column has no correlation.
    """
    size = len(columns)
    first, second = np.triu_indices(size, 1)
    names = ["pair", "n", "x", "y", "xx", "yy", "xy"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.float64)
            there = ~np.isnan(raw)
            x, m = np.where(there, raw - means, 0.0), there.astype(np.float64)
            n, sx, sxx, sxy = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
            at = (first, second)
            values = [n[at], sx[at], sx.T[at], sxx[at], sxx.T[at], sxy[at]]
            some = values[0] > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(some), pa.int64()), *(pa.array(v[some]) for v in values)], names=names)

    rows = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    means = np.array([x or 0.0 for x in rows.agg(*[F.avg(c) for c in rows.columns]).first()])
    blocks = rows.mapInArrow(partial, "pair long, " + ", ".join(f"{c} double" for c in names[1:]))
    about = lambda product, a, b: F.sum(product) - F.sum(a) * F.sum(b) / F.sum("n")
    sums = blocks.groupBy("pair").agg(about("xx", "x", "x").alias("xx"), about("yy", "y", "y").alias("yy"), about("xy", "x", "y").alias("xy"))
    corr = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    listed = F.array(*[F.lit(c) for c in columns])
    at = lambda numbers: F.get(listed, F.get(F.lit([int(i) for i in numbers]), F.col("pair").cast("int")))
    out = sums.select(at(first).alias("feature_1"), at(second).alias("feature_2"), corr.alias("corr"))
    return out.where(F.abs("corr") >= min_abs)


def split_summary(df: DataFrame, year: str = "album_release_year", target: str = TARGET) -> DataFrame:
    y, t = F.col(year), F.col(target).cast("double")
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns) - 1).alias("n_cols"),
        F.min(y).cast("int").alias("year_min"), F.max(y).cast("int").alias("year_max"),
        (F.avg(y.isNull().cast("double")) * 100).alias("year_missing_pct"), F.avg(t).alias("target_mean"),
        F.percentile(t, 0.5).alias("target_median"), F.avg((t == 0).cast("double")).alias("zero_rate"),
    )


def flag_counts(df: DataFrame, flag: str = "release_year_missing_or_suspect", year: str = "album_release_year"):
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(flag)).alias("flagged_rows"),
        (F.avg(F.col(flag).cast("double")) * 100).alias("flagged_pct"),
        F.count_if(F.col(year).isNull()).alias("missing_year_rows"),
        (F.avg(F.col(year).isNull().cast("double")) * 100).alias("missing_year_pct"),
    )


def content_hash(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Hash of a frame that does not depend on row order or partitioning. NULL counts as a value of its column."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(text_hash(*(columns or df.columns)).cast("decimal(38,0)")).cast("string").alias("content_hash"),
    )


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width counts over [low, high]; the top edge belongs to the last bin, values outside to 0 and bins+1."""
    x = F.col(column).cast("double")
    bucket = F.when(x == high, bins).otherwise(F.width_bucket(x, F.lit(low), F.lit(high), F.lit(bins)))
    return df.where(x.isNotNull()).groupBy(bucket.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_numbers(df: DataFrame, column: str, by: str) -> DataFrame:
    x = F.col(column).cast("double")
    ends = df.groupBy(by).agg(F.min(x).alias("low"), F.max(x).alias("high"))
    return with_percentiles(ends, df, column, {"q25": 0.25, "median": 0.5, "q75": 0.75}, [by])


def coverage(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Share of rows that pass each named check: (check, n_rows, n_hit, hit_pct), one pass."""
    wide = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(cond).alias(f"n_hit__{n}") for n, cond in checks.items()]
    )
    out = _long(wide, list(checks), ["n_hit"], "check", ["n_rows"])
    return out.withColumn("hit_pct", F.col("n_hit") * 100.0 / F.col("n_rows"))


def coverage_by(df: DataFrame, by: str, tags: str, markets: str) -> DataFrame:
    """Per group: rows, tags per row (none where unknown), share of rows with tags, mean number of markets."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col(tags), F.lit(0))).alias("tags_per_track"),
        (F.avg(F.col(tags).isNotNull().cast("double")) * 100).alias("tagged_pct"), F.avg(markets).alias("mean_markets"))


def dtype_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, dtype, n_rows, n_missing) of the columns of a table, one pass."""
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_missing__{c}") for c in columns])
    types = dict(df.dtypes)
    kinds = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    out = _long(wide, columns, ["n_missing"], "name", ["n_rows"])
    return out.select("name", F.element_at(kinds, F.col("name")).alias("dtype"), "n_rows", "n_missing")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Stack result tables by column name; columns absent somewhere are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
