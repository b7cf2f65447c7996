"""Zero-aware evaluation of forecasts: global, segmented, binned and per regime; rankings of results.

Frames hold the actual score in ``y`` and the forecast in ``pred``. Every metric is one aggregate with map-side
partial sums, so no group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunegauge.functions.scalars import clip_0_100
from tunegauge.operators.quantiles import with_percentiles
from tunegauge.operators.ranking import top_per_group

# Right-closed bins of the true score.
BIN_EDGES = [(0, 5), (5, 20), (20, 40), (40, 60), (60, 80), (80, 100)]


def actual() -> Column:
    return F.col("y")


def forecast() -> Column:
    return F.col("pred")


def abs_error() -> Column:
    return F.abs(F.col("y") - F.col("pred"))


def regression_metrics() -> list[Column]:
    """MAE, RMSE and R2 (NULL when the actual score is constant), in one pass."""
    error2 = (actual() - forecast()) * (actual() - forecast())
    spread = F.var_pop(actual())
    return [
        F.avg(abs_error()).alias("mae"),
        F.sqrt(F.avg(error2)).alias("rmse"),
        F.when(spread > 0, 1 - F.avg(error2) / spread).alias("r2"),
    ]


def segmented_metrics() -> list[Column]:
    error = abs_error()
    return [
        F.avg(F.when(actual() == 0, error)).alias("mae_zero"),
        F.avg(F.when(actual() != 0, error)).alias("mae_pos"),
        (F.avg((actual() == 0).cast("double")) * 100).alias("pct_zero_true"),
        (F.avg((forecast() == 0).cast("double")) * 100).alias("pred_zero_pct"),
    ]


def full_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *regression_metrics(), *segmented_metrics()
    )


def clip_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Forecasts as they are and clipped to 0..100, side by side."""
    clipped = clip_0_100(forecast())
    return df.groupBy(*by).agg(
        F.avg(F.abs(actual() - forecast())).alias("mae_raw"), F.avg(F.abs(actual() - clipped)).alias("mae_clip"),
        F.min(forecast()).alias("min_raw"), F.max(forecast()).alias("max_raw"), F.avg(forecast()).alias("mean_raw"),
        F.min(clipped).alias("min_clip"), F.max(clipped).alias("max_clip"), F.avg(clipped).alias("mean_clip"),
    )


def binned_mae(df: DataFrame) -> DataFrame:
    """MAE per bin of the true score; empty bins appear with n = 0."""
    aggs = []
    for low, high in BIN_EDGES:
        inside = (actual() <= high) & ((actual() >= low) if low == 0 else (actual() > low))
        aggs += [F.count_if(inside).alias(f"n_{high}"), F.avg(F.when(inside, abs_error())).alias(f"mae_{high}")]
    rows = F.array(*[
        F.struct(
            F.lit(f"{'[' if low == 0 else '('}{low},{high}]").alias("bin"), F.col(f"n_{high}").alias("n"),
            F.col(f"mae_{high}").alias("mae"),
        ) for low, high in BIN_EDGES
    ])
    return df.agg(*aggs).select(F.inline(rows))


def mae_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.avg(abs_error()).alias("mae"))


def residual_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Residual (actual - forecast): mean, median, sample std, min, max."""
    with_residual = df.withColumn("residual", actual() - forecast())
    r = F.col("residual")
    stats = with_residual.groupBy(*by).agg(
        F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.min(r).alias("min"), F.max(r).alias("max")
    )
    return with_percentiles(stats, with_residual, "residual", {"median": 0.5}, by)


def percentile_summary(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    x = F.col(column)
    stats = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    named = {"p0": 0.0, "p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    return with_percentiles(stats, df, column, named, by)


def share_of_total(df: DataFrame, value: str, name: str = "share_pct") -> DataFrame:
    """Share of each row of a small result table in the total."""
    return df.withColumn(name, F.col(value) * 100.0 / F.sum(value).over(Window.partitionBy()))


def regime_mae(df: DataFrame) -> DataFrame:
    """MAE, tracks and share per regime. At most four rows reach the window."""
    grouped = df.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg(abs_error()).alias("mae"), F.sum(abs_error()).alias("_sum"))
    whole = Window.partitionBy()
    return share_of_total(grouped, "n").withColumn(
        "global_mae", F.sum("_sum").over(whole) / F.sum("n").over(whole)
    ).drop("_sum")


def regime_bias(df: DataFrame) -> DataFrame:
    """Size and direction (forecast - actual) of the error per regime."""
    return df.groupBy("regime").agg(
        F.avg(abs_error()).alias("mae"), F.avg(forecast() - actual()).alias("bias"),
        (F.avg((forecast() > actual()).cast("double")) * 100).alias("pct_over"),
    )


def hits_zeros_report(df: DataFrame) -> DataFrame:
    hit, zero = actual() > 0, actual() == 0
    return df.agg(
        F.avg(abs_error()).alias("mae"), F.avg(F.when(hit, abs_error())).alias("mae_hits"), F.count_if(hit).alias("n_hits"),
        F.avg(F.when(zero, abs_error())).alias("mae_zeros"), F.count_if(zero).alias("n_zeros"),
        F.avg(F.when(hit, forecast())).alias("mean_pred_hits"), F.avg(F.when(zero, forecast())).alias("mean_pred_zeros"),
    )


def segment_profile(df: DataFrame, features: list[str], severe: Column) -> DataFrame:
    """Mean of features for severe misses and for the rest, and the difference in percent."""
    wide = df.agg(*[F.avg(F.when(severe, F.col(c))).alias(f"s_{c}") for c in features],
                  *[F.avg(F.when(~severe, F.col(c))).alias(f"n_{c}") for c in features])
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"s_{c}").alias("severe_mean"), F.col(f"n_{c}").alias("normal_mean"))
        for c in features
    ])
    delta = (F.col("severe_mean") - F.col("normal_mean")) * 100.0 / F.nullif(F.abs("normal_mean"), F.lit(0.0))
    return wide.select(F.inline(rows)).withColumn("delta_pct", delta)


def tag_prevalence(df: DataFrame, candidates: list[str], severe: Column, top_n: int = 5) -> DataFrame:
    """Share of tagged tracks among severe misses and the rest, the ``top_n`` tags of either segment.

    Only columns that are truly binary among severe misses (min 0, max 1) count. One pass over the data.
    """
    segments = {"severe": severe, "normal": ~severe}
    aggs = []
    for c in candidates:
        x = F.col(c).cast("double")
        aggs += [F.min(F.when(severe, x)).alias(f"lo_{c}"), F.max(F.when(severe, x)).alias(f"hi_{c}")]
        aggs += [F.avg(F.when(cond, x)).alias(f"{s}_{c}") for s, cond in segments.items()]
    aggs += [F.avg(F.when(cond, F.col("total_available_markets"))).alias(f"m_{s}") for s, cond in segments.items()]
    rows = F.array(*[
        F.struct(
            F.lit(s).alias("segment"), F.lit(c.removeprefix("tag_")).alias("tag"),
            (F.col(f"{s}_{c}") * 100).alias("pct"), F.col(f"m_{s}").alias("mean_markets"),
            ((F.col(f"lo_{c}") == 0) & (F.col(f"hi_{c}") == 1)).alias("_binary"),
        ) for s in segments for c in candidates
    ])
    long = df.agg(*aggs).select(F.inline(rows)).where("_binary").drop("_binary")
    return top_per_group(long, ["segment"], [F.col("pct").desc(), "tag"], top_n)


def crosstab_pct(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Row-normalised percentages; ``values`` fixes the columns."""
    shares = [
        (F.count_if(F.col(column) == v) * 100.0 / F.count(column)).alias(v.lower().replace(" ", "_")) for v in values
    ]
    return df.groupBy(row).agg(*shares)


def leaderboard_pivot(long: DataFrame, index: list[str], column: str, values: list[str], metric: str) -> DataFrame:
    """Metric table with one column per subset; the smallest metric wins should a cell repeat."""
    return long.groupBy(*index).pivot(column, values).agg(F.min(metric))


def importance_by_source(df: DataFrame) -> DataFrame:
    return share_of_total(df.groupBy("source").agg(F.sum("importance").alias("importance")), "importance")


def pair_share(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """Share of total, size relative to the top and running share of (feature_1, feature_2, magnitude) pairs.

    The table has one row per pair of columns, so a single window is fine.
    """
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("magnitude").desc(), "feature_1", "feature_2")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = share_of_total(pairs, "magnitude").withColumn(
        "relative_to_top", F.col("magnitude") * 100.0 / F.max("magnitude").over(whole)
    )
    out = out.withColumn("cumulative_pct", F.sum("share_pct").over(running)).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k else out


def attribution_by_regime(df: DataFrame, contributions: list[str], top_n: int = 10) -> DataFrame:
    """Mean absolute contribution per feature and regime, the ``top_n`` of each regime."""
    wide = df.groupBy("regime").agg(*[F.avg(F.abs(F.col(c))).alias(c) for c in contributions])
    long = wide.unpivot(["regime"], contributions, "feature", "mean_abs")
    window = Window.partitionBy("regime").orderBy(F.col("mean_abs").desc(), "feature")
    return long.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top_n)


def regime_thresholds(df: DataFrame, cluster: str, feature: str) -> DataFrame:
    """Upper edge of a feature per cluster, clusters ordered by the mean; the last cluster has no upper edge."""
    stats = df.groupBy(cluster).agg(F.avg(feature).alias("mean"), F.max(feature).alias("upper_edge"))
    order = Window.orderBy("mean", cluster)  # one row per cluster
    ranked = stats.withColumn("level", F.row_number().over(order)).withColumn(
        "_last", F.count(F.lit(1)).over(Window.partitionBy())
    )
    return ranked.where(F.col("level") < F.col("_last")).select(
        cluster, "level", "mean", F.bround("upper_edge", 2).alias("threshold")
    )


def cluster_profile(df: DataFrame, cluster: str, listeners: str, target: str) -> DataFrame:
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), F.avg(listeners).alias("mean_listeners"), F.min(listeners).alias("min_listeners"),
        F.max(listeners).alias("max_listeners"), F.avg(target).alias("mean_target"),
    )


def model_rank(metrics: DataFrame, by: list[str], metric: str = "mae") -> DataFrame:
    """Rank models by a metric within each subset; one row per model and subset."""
    return metrics.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(metric, "model")))


def champion_select(results: DataFrame, clip: bool) -> DataFrame:
    """Best refitted baseline against best refitted challenger within one clip mode.

    ``results`` has (tag, mae_val, mae_test); refitted runs have no validation error.
    """
    tag = F.col("tag")
    mode = tag.contains("clip") if clip else ~tag.contains("clip")
    baseline = F.lower(tag).contains("baseline")
    key, tested = F.struct("mae_test", "tag"), F.col("mae_test").isNotNull()
    best = results.where(mode & F.col("mae_val").isNull()).agg(
        F.min(F.when(baseline & tested, key)).alias("b"), F.min(F.when(~baseline & tested, key)).alias("c")
    ).where("c IS NOT NULL")
    gap = F.col("c.mae_test") - F.col("b.mae_test")
    return best.select(
        F.lit("clip" if clip else "raw").alias("mode"), F.coalesce("b.tag", F.lit("none")).alias("baseline_tag"),
        F.col("b.mae_test").alias("baseline_test"), F.col("c.tag").alias("best_tag"),
        F.col("c.mae_test").alias("best_test"), gap.alias("gap"),
        F.when(F.coalesce(gap < 0, F.lit(True)), F.col("c.tag")).otherwise(F.col("b.tag")).alias("champion"),
    )


def threshold_sweep(scored: DataFrame, thresholds: list[float], by: list[str]) -> DataFrame:
    """Metrics of the zero rule ``p_zero >= threshold`` for many thresholds, from one scored frame.

    The grid is a short literal list, expanded in place, and partial sums shrink it before the shuffle.
    """
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    expanded = scored.select("*", grid).withColumn(
        "pred", F.when(F.col("p_zero") >= F.col("threshold"), 0.0).otherwise(F.col("pred_positive"))
    )
    return full_metrics(expanded, [*by, "threshold"])


def guardrail_pick(sweep: DataFrame, min_zero_pct: float) -> DataFrame:
    """The threshold with the least error among those that predict enough zeros."""
    return sweep.where(F.col("pred_zero_pct") >= min_zero_pct).agg(
        F.min(F.struct("mae", "threshold", "pred_zero_pct")).alias("b")
    ).select("b.threshold", "b.mae", "b.pred_zero_pct")


def worst_misses(df: DataFrame, k: int = 10) -> DataFrame:
    return df.withColumn("abs_error", abs_error()).orderBy(F.col("abs_error").desc(), "row_key").limit(k)


def emblematic_cases(df: DataFrame) -> DataFrame:
    """Three telling rows: predicted hit, largest error, silent artist; each with its fallback.

    Per case the rows are ranked by (priority, own order); aggregates keep one candidate per task, so nothing is
    sorted globally. Columns: row_key, y, pred, listeners_log.
    """
    row = F.struct("row_key", "y", "pred", "listeners_log", abs_error().alias("abs_error")).alias("row")
    hit = F.min(F.when(forecast() >= 70, F.struct(F.lit(1), abs_error(), "row_key", row)).when(
        actual() > 70, F.struct(F.lit(2), abs_error(), "row_key", row)))
    worst = F.min(F.struct((-abs_error()).alias("o"), "row_key", row))
    largest = df.agg(worst.alias("w")).select("w.row_key").scalar()
    quiet = (actual() > 10) & (F.col("listeners_log") <= 0.1) & (F.col("row_key") != largest)
    silent = F.min(F.when(quiet, F.struct((-actual()).alias("o"), "row_key", row)))
    found = df.agg(hit.alias("hit"), worst.alias("worst"), silent.alias("silent"))
    cases = found.select(F.inline(F.array(
        F.struct(F.lit("predicted_hit").alias("case"), F.col("hit")["row"].alias("r")),
        F.struct(F.lit("largest_error").alias("case"), F.col("worst")["row"].alias("r")),
        F.struct(F.lit("silent_artist").alias("case"), F.col("silent")["row"].alias("r")),
    )))
    # fallback of the third case: the best score among the five rows with fewest listeners
    lowest = df.withColumn("abs_error", abs_error()).orderBy(F.col("listeners_log").asc_nulls_last(), "row_key").limit(5)
    spare = lowest.agg(F.min(F.struct((-actual()).alias("o"), "row_key", F.struct(
        "row_key", "y", "pred", "listeners_log", "abs_error").alias("row"))).alias("s")).select("s.row").scalar()
    r = F.when(F.col("r").isNull() & (F.col("case") == "silent_artist"), spare).otherwise(F.col("r"))
    return cases.select("case", r.alias("r")).where("r IS NOT NULL").select("case", "r.*")
