"""Field-by-field comparison of two result tables, with severities and a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How serious a difference in a field is.
CRITICAL = [
    "success", "title", "artist", "album", "original_release_year", "rb_track_id", "rb_artist_id", "isrc",
    "is_artist_only_fallback", "rescue_source", "rescue_match_quality", "rescue_track_type", "audio_features_keys",
    "collaborator_keys",
]
WARNING = ["real_market_popularity", "raw_alternatives_count", "is_partial", "payload_keys"]
INFO = ["backend_execution_time", "measured_elapsed_seconds"]
SEVERITY = {f: "critical" for f in CRITICAL} | {f: "warning" for f in WARNING} | {f: "info" for f in INFO}


def full_outer_compare(
    baseline: DataFrame, current: DataFrame, keys: list[str], severity: dict[str, str] | None = None,
    check_duplicates: bool = True,
) -> DataFrame:
    """(keys..., kind, field, severity, baseline, current), one row per difference.

    A case missing from the current run is critical, an extra case a warning. Values are compared as text and
    null-safe. One shuffle per side; the fields of a case are unfolded only after the join. A repeated case fails the
    job that reads the result, or counts as any one of its rows without ``check_duplicates``.
    """
    levels = severity or SEVERITY
    fields = [f for f in levels if f in baseline.columns and f in current.columns]

    def packed(df: DataFrame, name: str, what: str) -> DataFrame:
        values = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
        cases = df.groupBy(*keys).agg(F.max(values).alias(name), F.count(F.lit(1)).alias("n"))
        if not check_duplicates:
            return cases.drop("n")
        fault = F.concat(F.lit(f"duplicate case in {what}: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
        return cases.select(*keys, F.when(F.col("n") > 1, F.raise_error(fault)).otherwise(F.col(name)).alias(name))

    joined = packed(baseline, "b", "baseline").join(packed(current, "c", "current"), keys, "full_outer")
    both = F.col("b").isNotNull() & F.col("c").isNotNull()

    def entry(kind, field, level, old, new):
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(field).alias("field"), F.lit(level).alias("severity"),
            old.cast("string").alias("baseline"), new.cast("string").alias("current"))

    nothing = F.lit(None)
    entries = [
        F.when(F.col("c").isNull(), entry("missing_case", "", "critical", nothing, nothing)),
        F.when(F.col("b").isNull(), entry("extra_case", "", "warning", nothing, nothing)),
    ] + [
        F.when(both & ~F.equal_null(F.col("b")[f], F.col("c")[f]), entry("changed", f, levels[f], F.col("b")[f], F.col("c")[f]))
        for f in fields
    ]
    return joined.select(*keys, F.inline(F.array_compact(F.array(*entries))))


def verdict(differences: DataFrame) -> DataFrame:
    """Counts per severity and the overall verdict in one row."""
    counts = differences.agg(*[
        F.count_if(F.col("severity") == level).alias(level) for level in ("critical", "warning", "info")
    ])
    return counts.withColumn(
        "verdict", F.when(F.col("critical") > 0, "failed").when(F.col("warning") > 0, "passed with warnings")
        .otherwise("passed"))
