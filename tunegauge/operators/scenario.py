"""What-if grids over tracks: short literal lists of overrides, unfolded in place without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Audience tiers of the sandbox.
TIERS = {
    "Cold Start": {"real_market_popularity": 25.0, "listeners_log": 5.0},
    "Tipping Point": {"real_market_popularity": 60.0, "listeners_log": 11.0},
    "Mainstream": {"real_market_popularity": 85.0, "listeners_log": 16.0},
}


def scenario_grid(df: DataFrame, scenarios: dict[str, dict[str, float]]) -> DataFrame:
    """Every row under every scenario; a scenario overrides some columns, the others keep the row's value."""
    fields = sorted({f for overrides in scenarios.values() for f in overrides})
    grid = F.array(*[
        F.struct(F.lit(name).alias("scenario"), *[
            F.lit(overrides.get(f)).cast("double").alias(f"_{f}") for f in fields
        ]) for name, overrides in scenarios.items()
    ])
    unfolded = df.select("*", F.inline(grid))
    changed = {f: F.coalesce(F.col(f"_{f}"), F.col(f).cast("double")) if f in df.columns else F.col(f"_{f}") for f in fields}
    return unfolded.withColumns(changed).drop(*[f"_{f}" for f in fields])


def scenario_features(
    df: DataFrame, required: list[str], keep: list[str], ignore_tags: bool = False, fill: str = "median",
    medians: dict[str, float] | None = None,
) -> DataFrame:
    """The model's feature row, in order. Tag columns are 0 when tags are ignored.

    A required feature that is absent takes the training median (``fill="median"``) or 0 (``fill="zero"``).
    """
    if fill not in ("median", "zero"):
        raise ValueError("fill must be 'median' or 'zero'")
    columns = []
    for name in required:
        spare = F.lit(float((medians or {}).get(name, 0.0) if fill == "median" else 0.0))
        if name.startswith("tag_"):
            value = F.lit(0.0) if ignore_tags or name not in df.columns else F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        else:
            value = F.coalesce(F.col(name).cast("double"), spare) if name in df.columns else spare
        columns.append(value.alias(name))
    return df.select(*keep, *columns)


def active_importances(df: DataFrame, key: str, importances: dict[str, float]) -> DataFrame:
    """(key, feature, importance) of the features that are positive in a row."""
    rows = F.array(*[
        F.when(F.col(c).cast("double") > 0, F.struct(F.lit(c).alias("feature"), F.lit(float(w)).alias("importance")))
        for c, w in importances.items()
    ])
    return df.select(key, F.inline(F.array_compact(rows)))
