"""Train, validation and test splits as one ``split`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegauge.functions.scalars import text_hash


def random_split(df: DataFrame, key: str, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """Seeded split by the hash of a key: the same rows fall in the same split however the data is partitioned."""
    bucket = text_hash(key, F.lit(seed)) % 10_000
    return df.withColumn(
        "split",
        F.when(bucket < int(test * 10_000), "test").when(bucket < int((val + test) * 10_000), "val").otherwise("train"),
    )


def temporal_split(
    df: DataFrame, train_end: int = 1999, year: str = "album_release_year", missing_year: str = "train"
) -> DataFrame:
    """Train up to ``train_end``, validate the next year, test the year after; later years get no split.

    ``missing_year``: ``train`` puts rows without a year in train, ``drop`` removes them, ``error`` raises.
    """
    if missing_year not in ("train", "drop", "error"):
        raise ValueError(f"unknown missing_year {missing_year}")
    y = F.col(year)
    if missing_year == "error" and not df.where(y.isNull()).isEmpty():
        raise ValueError("rows without a year in a temporal split")
    if missing_year == "drop":
        df = df.where(y.isNotNull())
    return df.withColumn(
        "split",
        F.when(y.isNull() | (y <= train_end), "train").when(y == train_end + 1, "val").when(y == train_end + 2, "test"),
    ).where("split IS NOT NULL")


def check_year_coverage(df: DataFrame, train_end: int, year: str = "album_release_year") -> DataFrame:
    """Raise unless every split holds its own years and none is empty."""
    rows = {
        r["split"]: r
        for r in df.groupBy("split").agg(F.min(year).alias("lo"), F.max(year).alias("hi")).collect()
    }
    wanted = {"train": (None, train_end), "val": (train_end + 1, train_end + 1), "test": (train_end + 2, train_end + 2)}
    for name, (low, high) in wanted.items():
        row = rows.get(name)
        if row is None or row["hi"] is None:
            raise ValueError(f"split {name} is empty")
        if row["hi"] > high or (low is not None and row["lo"] < low):
            raise ValueError(f"split {name} holds years {row['lo']}..{row['hi']}")
    return df


def refit_union(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Train and validation rows as one training set; validation rows weigh 1."""
    return df.where(F.col("split").isin("train", "val")).withColumn(
        weight, F.when(F.col("split") == "val", 1.0).otherwise(F.col(weight))
    )
