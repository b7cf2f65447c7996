"""Linear models of many groups, weightings and feature sets from one scan.

The weighted sums of products of all inputs and the target (the Gram matrix) settle every least-squares fit on any subset of the
inputs. They are one aggregate with partial sums per group; each group is a row, and each row is solved for itself. A fitted
model is a row too, (group..., feature_set, n, intercept, coefficients), so that models are scored by a join, saved as a
table, and read by a stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunegauge.session import written

ALL = "all"


def products(
    rows: DataFrame, columns: list[str], by: list[str], y: str = "y", weight: str | Column | None = None,
    shift: dict[str, float] | None = None,
) -> DataFrame:
    """(by..., n, sums): per group the upper triangle, row by row, of the weighted products of [1, columns..., y].

    ``shift`` is taken from the inputs before, which keeps sums of large values exact; medians or means do. Rows with a NULL
    or NaN input, target or weight are left out.
    """
    shift = shift or {}
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    value = lambda c: F.col(c).cast("double") - F.lit(float(shift.get(c, 0.0)))
    named = {f"_x{i}": value(c) for i, c in enumerate([*columns, y], 1)}
    shown = rows.select(*by, F.lit(1.0).alias("_x0"), w.alias("_w"), *[x.alias(n) for n, x in named.items()])
    usable = shown.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ["_w", *named]))
    names = ["_x0", *named]
    sums = [F.sum(F.col("_w") * F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    return usable.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("sums"))


def solved(matrix: np.ndarray, chosen: list[int], ridge: float = 0.0) -> tuple[float, np.ndarray]:
    """Intercept and coefficients (0 where not chosen) for a full matrix of products; the smallest solution where several fit.

    ``ridge`` times the sum of weights is added to the diagonal of the inputs, not of the intercept.
    """
    at = [0, *(i + 1 for i in chosen)]
    left, right = matrix[np.ix_(at, at)].copy(), matrix[at, -1]
    left[np.arange(1, len(at)), np.arange(1, len(at))] += ridge * matrix[0, 0]
    scale = np.sqrt(np.where(np.diag(left) > 0, np.diag(left), 1.0))
    found = np.linalg.lstsq(left / np.outer(scale, scale), right / scale, rcond=1e-13)[0] / scale
    coefficients = np.zeros(len(matrix) - 2)
    coefficients[chosen] = found[1:]
    return float(found[0]), coefficients


def fit_groups(
    train: DataFrame, columns: list[str], by: list[str] | None = None, y: str = "y", weight: str | Column | None = None,
    feature_sets: dict[str, list[str]] | None = None, ridge: float = 0.0, shift: dict[str, float] | None = None,
) -> DataFrame:
    """One linear model per group and feature set: (by..., feature_set, n, intercept, coefficients), stored.

    Coefficients follow ``columns``, with 0 for columns outside the set. Without sets there is one, of all columns. A NULL
    group is a group. No rows give no models.
    """
    by, sets = by or [], feature_sets or {ALL: columns}
    chosen = {name: [columns.index(c) for c in used] for name, used in sets.items()}
    size, offsets = len(columns) + 2, np.array([float((shift or {}).get(c, 0.0)) for c in columns])
    base = float((shift or {}).get(y, 0.0))
    grams = products(train, columns, by, y, weight, shift).where("n > 0")
    schema = T.StructType([
        *[grams.schema[c] for c in by], T.StructField("feature_set", T.StringType()), T.StructField("n", T.LongType()),
        T.StructField("intercept", T.DoubleType()), T.StructField("coefficients", T.ArrayType(T.DoubleType()))])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, names, intercepts, found = [], [], [], []
            for row, sums in enumerate(batch.column("sums").to_pylist()):
                matrix = np.zeros((size, size))
                matrix[np.triu_indices(size)] = sums
                matrix = np.triu(matrix) + np.triu(matrix, 1).T
                for name, used in chosen.items():
                    intercept, coefficients = solved(matrix, used, ridge)
                    at.append(row)
                    names.append(name)
                    intercepts.append(intercept + base - float(coefficients @ offsets))
                    found.append(coefficients.tolist())
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(rows) for c in by), pa.array(names), batch.column("n").take(rows),
                 pa.array(intercepts, pa.float64()), pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return written(grams.mapInArrow(solve, schema), "linear-models")


def forecast(columns: list[str]) -> Column:
    """Forecast of joined models: the intercept plus the products of ``columns`` and ``coefficients``."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return F.aggregate(F.zip_with(values, F.col("coefficients"), lambda x, a: x * a), F.col("intercept"), lambda s, p: s + p)


def score_groups(rows: DataFrame, models: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``rows`` with ``pred`` of their group's model; NULL where the group has none. The models must have one set per group."""
    own = models.select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(by)], "intercept", "coefficients")
    same = [F.col(c).eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate(by)]
    return rows.join(own, same, "left").withColumn("pred", forecast(columns)).drop(
        "intercept", "coefficients", *[f"_m{i}" for i in range(len(by))])


def score_sets(rows: DataFrame, models: DataFrame, columns: list[str], names: list[str], column: str = "feature_set") -> DataFrame:
    """A row per row and model, models told apart by ``column``; the rows are read once."""
    each = rows.withColumn("model", F.explode(F.array(*[F.lit(n) for n in names])))
    return score_groups(each, models.withColumnRenamed(column, "model"), columns, ["model"])


def contributions(rows: DataFrame, columns: list[str], means: dict[str, float]) -> DataFrame:
    """``base`` and ``c_<feature>`` of joined models: coefficient * (value - mean), which add up to the forecast."""
    at = {c: F.get(F.col("coefficients"), F.lit(i)) for i, c in enumerate(columns)}
    mean = lambda c: F.lit(float(means[c]))
    base = F.col("intercept")
    for c in columns:
        base = base + at[c] * mean(c)
    return rows.withColumns({"base": base, **{f"c_{c}": at[c] * (F.col(c).cast("double") - mean(c)) for c in columns}})


def save_groups(models: DataFrame, columns: list[str], path: str, version: str, **facts) -> None:
    """A version of a model table with its feature list and facts of the run; an older version stays."""
    models.write.mode("overwrite").parquet(f"{path}/{version}/models")
    row = json.dumps({"version": version, "columns": columns, **facts})
    models.sparkSession.createDataFrame([(row,)], "value string").write.mode("overwrite").text(f"{path}/{version}/metadata")


def load_groups(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, dict]:
    """(models with column ``version``, metadata). A version that was never saved in full raises."""
    try:
        facts = json.loads(spark.read.text(f"{path}/{version}/metadata").first()["value"])
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise ValueError(f"no saved models of version {version} at {path}") from error
        raise
    return spark.read.parquet(f"{path}/{version}/models").withColumn("version", F.lit(facts["version"])), facts
