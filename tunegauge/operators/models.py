"""Regressors on Spark ML behind one small protocol: fit on training rows, score any rows, one metrics pass."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunegauge.functions.scalars import clip_0_100, regime_id
from tunegauge.operators import gram
from tunegauge.operators.evaluate import full_metrics, regression_metrics
from tunegauge.operators.features import MedianImputer
from tunegauge.session import written

FEATURES = "features"


def linear(weight: str | None = None, **params) -> Estimator:
    return _weighted(LinearRegression(
        featuresCol=FEATURES, labelCol="y", predictionCol="pred", solver="normal", **params), weight)


def huber(weight: str | None = None, epsilon: float = 1.35, reg: float = 1e-4, **params) -> Estimator:
    return _weighted(LinearRegression(
        featuresCol=FEATURES, labelCol="y", predictionCol="pred", loss="huber", epsilon=epsilon, regParam=reg, **params
    ), weight)


def forest(weight: str | None = None, trees: int = 20, depth: int = 8, seed: int = 42, **params) -> Estimator:
    return _weighted(RandomForestRegressor(
        featuresCol=FEATURES, labelCol="y", predictionCol="pred", numTrees=trees, maxDepth=depth, seed=seed,
        minInstancesPerNode=5, **params), weight)


def boosted(weight: str | None = None, loss: str = "squared", trees: int = 10, depth: int = 5, step: float = 0.1,
            seed: int = 42, **params) -> Estimator:
    return _weighted(GBTRegressor(
        featuresCol=FEATURES, labelCol="y", predictionCol="pred", lossType=loss, maxIter=trees, maxDepth=depth,
        stepSize=step, seed=seed, **params), weight)


def tweedie(power: float, weight: str | None = None, reg: float = 1e-4, **params) -> Estimator:
    """Log-link Tweedie on standardised inputs. A power of 1 or more needs y > 0 only above 2, zeros are allowed."""
    return _weighted(GeneralizedLinearRegression(
        featuresCol=FEATURES, labelCol="y", predictionCol="pred", family="tweedie", variancePower=power, linkPower=0.0,
        regParam=reg, maxIter=15, **params), weight)


def _weighted(estimator, weight):
    return estimator.setWeightCol(weight) if weight else estimator


@dataclass
class Protocol:
    """Train-only median fill, vector assembly and optional standardisation shared by all models of a comparison."""

    columns: list[str]
    standardize: bool = False
    stages: list = field(default_factory=list)

    def prepare(self, train: DataFrame) -> PipelineModel:
        last = VectorAssembler(inputCols=self.columns, outputCol="_raw" if self.standardize else FEATURES)
        steps = [MedianImputer(columns=self.columns), last]
        if self.standardize:
            steps.append(StandardScaler(inputCol="_raw", outputCol=FEATURES, withMean=True, withStd=True))
        return Pipeline(stages=steps).fit(train)


def fit_and_score(estimators: dict[str, Estimator], frame: DataFrame, protocol: Protocol, keep: list[str]):
    """Fit every estimator on ``split = 'train'`` and stack its forecasts for all rows: (model, keep..., y, pred).

    The frame is stored, as the fill, the scaler and every model read it; all models score a row in one pass.
    """
    frame = written(frame, "model-frame")
    prepared = protocol.prepare(frame.where("split = 'train'"))
    vectors = prepared.transform(frame)
    fitted = {name: e.fit(vectors.where("split = 'train'")) for name, e in estimators.items()}
    return fitted, score_all(fitted, vectors, keep)


def score_all(fitted: dict, vectors: DataFrame, keep: list[str]) -> DataFrame:
    """Forecasts of all models, a row per row and model: (model, keep..., y, pred). The rows are read once."""
    out = vectors.select(*keep, "y", FEATURES)
    for i, model in enumerate(fitted.values()):
        out = model.transform(out).withColumnRenamed("pred", f"_pred{i}")
    each = F.array(*[F.struct(F.lit(name).alias("model"), F.col(f"_pred{i}").alias("pred")) for i, name in enumerate(fitted)])
    return out.select(*keep, "y", F.explode(each).alias("_m")).select("_m.model", *keep, "y", "_m.pred")


def benchmark_models(estimators: dict[str, Estimator], frame: DataFrame, protocol: Protocol) -> DataFrame:
    """Metrics of all models on all splits, one aggregation over the stacked forecasts."""
    _, scored = fit_and_score(estimators, frame, protocol, ["split"])
    return full_metrics(scored, ["model", "split"])


def constant_median(frame: DataFrame) -> DataFrame:
    """Forecast the training median for every row; the target has at most 101 distinct values."""
    middle = frame.where("split = 'train'").agg(F.percentile("y", 0.5).alias("m")).scalar()
    return frame.withColumn("pred", middle)


def line_fit(train: DataFrame, x: str, y: str = "y") -> tuple[Column, Column]:
    """Slope and intercept of a one-feature regression, as scalar sub-queries of the job that uses them."""
    fitted = train.agg(F.struct(F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b")).alias("f")).scalar()
    return fitted["a"], fitted["b"]


def line_score(frame: DataFrame, x: str, slope: float | Column, intercept: float | Column, digits: int = 6) -> DataFrame:
    return frame.withColumn("pred", F.round(F.lit(intercept) + F.lit(slope) * F.col(x), digits))


# ---- hurdle -------------------------------------------------------------------------------------------------------

def hurdle_fit(vectors: DataFrame, weight: str | None = None, regressor: Estimator | None = None):
    """Classifier for y = 0 on all training rows, regressor on the positive ones."""
    train = vectors.where("split = 'train'").withColumn("is_zero", (F.col("y") == 0).cast("double"))
    classifier = _weighted(LogisticRegression(
        featuresCol=FEATURES, labelCol="is_zero", maxIter=50, predictionCol="_zero", rawPredictionCol="_margin",
        probabilityCol="_prob"), weight)
    return classifier.fit(train), (regressor or forest(weight)).fit(train.where("y > 0"))


def hurdle_score(vectors: DataFrame, classifier, regressor) -> DataFrame:
    """Add ``p_zero`` and ``pred_positive``: scored once, used for any threshold."""
    out = classifier.transform(vectors).withColumn("p_zero", vector_to_array("_prob")[1])
    return regressor.transform(out.drop("_zero", "_margin", "_prob")).withColumnRenamed("pred", "pred_positive")


def hurdle_predict(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("pred", F.when(F.col("p_zero") >= threshold, 0.0).otherwise(F.col("pred_positive")))


def hurdle_keep(scored: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """Second form: keep the forecast when P(y > 0) reaches ``keep_from``, clipped to 0..100."""
    kept = F.when(1 - F.col("p_zero") >= keep_from, F.col("pred_positive")).otherwise(0.0)
    return scored.withColumn("pred", clip_0_100(kept))


# ---- search, ablation, refit -----------------------------------------------------------------------------------------

def linear_sets(frame: DataFrame, feature_sets: dict[str, list[str]], protocol: Protocol, weight: str | None = None) -> DataFrame:
    """Metrics of one linear model per feature set, (model, split, ...): one scan fits all of them, one scores all of them."""
    columns = protocol.columns
    frame = written(frame, "model-frame")
    train = frame.where("split = 'train'")
    filled = MedianImputer(columns=columns).fit(train)
    rows = filled.transform(frame)
    models = gram.fit_groups(
        rows.where("split = 'train'"), columns, weight=weight, feature_sets=feature_sets, shift=filled.fitted())
    return full_metrics(gram.score_sets(rows, models, columns, list(feature_sets)), ["model", "split"])


def linear_ablation(blocks: dict[str, list[str]], frame: DataFrame, weight: str | None = None) -> DataFrame:
    """Metrics of linear models on growing sets of feature blocks: (ablation, model, split, ...), all from one scan."""
    used, sets = [], {}
    for name, columns in blocks.items():
        used = used + columns
        sets[name] = list(used)
    out = linear_sets(frame, sets, Protocol(used), weight)
    return out.withColumnRenamed("model", "ablation").withColumn("model", F.lit("linear"))


def linear_ab_test(base: list[str], block: list[str], frame: DataFrame, weight: str | None = None) -> DataFrame:
    """The linear model without and with a feature block, and the change of the error per split; one scan fits both."""
    out = linear_sets(frame, {"without": base, "with": base + block}, Protocol(base + block), weight)
    side = lambda name: F.max(F.when(F.col("model") == name, F.col("mae")))
    both = out.groupBy("split").agg(side("without").alias("mae_without"), side("with").alias("mae_with"))
    return both.withColumn("delta", F.col("mae_with") - F.col("mae_without"))


def lambda_sweep(frame: DataFrame, columns: list[str], weights: dict[str, Column]) -> DataFrame:
    """Metrics of the linear model under several row weights, (model, split, ...); one scan fits all of them."""
    frame = written(frame, "model-frame")
    filled = MedianImputer(columns=columns).fit(frame.where("split = 'train'"))
    rows = filled.transform(frame)
    each = F.array(*[F.struct(F.lit(name).alias("model"), w.cast("double").alias("w")) for name, w in weights.items()])
    train = rows.where("split = 'train'").select("*", F.explode(each).alias("_g")).select("*", "_g.*")
    models = gram.fit_groups(train, columns, ["model"], weight="w", shift=filled.fitted())
    return full_metrics(gram.score_sets(rows, models, columns, list(weights), "model"), ["model", "split"])


def ablation(blocks: dict[str, list[str]], estimators: dict[str, Estimator], frame: DataFrame) -> DataFrame:
    """Metrics of every model on growing sets of feature blocks: (ablation, model, split, ...).

    Estimators are refitted for each set; ``linear_ablation`` fits all sets of a linear model at once.
    """
    used, out = [], None
    frame = written(frame, "model-frame")
    for name, columns in blocks.items():
        used = used + columns
        result = benchmark_models(estimators, frame, Protocol(list(used))).withColumn("ablation", F.lit(name))
        out = result if out is None else out.unionByName(result)
    return out


def holdout_search(make, grid: list[dict], frame: DataFrame, protocol: Protocol) -> DataFrame:
    """Score parameter settings on the fixed validation split: (setting, n, mae, rmse, r2), best first."""
    estimators = {json.dumps(g, sort_keys=True): make(**g) for g in grid}
    _, scored = fit_and_score(estimators, frame.where("split IN ('train', 'val')"), protocol, ["split"])
    val = scored.where("split = 'val'").withColumnRenamed("model", "setting")
    return val.groupBy("setting").agg(F.count(F.lit(1)).alias("n"), *regression_metrics()).orderBy("mae", "setting")


def feature_ab_test(make, base: list[str], block: list[str], frame: DataFrame) -> DataFrame:
    """The same model without and with a feature block, and the change of the error per split."""
    without = benchmark_models({"m": make()}, frame, Protocol(base)).select("split", F.col("mae").alias("mae_without"))
    with_it = benchmark_models({"m": make()}, frame, Protocol(base + block)).select("split", F.col("mae").alias("mae_with"))
    return without.join(with_it, "split").withColumn("delta", F.col("mae_with") - F.col("mae_without"))


# ---- experts ---------------------------------------------------------------------------------------------------------

def gating_router(frame: DataFrame, listeners: str = "listeners_log") -> DataFrame:
    """Add ``regime_id``; a row that has no regime fails the job that reads it."""
    lost = F.raise_error(F.lit("rows without listeners cannot be routed")).cast("int")
    return frame.withColumn("regime_id", F.coalesce(regime_id(listeners), lost))


def linear_experts(frame: DataFrame, columns: list[str], weight: str | None = None, ridge: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(experts, filled frame): a linear model per regime from one scan of the training rows.

    ``frame`` has ``split``, ``regime_id``, ``y`` and the columns; missing inputs are filled with training medians.
    """
    frame = written(frame, "expert-frame")
    filled = MedianImputer(columns=columns).fit(frame.where("split = 'train'"))
    rows = filled.transform(frame)
    experts = gram.fit_groups(
        rows.where("split = 'train'"), columns, ["regime_id"], weight=weight, ridge=ridge, shift=filled.fitted())
    return experts, rows


def score_linear_routed(rows: DataFrame, experts: DataFrame, columns: list[str]) -> DataFrame:
    """Score each row with the expert of its regime, clipped to 0..100: one join with a row per regime."""
    return gram.score_groups(rows, experts, columns, ["regime_id"]).withColumn("pred", clip_0_100("pred"))


def train_experts(vectors: DataFrame, make, regimes: tuple[int, ...] = (0, 1, 2)) -> dict:
    """One model of any kind per regime, each fitted on the training rows of its regime."""
    return {r: make().fit(vectors.where((F.col("split") == "train") & (F.col("regime_id") == r))) for r in regimes}


def score_routed(vectors: DataFrame, experts: dict) -> DataFrame:
    """Score each row with the expert of its regime, clipped to 0..100; the rows are read once."""
    out, pred = vectors, F.lit(None).cast("double")
    for r, model in experts.items():
        out = model.transform(out).withColumnRenamed("pred", f"_pred{r}")
        pred = F.when(F.col("regime_id") == r, F.col(f"_pred{r}")).otherwise(pred)
    return out.withColumn("pred", clip_0_100(pred)).where(F.col("regime_id").isin(*experts)).drop(*[f"_pred{r}" for r in experts])


# ---- artefacts -------------------------------------------------------------------------------------------------------

def save_models(spark: SparkSession, models: dict, metadata: dict, path: str) -> None:
    """Models in their own folders next to one JSON row of thresholds, feature list and run facts."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/models/{name}")
    row = {"names": [str(n) for n in models], **metadata}
    spark.createDataFrame([(json.dumps(row),)], "value string").write.mode("overwrite").text(f"{path}/metadata")


def load_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata").first()["value"])


def importances(model, columns: list[str], spark: SparkSession) -> DataFrame:
    """(feature, importance, rank) of a fitted tree model; one row per feature."""
    values = [float(x) for x in model.featureImportances.toArray()]
    ranked = sorted(zip(columns, values), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame(
        [(c, x, i + 1) for i, (c, x) in enumerate(ranked)], "feature string, importance double, rank int")
