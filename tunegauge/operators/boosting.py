"""Boosted regression trees for losses that Spark ML does not offer, with early stopping, and a sampled search over settings.

A round fits one Spark ML tree to the negative gradient of the loss at the forecasts so far. Forecasts travel with the rows, which
are stored every few rounds, so neither plans nor recomputation grow with the number of rounds. The result is a Spark ML
model, which transforms, saves and ranks features like any other.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegauge.operators.evaluate import regression_metrics
from tunegauge.session import written

FEATURES = "features"
#: Rounds after which the rows with their forecasts are stored.
STORE_EVERY = 5


def squared(_: float) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    return lambda r: r * r, lambda r: 2.0 * r


def pseudo_huber(slope: float) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Square for residuals well below ``slope``, straight line well above, smooth between."""
    root = lambda r: F.sqrt(1.0 + (r / slope) * (r / slope))
    return lambda r: slope * slope * (root(r) - 1.0), lambda r: r / root(r)


#: name -> (loss, negative gradient) of a residual
LOSSES = {"squared": squared, "pseudo_huber": pseudo_huber}


@dataclass
class Boosted:
    """A fitted model, and per round the mean loss on both splits; ``best`` is the round whose trees the model holds."""

    trees: list
    weights: list[float]
    history: list[dict]
    best: int

    @property
    def model(self) -> GBTRegressionModel:
        return joined(self.trees[: self.best], self.weights[: self.best])

    @property
    def rounds(self) -> int:
        return len(self.history)


def joined(trees: list, weights: list[float]) -> GBTRegressionModel:
    """One Spark ML model of weighted trees."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    jvm, kind = context._jvm, context._jvm.org.apache.spark.ml.regression
    array = context._gateway.new_array(kind.DecisionTreeRegressionModel, len(trees))
    numbers = context._gateway.new_array(jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        array[i], numbers[i] = tree._java_obj, float(weight)
    uid = jvm.org.apache.spark.ml.util.Identifiable.randomUID("gbtr")
    return GBTRegressionModel(kind.GBTRegressionModel(uid, array, numbers)).setFeaturesCol(FEATURES).setPredictionCol("pred")


def fit(
    vectors: DataFrame, loss: str = "pseudo_huber", rounds: int = 20, depth: int = 5, step: float = 0.1, slope: float = 1.0,
    min_rows: int = 1, weight: str | None = None, patience: int | None = None, tolerance: float = 0.0, seed: int = 42,
    start: Boosted | None = None,
) -> Boosted:
    """Boost on ``split = 'train'`` of rows (split, y, features, weight?).

    The first tree forecasts the target itself. With ``patience`` the loss on ``split = 'val'`` decides: boosting stops once
    that many rounds in a row have not lowered it by more than ``tolerance``, and the model keeps the trees of the best round.
    ``start`` goes on from an earlier fit of the same settings up to ``rounds`` rounds in all.
    """
    value, gradient = LOSSES[loss](slope)
    keep = ["split", "y", FEATURES, *([weight] if weight else [])]
    rows = vectors.where("split IN ('train', 'val')").select(*keep)
    trees, weights, history = (list(x) for x in (start.trees, start.weights, start.history)) if start else ([], [], [])
    if trees:
        rows = joined(trees, weights).setPredictionCol("_f").transform(rows)
    else:
        rows = rows.withColumn("_f", F.lit(0.0))
    residual = F.col("y") - F.col("_f")
    mass = F.col(weight) if weight else F.lit(1.0)
    best = min(history, key=lambda h: (h["val"], h["round"]))["round"] if history and patience else len(history)
    while len(history) < rounds and not (patience and history and len(history) - best >= patience):
        first = not trees
        target = F.col("y") if first else gradient(residual)
        tree = DecisionTreeRegressor(
            featuresCol=FEATURES, labelCol="_g", predictionCol="_p", maxDepth=depth, seed=seed, minInstancesPerNode=min_rows)
        if weight:
            tree = tree.setWeightCol(weight)
        fitted = tree.fit(rows.where("split = 'train'").withColumn("_g", target))
        trees.append(fitted)
        weights.append(1.0 if first else step)
        rows = fitted.transform(rows).withColumn("_f", F.col("_f") + weights[-1] * F.col("_p")).drop("_p")
        if len(trees) % STORE_EVERY == 0:
            rows = written(rows, "boosted")
        means = {r["split"]: r["m"] for r in rows.groupBy("split").agg((F.sum(mass * value(residual)) / F.sum(mass)).alias("m")).collect()}
        history.append({"round": len(trees), "train": means.get("train"), "val": means.get("val", math.inf)})
        lowest = history[best - 1]["val"] if best else math.inf
        if not patience or history[-1]["val"] < lowest - tolerance:
            best = len(trees)
    return Boosted(trees, weights, history, best)


def sampled(space: dict[str, list | tuple], count: int, seed: int = 42) -> list[dict]:
    """``count`` different settings: a list is drawn from evenly, (low, high) of whole numbers or floats evenly, (low, high, "log") by ratio."""
    rng, found = random.Random(seed), []

    def draw(choice):
        if isinstance(choice, list):
            return rng.choice(choice)
        low, high = choice[:2]
        if len(choice) == 3:
            return round(math.exp(rng.uniform(math.log(low), math.log(high))), 6)
        return rng.randint(low, high) if isinstance(low, int) and isinstance(high, int) else round(rng.uniform(low, high), 6)

    for _ in range(1000 * count):
        setting = {name: draw(choice) for name, choice in space.items()}
        if setting not in found:
            found.append(setting)
        if len(found) == count:
            return found
    raise ValueError(f"the space has fewer than {count} settings")


def search(
    vectors: DataFrame, space: dict[str, list | tuple], count: int = 12, rungs: tuple[int, ...] = (1, 2, 4), keep: float = 0.5,
    patience: int = 2, seed: int = 42,
) -> tuple[DataFrame, dict, Boosted]:
    """Successive halving over sampled settings on the fixed validation split: (results, best setting, its fit).

    All settings are boosted to the first rung's rounds; the best share ``keep`` by validation MAE goes on, from where it
    stands, to the next rung. A setting whose validation loss stops falling stops early. Results: (setting, rung, rounds,
    n, mae, rmse, r2, kept), a row per setting and rung that it reached.
    """
    spark, rows = vectors.sparkSession, written(vectors.where("split IN ('train', 'val')").select("split", "y", FEATURES), "search")
    alive, out = [(json.dumps(s, sort_keys=True), s, None) for s in sampled(space, count, seed)], []
    for rung, rounds in enumerate(rungs, 1):
        tried = []
        for name, setting, before in alive:
            fitted = fit(rows, rounds=rounds, patience=patience, seed=seed, start=before, **setting)
            scored = fitted.model.transform(rows.where("split = 'val'"))
            tried.append((scored.agg(F.count(F.lit(1)).alias("n"), *regression_metrics()).first(), name, setting, fitted))
        tried.sort(key=lambda t: (t[0]["mae"], t[1]))
        stay = max(1, math.ceil(len(tried) * keep)) if rung < len(rungs) else 1
        out += [(name, rung, f.rounds, m["n"], m["mae"], m["rmse"], m["r2"], i < stay) for i, (m, name, _, f) in enumerate(tried)]
        alive = [(name, setting, f) for _, name, setting, f in tried[:stay]]
    results = spark.createDataFrame(out, "setting string, rung int, rounds int, n bigint, mae double, rmse double, r2 double, kept boolean")
    return results, alive[0][1], alive[0][2]
