"""Clusters, projections, contributions and importances."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunegauge.functions.scalars import text_hash
from tunegauge.operators.evaluate import regime_thresholds
from tunegauge.session import written


def standardized(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """``df`` with the standardised columns as a vector. The frame is stored, as the scaler and what is fitted on it read it again."""
    vectors = VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="skip").transform(written(df, "standardized"))
    scaler = StandardScaler(inputCol="_raw", outputCol=out, withMean=True, withStd=True).fit(vectors)
    return scaler.transform(vectors).drop("_raw")


def cluster_rows(df: DataFrame, features: str = "features", k: int = 4, seed: int = 42, method: str = "kmeans"):
    """(model, frame with ``cluster``). K-means also gives the distance to the own centroid."""
    if method == "mixture":
        model = GaussianMixture(featuresCol=features, predictionCol="cluster", k=k, seed=seed).fit(df)
        return model, model.transform(df).drop("probability")
    model = KMeans(featuresCol=features, predictionCol="cluster", k=k, seed=seed).fit(df)
    centers = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    squares = F.zip_with(
        vector_to_array(features), F.get(centers, F.col("cluster")), lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    return model, model.transform(df).withColumn("centroid_distance", distance)


def choose_k(df: DataFrame, ks: list[int], features: str = "features", seed: int = 42) -> DataFrame:
    """Inertia and (simplified, linear-time) silhouette per k; ``is_best`` marks the best silhouette."""
    evaluator = ClusteringEvaluator(featuresCol=features, predictionCol="cluster")
    rows = []
    for k in ks:
        model = KMeans(featuresCol=features, predictionCol="cluster", k=k, seed=seed).fit(df)
        rows.append((k, float(model.summary.trainingCost), float(evaluator.evaluate(model.transform(df)))))
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    spark: SparkSession = df.sparkSession
    return spark.createDataFrame(
        [(*r, r[0] == best) for r in rows], "k int, inertia double, silhouette double, is_best boolean")


def pca_projection(df: DataFrame, features: str, k: int = 2):
    """(frame with ``pc1``.. columns, share of variance each explains)."""
    model = PCA(k=k, inputCol=features, outputCol="_pc").fit(df)
    arr = vector_to_array("_pc")
    out = model.transform(df).withColumns({f"pc{i + 1}": arr[i] for i in range(k)}).drop("_pc")
    return out, [float(x) for x in model.explainedVariance]


def array_vectors(df: DataFrame, column: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def linear_contributions(df: DataFrame, coefficients: dict[str, float], means: dict[str, float]) -> DataFrame:
    """Exact contributions of a linear model: ``coef * (x - training mean)`` per feature, as ``c_<feature>``."""
    return df.withColumns({
        f"c_{name}": F.lit(coef) * (F.col(name) - F.lit(means[name])) for name, coef in coefficients.items()
    })


def _tree_paths(node, values: Column, size: int) -> tuple[float, Column]:
    """(mean at the root, array of what each feature adds to it on a row's way down a fitted tree)."""

    def walk(at, added: list[float]) -> Column:
        if at.getClass().getSimpleName() == "LeafNode":
            return F.lit(added)
        split, here = at.split(), at.prediction()
        feature, sides = split.featureIndex(), []
        for child in (at.leftChild(), at.rightChild()):
            more = list(added)
            more[feature] += child.prediction() - here
            sides.append(walk(child, more))
        return F.when(values[feature] <= F.lit(split.threshold()), sides[0]).otherwise(sides[1])

    return node.prediction(), walk(node, [0.0] * size)


def tree_contributions(df: DataFrame, model, columns: list[str], features: str = "features") -> DataFrame:
    """``base`` and ``c_<feature>`` of a fitted tree, forest or boosted model; they add up to its forecast, row by row.

    On the way down a tree, the split on a feature changes the mean of the training rows below; the changes are the
    feature's contribution. A leaf settles all of them, so a tree is one nested condition over literal arrays.
    """
    kind = type(model).__name__
    if kind.startswith("DecisionTree"):
        trees, weights = [model], [1.0]
    else:
        trees = model.trees
        weights = [1.0 / len(trees)] * len(trees) if kind.startswith("RandomForest") else model.treeWeights
    out, base = df.withColumn("_values", vector_to_array(features)), 0.0
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        mean, added = _tree_paths(tree._call_java("rootNode"), F.col("_values"), len(columns))
        base += weight * mean
        out = out.withColumn(f"_tree{i}", added)
    total = lambda k: sum((F.get(f"_tree{i}", F.lit(k)) * F.lit(w) for i, w in enumerate(weights)), F.lit(0.0))
    return out.withColumns({"base": F.lit(base), **{f"c_{c}": total(k) for k, c in enumerate(columns)}}).drop(
        "_values", *[f"_tree{i}" for i in range(len(trees))])


def permutation_importance(df: DataFrame, columns: list[str], score, key: str, seed: int = 42) -> DataFrame:
    """Rise of the MAE when one feature is shuffled among rows: (feature, mae_base, mae_shuffled, importance).

    ``score(frame) -> frame with y, pred``. A column is shuffled by pairing two hash orders of the rows;
    numbering them splits by range, so no task sees all rows. The first order is the same for all columns and numbered once.
    ``df`` is read several times a column: store it before if it is dear to compute.
    """
    base = score(df).agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("m")).first()["m"]
    rows, left = [], _numbered(df, key, seed)
    for i, name in enumerate(columns):
        right = _numbered(df.select(key, F.col(name).alias("_shuffled")), key, seed + i + 1, ["_shuffled"])
        mixed = left.join(right, "_number").withColumn(name, F.col("_shuffled"))
        value = score(mixed).agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("m")).first()["m"]
        rows.append((name, base, value, value - base))
    return df.sparkSession.createDataFrame(
        rows, "feature string, mae_base double, mae_shuffled double, importance double")


def _numbered(df: DataFrame, key: str, seed: int, keep: list[str] | None = None) -> DataFrame:
    """Number rows 1.. in ``_number`` by a seeded hash of the key, with the columns ``keep``, all by default.

    Rows are range-split and sorted within their piece, so a row's number is its place there plus the rows of the pieces before.
    """
    order, columns = [text_hash(key, F.lit(seed)), F.col(key)], keep or df.columns
    pieces = df.select(*columns, *[c.alias(f"_o{i}") for i, c in enumerate(order)]).repartitionByRange("_o0", "_o1").sortWithinPartitions("_o0", "_o1")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the place within the task's piece
    spread = written(pieces.select(*columns, F.spark_partition_id().alias("_piece"), place.alias("_place")), "numbered")
    ends = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row per piece
    before = spread.groupBy("_piece").agg(F.count(F.lit(1)).alias("n")).select("_piece", F.coalesce(F.sum("n").over(ends), F.lit(0)).alias("_before"))
    return spread.join(F.broadcast(before), "_piece").select(*columns, (F.col("_place") + F.col("_before") + 1).alias("_number"))


def regime_discovery(df: DataFrame, contribution: str, feature: str, k: int = 3, seed: int = 42) -> DataFrame:
    """Levels of one contribution by 1-D k-means, and the feature thresholds between them."""
    vectors = VectorAssembler(inputCols=[contribution], outputCol="_c").transform(df)
    model = KMeans(featuresCol="_c", predictionCol="cluster", k=k, seed=seed).fit(vectors)
    return regime_thresholds(model.transform(vectors), "cluster", feature)
