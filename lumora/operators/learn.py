"""Base classifiers and stacking on feature columns, with Spark ML. Every row is scored by models that didn't see its fold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.session import settled

FOLD = "__fold"


def folds(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    return df.withColumn(FOLD, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(k)))


def balanced(df: DataFrame, y: str) -> DataFrame:
    """df with weight: rows / (classes x rows of the class). The counts are one row a class."""
    counts = df.groupBy(y).agg(F.count("*").alias("n"))
    total = Window.partitionBy()
    weights = counts.select(y, (F.sum("n").over(total) / (F.count("*").over(total) * F.col("n"))).alias("weight"))
    return df.join(F.broadcast(weights), y)


def random_features(df: DataFrame, features: str, out: str, dims: int, count: int = 128, gamma: float = 0.1, seed: int = 42) -> DataFrame:
    """Random Fourier features of an RBF kernel: one matrix product a batch of rows, with a fixed matrix."""
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, (2 * gamma) ** 0.5, (count, dims)), rng.uniform(0, 2 * np.pi, count)

    @F.pandas_udf("array<double>")
    def project(values: pd.Series) -> pd.Series:
        on = np.stack(values.to_list()) if len(values) else np.zeros((0, dims))
        return pd.Series(list(np.cos(on @ w.T + b) * (2 / count) ** 0.5), dtype=object)

    return df.withColumn(out, array_to_vector(project(vector_to_array(features))))


def estimator(kind: str, y: str, rows: int):
    """random_forest, logistic, boosting or svm; rows sets the regularisation that C = 10 means."""
    common = {"featuresCol": "features", "labelCol": y, "weightCol": "weight"}
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=60, maxDepth=10, featureSubsetStrategy="sqrt", seed=42, **common)
    if kind == "logistic":
        return LogisticRegression(regParam=1 / (10 * max(rows, 1)), elasticNetParam=0.0, standardization=False, **common)
    if kind == "boosting":
        return GBTClassifier(maxIter=20, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, seed=42, **common)  # 20 x 5 by default: see README
    if kind == "svm":
        return LinearSVC(regParam=1 / (10 * max(rows, 1)), maxIter=50, **{**common, "featuresCol": "kernel"})
    raise ValueError(kind)


def cross_predict(df: DataFrame, key: str, features: list[str], y: str, kind: str, k: int = 3) -> DataFrame:
    """(key, y, p): for each fold, the probability from a model of the other folds.

    Features are standardised on the training folds. An svm's margin becomes a probability by a logistic curve fitted on the
    training folds. Rows with a null feature count it as 0; rows without a label are left out, so an empty table, or one
    without labels, gives an empty one. Keys are unique.
    """
    import functools

    base = settled(folds(df.where(F.col(y).isNotNull()).select(key, F.col(y).cast("double").alias(y), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]), key, k))  # read by every fold, in few tasks as it is small
    if base.isEmpty():
        return base.select(key, y, F.lit(0.0).alias("p"))
    out = []
    for fold in range(k):
        train, test = balanced(base.where(F.col(FOLD) != fold), y).cache(), base.where(F.col(FOLD) == fold)
        rows = train.count()
        scale = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]).fit(train)
        a, b = scale.transform(train), scale.transform(test)
        if kind == "svm":
            a, b = (random_features(d, "features", "kernel", len(features)) for d in (a, b))
        model = estimator(kind, y, rows).fit(a)
        if kind == "svm":
            a, b = (model.transform(d).drop("features").withColumnRenamed("rawPrediction", "features").drop("prediction") for d in (a, b))
            model = LogisticRegression(labelCol=y, weightCol="weight").fit(a)
        out.append(model.transform(b).select(key, y, vector_to_array("probability")[1].alias("p")))
        train.unpersist()
    return functools.reduce(DataFrame.unionByName, out)


def stacked(df: DataFrame, key: str, features: list[str], y: str, kinds=("random_forest", "logistic", "boosting"), k: int = 3) -> DataFrame:
    """(key, y, p, and p of each kind): a logistic model over out-of-fold probabilities, itself scored out of fold."""
    df, joined = settled(df.select(key, y, *features)), None  # read by every kind, as what they give is by the last model
    for kind in kinds:
        p = cross_predict(df, key, features, y, kind, k).withColumnRenamed("p", f"p_{kind}")
        joined = p if joined is None else joined.join(p.drop(y), key)
    names, joined = [f"p_{kind}" for kind in kinds], settled(joined)
    return cross_predict(joined, key, names, y, "logistic", k).join(joined.select(key, *names), key)


#: The points of the grids that are searched.
GRIDS = {
    "random_forest": {"numTrees": (20, 60), "maxDepth": (5, 10)},
    "logistic": {"regParam": (0.001, 0.01, 0.1)},
    "boosting": {"maxIter": (10, 20), "maxDepth": (3, 5)},
}


def grid_search(df: DataFrame, key: str, features: list[str], y: str, kind: str, k: int = 5, grid: dict | None = None):
    """(pipeline model fitted on all rows with the best parameters, [(parameters, mean F1 of class 1 over the folds)]).

    Folds come from the key's hash, so they are the same on every run; the scaler is fitted within each training fold.
    Of equal scores the first point wins. Null features count as 0; rows without a label are left out.
    """
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    clean = df.where(F.col(y).isNotNull()).select(key, F.col(y).cast("double").alias(y), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    rows = balanced(folds(clean, key, k).withColumn(FOLD, F.col(FOLD).cast("int")), y)
    model = estimator(kind, y, clean.count())
    stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), model]
    builder = ParamGridBuilder()
    for name, values in (grid or GRIDS[kind]).items():
        builder = builder.addGrid(model.getParam(name), list(values))
    points = builder.build()
    judge = MulticlassClassificationEvaluator(labelCol=y, metricName="fMeasureByLabel", metricLabel=1.0, beta=1.0)
    found = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=points, evaluator=judge, numFolds=k, foldCol=FOLD, parallelism=4).fit(rows)
    return found.bestModel, [({p.name: v for p, v in point.items()}, score) for point, score in zip(points, found.avgMetrics)]


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) of a pipeline's last stage by falling importance: Gini, or the coefficients' absolute values."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return sorted(zip(features, map(float, values)), key=lambda x: (-x[1], x[0]))


def best_model(scores: dict[str, float]) -> str:
    """The kind with the highest score, of equal ones the first."""
    return max(scores, key=scores.get)


def model_importance(scores: dict[str, float | None]) -> dict[str, float]:
    """Validation F1 as shares; a missing one counts as 0, and all are equal if none is positive."""
    held = {k: max(v or 0.0, 0.0) for k, v in scores.items()}
    total = sum(held.values())
    return {k: v / total if total else 1 / len(held) for k, v in held.items()}


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def text_classifier(df: DataFrame, text: str, y: str, terms: int = 100):
    """A pipeline from words over TF-IDF to a random forest, fitted on df; null texts are empty, rows without a label are left out."""
    from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[a-z0-9']+", gaps=False), CountVectorizer(inputCol="words", outputCol="counts", vocabSize=terms),
        IDF(inputCol="counts", outputCol="features"), RandomForestClassifier(labelCol=y, numTrees=50, seed=42),
    ]
    rows = df.where(F.col(y).isNotNull()).select(F.coalesce(text, F.lit("")).alias(text), F.col(y).cast("double").alias(y))
    return Pipeline(stages=stages).fit(rows)


def attributions(model, df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean_abs): for trees the mean absolute Shapley value of each feature over all rows, else its importance."""
    if not hasattr(model.stages[-1], "trees"):
        return df.sparkSession.createDataFrame(importances(model, features), "feature string, mean_abs double")
    from lumora.operators.explain import mean_contributions

    return mean_contributions(model, df.withColumn("__key", F.lit(0)), "__key", features).select("feature", "mean_abs")
