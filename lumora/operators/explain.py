"""What each feature adds to a fitted forest's score of a row: path-dependent Shapley values, exact, by tree and batch.

Within a tree a leaf counts as a game of the distinct features on its path. A feature that is in the coalition passes if the row
takes the path at its splits; one that isn't passes with the share of training rows that did. So a coalition's worth is a
product, and the sum over coalitions follows from the coefficients of a polynomial with a factor for each feature. Rows that pass
the same of a leaf's features share one computation.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.session import shared_folder

Leaf = tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # value, features, lower and upper bounds, shares of rows


def leaves(model) -> list[Leaf]:
    """The leaves of a random forest or of boosted trees, in units of the score: a mean of class shares, or a margin.

    The model's tables are a row for each node; they are saved and read, as the nodes are not at hand otherwise.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = f"{shared_folder(spark)}/lumora-{spark.sparkContext.applicationId}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    classes = model.numClasses > 1 and hasattr(model, "subsamplingRate") and type(model).__name__.startswith("RandomForest")
    weights, trees = list(model.treeWeights), defaultdict(dict)
    for r in rows:
        trees[r.treeID][r.id] = r
    out: list[Leaf] = []
    for tree, nodes in trees.items():
        stack = [(0, {})]  # a node, and (lower, upper, share) of each feature above it
        while stack:
            at, above = stack.pop()
            node = nodes[at]
            cover = sum(node.impurityStats) if classes else node.impurityStats[0]
            if node.leftChild < 0:
                value = node.impurityStats[1] / cover / len(trees) if classes else node.prediction * weights[tree]
                keys = sorted(above)
                bounds = [above[k] for k in keys]
                out.append((value, np.array(keys, np.int64), *(np.array([b[i] for b in bounds], float) for i in range(3))))
                continue
            feature, cut = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
            low, high, share = above.get(feature, (-math.inf, math.inf, 1.0))
            for child, span in ((node.leftChild, (low, min(high, cut))), (node.rightChild, (max(low, cut), high))):
                part = sum(nodes[child].impurityStats) if classes else nodes[child].impurityStats[0]
                stack.append((child, {**above, feature: (*span, share * part / cover)}))
    return out


def base_value(of: list[Leaf]) -> float:
    """The score that no feature has a part in."""
    return float(sum(v * z.prod() for v, _, _, _, z in of))


def _additions(passes: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """For each row of passes (0 or 1 a feature), what each feature adds to a leaf of value 1."""
    n, d = passes.shape
    weight = np.array([math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)])
    out = np.empty((n, d))
    for j in range(d):
        sums = np.zeros((n, d))  # by size of the coalition of the other features
        sums[:, 0] = 1.0
        for k in range(d):
            if k != j:
                taken = sums * passes[:, k : k + 1]
                sums = sums * shares[k]
                sums[:, 1:] += taken[:, :-1]
        out[:, j] = (passes[:, j] - shares[j]) * (sums @ weight)
    return out


def shapley(of: list[Leaf], x: np.ndarray) -> np.ndarray:
    """A row of values for each row of x and a column a feature; with the base value they sum up to the score."""
    out = np.zeros(x.shape)
    for value, features, low, high, shares in of:
        d = len(features)
        if not d:
            continue
        held = x[:, features]
        passes = (held > low) & (held <= high)
        code = passes @ (1 << np.arange(d))
        seen, first, which = np.unique(code, return_index=True, return_inverse=True)
        out[:, features] += value * _additions(passes[first].astype(float), shares)[which]
    return out


def contributions(model, df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, base, score, a column for each feature) for each row of df: score is the base and what the features add.

    model is a pipeline that ends in a random forest (score: the probability of class 1) or boosted trees (score: the margin,
    whose logistic curve at twice its value is the probability). Rows are those the pipeline can transform.
    """
    of = leaves(model.stages[-1])
    base, kind = base_value(of), df.schema[key].dataType.simpleString()
    names = [f"`{f}`" for f in features]

    def explain(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, len(features))
            values = shapley(of, x)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(np.full(len(x), base)), pa.array(base + values.sum(1)), *[pa.array(v) for v in values.T]], [key, "base", "score", *features])

    scaled = model.transform(df).select(key, vector_to_array("features").alias("x"))
    return scaled.mapInArrow(explain, f"`{key}` {kind}, base double, score double, " + ", ".join(f"{n} double" for n in names))


def mean_contributions(model, df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(feature, mean_abs, mean): how much each feature adds to a row's score on average, for an export."""
    each = contributions(model, df, key, features).select(*features).unpivot([], features, "feature", "value")
    return each.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean"))
