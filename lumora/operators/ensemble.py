"""Combining the scores of several models, as column expressions over one row a document.

A model is a column with the probability of class 1; its prediction is 1 from 0.5 on.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(columns: list[Column]) -> Column:
    return reduce(add, columns)


def prediction(p: Column) -> Column:
    return F.when(p >= 0.5, 1).otherwise(0)


def confidence(p: Column) -> Column:
    return F.greatest(p, 1 - p)


def soft_vote(ps: list[Column]) -> Column:
    """The mean probability."""
    return _sum(ps) / len(ps)


def majority(ps: list[Column]) -> Column:
    """The commonest prediction; a tie goes to 0."""
    return F.when(_sum([prediction(p) for p in ps]) * 2 > len(ps), 1).otherwise(0)


def model_weights(df: DataFrame, models: list[str], y: str) -> list[float]:
    """Each model's weight, summing to one: 0.7 of its accuracy and 0.3 of the share of its confidence that was right.

    One aggregate with two numbers a model; without rows, or if no model is ever right, all weigh alike.
    """
    found = []
    for m in models:
        p = F.col(m)
        right = prediction(p) == F.col(y)
        found += [F.avg(right.cast("int")), F.sum(F.when(right, confidence(p)).otherwise(0.0)) / F.sum(confidence(p))]
    row = df.where(F.col(y).isNotNull()).agg(*[c.alias(f"w{i}") for i, c in enumerate(found)]).head()
    raw = [0.7 * (row[2 * i] or 0.0) + 0.3 * (row[2 * i + 1] or 0.0) for i in range(len(models))]
    total = sum(raw)
    return [w / total for w in raw] if total > 0 else [1 / len(models)] * len(models)


def weighted_vote(ps: list[Column], weights: list[float], least: float = 0.7) -> Column:
    """The weighted sum of predictions, rounded with halves to even; below `least` mean confidence the majority decides."""
    vote = F.rint(F.round(_sum([prediction(p) * F.lit(w) for p, w in zip(ps, weights)]), 9)).cast("int")
    mean = _sum([confidence(p) for p in ps]) / len(ps)
    return F.when(F.round(mean, 9) < least, majority(ps)).otherwise(vote)


def combine(stack: Column | None, weighted: Column | None, vote: Column | None) -> Column:
    """Predictions of three strategies at 0.4, 0.3 and 0.3, shared out anew if one is missing."""
    given = [(c, w) for c, w in ((stack, 0.4), (weighted, 0.3), (vote, 0.3)) if c is not None]
    if not given:
        raise ValueError("no strategy")
    total = sum(w for _, w in given)
    return F.rint(F.round(_sum([c * F.lit(w / total) for c, w in given]), 9)).cast("int")


def meta_features(ps: list[Column]) -> dict[str, Column]:
    """Agreement, entropy and spread of the models' predictions."""
    n = len(ps)
    share = _sum([prediction(p) for p in ps]) / n
    conf = [confidence(p) for p in ps]
    mean = soft_vote(ps)

    def part(s: Column) -> Column:
        return F.when(s > 0, s * F.log2(s + 1e-10)).otherwise(0.0)

    return {
        "agreement": F.greatest(share, 1 - share),
        "prediction_entropy": -(part(share) + part(1 - share)),
        "probability_variance": _sum([(p - mean) * (p - mean) for p in ps]) / n,
        "mean_confidence": _sum(conf) / n,
        "max_confidence": F.greatest(*conf),
        "min_confidence": F.least(*conf),
        "confidence_range": F.greatest(*conf) - F.least(*conf),
    }


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.02)), F.lit(0.98))


def model_confidence(p: Column) -> Column:
    """0.7 of the winning probability and 0.3 of the lead, at most 0.98."""
    a = clipped(p)
    return F.least(confidence(a) * 0.7 + F.abs(2 * a - 1) * 0.3, F.lit(0.98))


def serve_decision(df: DataFrame, models: list[str], bias: str) -> DataFrame:
    """df with machine_p, decision and decision_confidence.

    Models weigh by their lead; a strong bias of the style rules forces class 1; class 0 with doubts is capped at 0.5.
    """
    ps = [clipped(F.col(m)) for m in models]
    leads = [F.abs(2 * p - 1) for p in ps]
    total = _sum(leads)
    mix = _sum([p * w for p, w in zip(ps, leads)]) / F.when(total > 0, total)
    df = df.withColumn("machine_p", F.round(F.coalesce(mix, F.lit(0.0)), 9))
    a = F.col("machine_p")
    h = F.when(total > 0, 1 - a).otherwise(0.0)
    first = F.when((a >= 0.42) & (a >= h), 1).when(h > 0.5, 0).otherwise(F.when(a >= 0.40, 1).otherwise(0))
    conf = F.least(F.greatest(F.greatest(a, h) * 0.7 + F.abs(a - h) * 0.3, F.lit(0.55)), F.lit(0.95))
    doubts = F.greatest(*ps) >= 0.40
    df = df.withColumn("decision", first)
    df = df.withColumn("decision_confidence", F.when((F.col("decision") == 0) & doubts, F.least(conf, F.lit(0.50))).otherwise(conf))
    d, c = F.col("decision"), F.col("decision_confidence")
    forced = F.col(bias) >= 0.5
    floor = F.when((d == 0) & (a >= 0.28), 0.65).otherwise(0.68)
    df = df.withColumn("decision_confidence", F.when(forced, F.greatest(c, floor)).otherwise(c)).withColumn("decision", F.when(forced, 1).otherwise(d))
    return df.withColumn("decision_confidence", F.when((d == 0) & (a >= 0.35), F.least(c, F.lit(0.50))).otherwise(c))


def local_importance(df: DataFrame, key: str, importances: dict[str, float], most: int = 15) -> DataFrame:
    """(key, feature, score) of the features with the largest importance times |value| of each row; `most` is the report's length."""
    scores = [F.struct((-F.round(F.abs(F.coalesce(F.col(f), F.lit(0.0))) * w, 6)).alias("s"), F.lit(f).alias("f")) for f, w in importances.items()]
    top = F.slice(F.array_sort(F.array(*scores)), 1, most)
    return df.select(key, F.explode(top).alias("t")).select(key, F.col("t.f").alias("feature"), (-F.col("t.s")).alias("score"))


def robustness(df: DataFrame, y: str, before: str, after: str) -> DataFrame:
    """One row: accuracy before and after a perturbation, its drop, the share kept, and the share of predictions that flipped."""
    hit = lambda c: F.avg((F.col(c) == F.col(y)).cast("int"))
    out = df.agg(F.count("*").alias("n"), hit(before).alias("b"), hit(after).alias("a"), F.avg((F.col(before) != F.col(after)).cast("int")).alias("f"))
    kept = F.when(F.col("b") > 0, F.round(F.col("a") / F.col("b"), 6)).otherwise(F.lit(0.0))
    return out.select("n", F.round("b", 6).alias("accuracy"), F.round("a", 6).alias("perturbed_accuracy"), F.round(F.col("b") - F.col("a"), 6).alias("drop"), kept.alias("score"), F.round("f", 6).alias("success_rate"))


def class_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, and their means by support as class `weighted`; one shuffle of class pairs."""
    pairs = df.groupBy(F.col(y).cast("string").alias("y"), F.col(yhat).cast("string").alias("h")).agg(F.count("*").alias("n"))
    each = pairs.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.when(F.col("y") == F.col("h"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("taken")), F.struct(F.col("h").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("taken")))).alias("e")).select("e.*")
    sums = each.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "taken")])
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, support, taken = F.col("tp"), F.col("support"), F.col("taken")
    rates = sums.select("label", "support", rate(tp, taken).alias("precision"), rate(tp, support).alias("recall"), rate(2 * tp, support + taken).alias("f1"))
    total = F.sum("support")
    mean = rates.agg(F.lit("weighted").alias("label"), total.alias("support"), *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ("precision", "recall", "f1")])
    out = rates.unionByName(mean)
    return out.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def alternate_meta_features(predictions: list[Column], probabilities: list[Column]) -> dict[str, Column]:
    """Of each model its prediction, both probabilities and its confidence, the larger one."""
    out = {}
    for i, (h, p) in enumerate(zip(predictions, probabilities)):
        out |= {f"m{i}_prediction": h, f"m{i}_p0": 1 - p, f"m{i}_p1": p, f"m{i}_confidence": F.greatest(p, 1 - p)}
    return out


def perturbed_features(vector: Column, key: Column, attack: str, ratio: float = 0.1, seed: int = 42) -> Column:
    """A vector of the same length: noise, append (zeros in the last tenth), delete (zeros at chosen places), swap (neighbours).

    Chosen places and noise come from the hash of (key, place, seed), so a row changes alike on every run. Null stays null.
    """
    draw = lambda i, what: F.pmod(F.xxhash64(key, i, F.lit(what), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    n = F.size(vector)
    if attack == "noise":
        return F.transform(vector, lambda x, i: x + (draw(i, "noise") - 0.5) * 2 * ratio)
    if attack == "append":
        return F.transform(vector, lambda x, i: F.when(i < n - F.ceil(n * ratio), x).otherwise(F.lit(0.0)))
    if attack == "delete":
        return F.transform(vector, lambda x, i: F.when(draw(i, "delete") < ratio, F.lit(0.0)).otherwise(x))
    if attack == "swap":
        first = lambda i: (i % 2 == 0) & (i + 1 < n) & (draw(F.floor(i / 2), "swap") < ratio)
        second = lambda i: (i % 2 == 1) & (draw(F.floor(i / 2), "swap") < ratio)
        return F.transform(vector, lambda x, i: F.when(first(i), F.get(vector, i + 1)).when(second(i), F.get(vector, i - 1)).otherwise(x))
    raise ValueError(attack)


def robustness_summary(df: DataFrame, model: str = "model", attack: str = "attack", score: str = "score") -> DataFrame:
    """(model, n, mean_score, best_attack, worst_attack): of equal scores the first name; null scores don't count."""
    held = df.where(F.col(score).isNotNull())
    best = F.min_by(attack, F.struct(-F.col(score), F.col(attack)))
    worst = F.min_by(attack, F.struct(F.col(score), F.col(attack)))
    return held.groupBy(model).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_score"), best.alias("best_attack"), worst.alias("worst_attack"))


def ensemble_advantage(df: DataFrame, model: str = "model", score: str = "mean_score", ensemble: str = "ensemble") -> DataFrame:
    """One row: the ensemble's score less the largest, mean and smallest of the others; null if either side is missing."""
    mine, others = F.max(F.when(F.col(model) == ensemble, F.col(score))), F.when(F.col(model) != ensemble, F.col(score))
    return df.agg(*[F.round(mine - f(others), 6).alias(f"over_{n}") for n, f in (("best", F.max), ("mean", F.avg), ("worst", F.min))])
