"""Queries of reduction, injected models, attributions and the merging store, and their SQL; importing this module adds them to the catalogue."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from lumora.functions.text import _entropy
from lumora.operators import explain, hooks, learn, reduction, rules, store
from lumora.plans.catalog import ORACLES, _scored, query, survey_sql, table
from lumora.session import settled, shared_folder
from lumora.streaming import merge

_WIDTH = 64


def _reduced(spark, sf_dir, components):
    df = table(spark, sf_dir, "embeddings")
    found = reduction.fit(df, "embedding", components, _WIDTH)
    return reduction.project(df, "vec_id", "embedding", found), found


@query()
def embedding_pca(spark, sf_dir):
    """The first eight components."""
    out, _ = _reduced(spark, sf_dir, 8)
    return out.select("vec_id", *[F.round(F.col("reduced")[i], 6).alias(f"c{i + 1}") for i in range(8)])


@query(f"""WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE len(embedding) = {_WIDTH}),
m AS (SELECT *, avg(x) OVER (PARTITION BY i) AS m FROM u), t AS (SELECT sum(v) AS total FROM (SELECT var_samp(x) AS v FROM u GROUP BY i))
SELECT vec_id, round(sum((x - m) * (x - m)), 6) AS energy, round(any_value(total), 6) AS variance, 1.0::DOUBLE AS explained FROM m, t GROUP BY vec_id""")
def embedding_pca_energy(spark, sf_dir):
    """All components: axes are orthonormal, so a vector's squares add up to its distance from the mean, and variances to the whole."""
    out, found = _reduced(spark, sf_dir, _WIDTH)
    squares = F.aggregate("reduced", F.lit(0.0), lambda s, x: s + x * x)
    return out.select("vec_id", F.round(squares, 6).alias("energy"), F.lit(round(float(found.variance.sum()), 6)).alias("variance"), F.lit(round(float(found.ratio.sum()), 9)).alias("explained"))


def unigram_perplexity(texts: list[str]) -> np.ndarray:
    """A stand-in for a language model: the perplexity of a sentence under its own characters' frequencies."""
    return np.array([2.0 ** _entropy(t) for t in texts])


_SENTENCES = r"""p AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '[.!?]+\s+'), lambda s: trim(s) <> '')[:10], lambda s: 2 ** list_aggregate(string_split(s, ''), 'entropy')) AS x FROM documents),
b AS (SELECT doc_id, CASE WHEN len(x) >= 2 AND list_avg(x) <> 0 THEN list_stddev_pop(x) / list_avg(x) ELSE 0.0 END AS b FROM p)"""


def _burst(spark, sf_dir):
    found = hooks.sentence_perplexities(table(spark, sf_dir, "documents"), "doc_id", "text", unigram_perplexity)
    return found.select("doc_id", rules.burstiness(F.col("perplexities")).alias("b"))


@query(f"WITH {_SENTENCES} SELECT doc_id, round(b, 6) AS burstiness FROM b")
def sentence_burstiness(spark, sf_dir):
    return _burst(spark, sf_dir).select("doc_id", F.round("b", 6).alias("burstiness"))


@query(survey_sql(near=True) + f""", {_SENTENCES}, k AS (SELECT doc_id, round(0.6 * (1 - b / (b + 1)) + 0.4 * risk_score, 6) AS s FROM b JOIN scored USING (doc_id))
SELECT doc_id, s AS score, CASE WHEN s >= 0.75 THEN 'machine' WHEN s <= 0.35 THEN 'human' ELSE 'uncertain' END AS label FROM k""")
def legacy_survey_label(spark, sf_dir):
    """Burstiness of the sentences mixed with a model's probability, here the survey score."""
    both = _burst(spark, sf_dir).join(_scored(spark, sf_dir, near_id="doc_id", nearest=False).select("doc_id", "risk_score"), "doc_id")
    score, label = rules.survey_label(F.col("b"), F.col("risk_score"))
    return both.select("doc_id", score.alias("score"), label.alias("label"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::DOUBLE AS words, length(text)::DOUBLE AS letters FROM documents")
def injected_features(spark, sf_dir):
    """A caller's function of two numbers a text."""
    function = lambda texts: np.array([[len(t.split()), len(t)] for t in texts], float).reshape(-1, 2)
    found = hooks.batch_features(table(spark, sf_dir, "documents"), "doc_id", "text", function, 2)
    return found.select("doc_id", F.col("features")[0].alias("words"), F.col("features")[1].alias("letters"))


_TRAITS = ["unique_ratio", "digit_ratio", "alpha_ratio", "entropy", "sentence_cv"]


@query()
def attribution_export(spark, sf_dir):
    """What each feature of the survey score adds to a forest's probability, on average over all labelled rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = _scored(spark, sf_dir).select("doc_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in _TRAITS]).join(table(spark, sf_dir, "labels").where("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("double").alias("toxic")), "doc_id")
    rows = settled(learn.balanced(rows, "toxic"))
    forest = RandomForestClassifier(numTrees=20, maxDepth=6, seed=42, labelCol="toxic", weightCol="weight")
    model = Pipeline(stages=[VectorAssembler(inputCols=_TRAITS, outputCol="features"), forest]).fit(rows)
    out = explain.mean_contributions(model, rows, "doc_id", _TRAITS)
    return out.select("feature", F.round("mean_abs", 6).alias("mean_abs"), F.round("mean", 6).alias("mean"))


@query(ORACLES["store_upsert_latest"])
def store_merge(spark, sf_dir):
    """The events of each week as a batch, the last one twice: the store then holds the latest row of each key."""
    events = table(spark, sf_dir, "events")
    kept = merge.Store(spark, f"{shared_folder(spark)}/lumora-{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}", ["user_id", "event_type"], "ts", "event_id", buckets=16)
    week = F.coalesce(F.weekofyear("ts") % 5, F.lit(0))
    for number in (3, 0, 4, 1, 2, 2):  # not in order of time
        kept.merge(events.where(week == number), {3: 0, 0: 1, 4: 2, 1: 3, 2: 4}[number])
    return kept.read().select("user_id", "event_type", "event_id", "value")


@query("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_object('k', json_extract(props, '$.k')::BIGINT, 'value', value)::VARCHAR AS features FROM events""")
def store_json(spark, sf_dir):
    """Features to JSON and back by a schema."""
    parsed = merge.from_json(table(spark, sf_dir, "events").select("event_id", "value", "props"), "props", "k long")
    joined = merge.with_json(parsed.withColumn("key", F.col("k")), ["k", "value"], "features")
    return joined.select("event_id", F.col("key").alias("k"), "features")
