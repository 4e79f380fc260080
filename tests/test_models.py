"""Attributions, reduction, injected functions and the merging store against definitions, and on edge rows."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lumora.operators import explain, hooks, learn, reduction, rules, store
from lumora.streaming import merge

NAMES = ["a", "b", "c"]


def _rows(n):
    rng = random.Random(8)
    return [(i, rng.random(), rng.random(), rng.random()) for i in range(n)]


def _enumerated(leaves, x):
    """Shapley values by all coalitions of all features."""
    m = len(x)

    def worth(inside):
        return sum(v * math.prod((low < x[f] <= high) if f in inside else z for f, low, high, z in zip(fs, lows, highs, zs)) for v, fs, lows, highs, zs in leaves)

    out = []
    for j in range(m):
        rest = [k for k in range(m) if k != j]
        total = 0.0
        for s in range(m):
            for inside in itertools.combinations(rest, s):
                total += math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) * (worth({*inside, j}) - worth(set(inside)))
        out.append(total)
    return out


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_contributions_sum_up_and_equal_enumeration(spark, kind):
    df = spark.createDataFrame(_rows(150), "id int, a double, b double, c double").withColumn("y", ((F.col("a") + F.col("b") * F.col("c")) > 0.7).cast("double"))
    last = RandomForestClassifier(labelCol="y", numTrees=4, maxDepth=4, seed=1) if kind == "forest" else GBTClassifier(labelCol="y", maxIter=3, maxDepth=3, seed=1)
    model = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features"), last]).fit(df)
    got = {r.id: r for r in explain.contributions(model, df, "id", NAMES).collect()}
    p = {r.id: r.probability[1] for r in model.transform(df).select("id", "probability").collect()}
    of = explain.leaves(model.stages[-1])
    for i, a, b, c in _rows(150):
        score = got[i].score if kind == "forest" else 1 / (1 + math.exp(-2 * got[i].score))
        assert math.isclose(score, p[i], abs_tol=1e-9) and math.isclose(got[i].base, explain.base_value(of), abs_tol=1e-12)
        if i < 12:
            assert np.allclose([got[i][n] for n in NAMES], _enumerated(of, (a, b, c)), atol=1e-12)
    found = {r.feature: r.mean_abs for r in learn.attributions(model, df, NAMES).collect()}
    assert all(math.isclose(found[n], sum(abs(r[n]) for r in got.values()) / 150, abs_tol=1e-9) for n in NAMES)
    assert explain.contributions(model, df.limit(0), "id", NAMES).collect() == []


def test_components_equal_those_of_a_singular_value_decomposition(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [math.nan] * 6), (903, [None] * 6)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(4)
    found = reduction.fit(df, "v", 4, 6)
    u, s, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert found.rows == 200 and np.allclose(found.variance, s[:4] ** 2 / 199) and np.allclose(found.ratio, s[:4] ** 2 / (s**2).sum())
    assert np.allclose(np.abs((found.axes * axes[:4]).sum(1)), 1) and all(a[np.abs(a).argmax()] > 0 for a in found.axes)
    out = {r.id: r.reduced for r in reduction.project(df, "id", "v", found).collect()}
    assert len(out) == 204 and all(out[k] is None for k in (900, 901, 902, 903))
    back = np.array([out[i] for i in range(200)]) @ found.axes + found.mean
    assert np.isclose(((x - back) ** 2).sum(), (s[4:] ** 2).sum())
    none = reduction.fit(df.limit(0), "v", 2, 6)
    assert none.total == 0 and none.axes.shape == (2, 6) and none.ratio.tolist() == [0, 0]


def test_injected_functions_are_checked(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "bad"), (1, "a b")], "id int, text string").withColumn("features", F.lit(0)).repartition(2)

    def fails(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return np.array([[len(t), 1.0] for t in texts])

    got = sorted((r.id, r.features, r.error) for r in hooks.batch_features(df, "id", "text", fails, 2, strict=False).collect() if r.id != 4)
    assert got == [(1, [3.0, 1.0], None), (1, [3.0, 1.0], None), (2, None, None), (3, [0.0, 1.0], None)]
    bad = hooks.batch_features(df, "id", "text", fails, 2, strict=False).where("id = 4").head()
    assert bad.features is None and bad.error == "RuntimeError: no"
    with pytest.raises(Exception, match="RuntimeError: no"):
        hooks.batch_features(df, "id", "text", fails, 2).collect()
    for strict in (True, False):
        with pytest.raises(Exception, match="of width 3"):
            hooks.batch_features(df.where("id < 4"), "id", "text", fails, 3, strict=strict).collect()
    assert hooks.batch_features(df.limit(0), "id", "text", fails, 2).collect() == []


def test_sentence_perplexities(spark):
    df = spark.createDataFrame([(1, "One. Two two! Three?"), (2, None), (3, " "), (4, ". ".join("abcdefghijklmn")), (5, "x. bad. y")], "id int, text string")

    def length(texts):
        if "bad" in texts:
            raise ValueError
        return [math.inf if t == "Two two" else float(len(t)) for t in texts]

    found = hooks.sentence_perplexities(df, "id", "text", length)
    assert {r.id: r.perplexities for r in found.collect()} == {1: [3.0, 6.0], 2: [], 3: [], 4: [1.0] * 10, 5: [1.0, 1.0]}
    burst = {r.id: r.b for r in found.select("id", rules.burstiness(F.col("perplexities")).alias("b")).collect()}
    assert math.isclose(burst[1], 1 / 3) and burst[2] == burst[4] == 0.0


SCHEMA = "key string, ts timestamp_ntz, id int, v string"


def _log(seed, n):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(rng.choice([*"abcdefghij", None]), start + dt.timedelta(hours=rng.randint(0, 400)), rng.randint(0, 10**9), str(rng.random())) for _ in range(n)]


@pytest.mark.parametrize("days", [None, 5])
def test_store_agrees_with_latest_after_each_batch(spark, tmp_path, days):
    kept = merge.Store(spark, str(tmp_path / "s"), ["key"], "ts", "id", buckets=4, days=days)
    assert kept.read() is None
    log = []
    for number, batch in enumerate([_log(1, 40), _log(2, 3), [], _log(3, 25)]):
        batch = batch + batch[:2] + log[:1]  # repeated rows, and one that an earlier batch had
        kept.merge(spark.createDataFrame(batch, SCHEMA), number)
        kept.merge(spark.createDataFrame(_log(9, 5), SCHEMA), number) if batch else None  # a number that has been taken in
        log += batch
        want = store.latest(spark.createDataFrame(log, SCHEMA), ["key"], "ts", "id")
        if days:
            want = store.retained(want, "ts", max(r[1] for r in log), days)
        assert sorted(map(str, kept.read().select("key", "ts", "id", "v").collect())) == sorted(map(str, want.select("key", "ts", "id", "v").collect()))
    before = sorted(map(str, kept.read().collect()))
    assert kept.vacuum(1) >= 1 and sorted(map(str, kept.read().collect())) == before


def test_stream_merges_and_restarts(spark, tmp_path):
    rows = _log(4, 60)
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = merge.Store(spark, str(tmp_path / "s"), ["key"], "ts", "id", buckets=4)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = kept.follow(stream, str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    want = store.latest(spark.createDataFrame(rows, SCHEMA), ["key"], "ts", "id")
    assert sorted(map(str, kept.read().select("key", "id").collect())) == sorted(map(str, want.select("key", "id").collect()))


def test_json_there_and_back(spark):
    df = spark.createDataFrame([(1, 2, "x"), (2, None, None)], "id int, a int, b string")
    text = merge.with_json(df, ["a", "b"], "j")
    assert {r.id: r.j for r in text.collect()} == {1: '{"a":2,"b":"x"}', 2: "{}"}
    assert merge.from_json(text, "j", "a int, b string").exceptAll(df).count() == 0
    assert merge.from_json(spark.createDataFrame([(1, "not json"), (2, None)], "id int, j string"), "j", "a int").where("a IS NOT NULL").count() == 0


def test_queries_send_python_small_batches(spark):
    """A worker holds at most a batch of texts, however many rows a partition has."""
    import pyarrow as pa

    from lumora.plans import catalog

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    catalog.table(spark, "/root/testdata/sf0.001", "documents")
    sizes = spark.range(0, 3500, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 3500 and max(r.n for r in sizes) <= 1000
