"""Projections, cleaning, sampling, metrics, style and learners on edge rows: nulls, empty tables, ties, one class, odd names."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumora.functions import style, text
from lumora.operators import bi, ensemble, frames, learn, metrics, rules, sampling, similarity, store, survey, vectors
from lumora.sources import files


def test_cleaning(spark):
    rows = [(1, None), (2, math.nan), (3, math.inf), (4, -math.inf), (5, 2e6), (6, 1.5)]
    df = spark.createDataFrame(rows, "id int, x double")
    got = {r.id: (r.a, r.b) for r in df.select("id", frames.finite(F.col("x")).alias("a"), frames.clip(F.col("x")).alias("b")).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, 1e6), 4: (0, -1e6), 5: (2e6, 1e6), 6: (1.5, 1.5)}
    assert frames.label_column(df) is None and frames.label_column(df.withColumn("target", F.lit(1))) == "target"
    out = frames.reindex(df, ["x", "gone"], key=["id"])
    assert out.columns == ["id", "x", "gone"] and out.where("x IS NULL OR gone <> 0").count() == 0
    labels = spark.createDataFrame([(None, "/a/ai/x"), (None, "/a/b"), (None, None), (0, "/ai/x")], "y int, p string")
    assert [r[0] for r in labels.select(frames.repaired_label(F.col("y"), F.col("p"))).collect()] == [1, 0, 0, 0]


def test_sampling_keeps_null_labels_and_odd_names(spark):
    rows = [(i, "a" if i % 3 else None, "x", "y") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, label string, n string, copy string")
    for out in (sampling.stratified_split(df, "id", "label"), sampling.stratified_folds(df, "id", "label"), sampling.holdout(df, "id"), sampling.group_folds(df, "label", 2)):
        assert out.count() == 30 and {"n", "copy"} <= set(out.columns)
    sizes = Counter(r.label for r in sampling.oversample(df, "id", "label").collect())
    assert sizes == {"a": 20, None: 20}
    assert Counter(r.label for r in sampling.undersample(df, "id", "label", head=True).collect()) == {"a": 10, None: 10}
    assert Counter(r.label for r in sampling.bootstrap(df, "id", "label").collect()) == {"a": 20, None: 20}
    empty = df.limit(0)
    for f in (sampling.stratified_split, sampling.stratified_folds, sampling.undersample, sampling.oversample, sampling.bootstrap):
        assert f(empty, "id", "label").count() == 0
    assert sampling.group_folds(empty, "label").count() == 0 and sampling.standardize(df.withColumn("v", F.lit(1.0)), ["v"]).where("v_z <> 0").count() == 0


def test_groups_go_to_the_lightest_fold(spark):
    sizes = {"a": 9, "b": 5, "c": 4, "d": 3, "e": 3}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    got = {r.g: r.fold for r in sampling.group_folds(df, "g", 3).distinct().collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 2, "e": 1}


def test_metrics_with_one_class_or_no_rows(spark):
    one = spark.createDataFrame([(0, 0.2), (0, 0.7), (None, 0.5)], "y int, p double")
    assert metrics.roc_auc(one).head()[0] is None and metrics.average_precision(one).head()[0] is None
    assert all(r.tpr is None and r.fpr is not None for r in metrics.curve(one).collect())
    for f in (metrics.roc_auc, metrics.average_precision):
        assert [r[0] for r in f(one.limit(0)).collect()] == [None]
    assert metrics.calibration_error(one.limit(0)).head() == (0.0, 0.0) and len(metrics.reliability(one.limit(0)).collect()) == 10
    # from the definitions, by hand
    df = spark.createDataFrame([(0, 0.2), (1, 0.8), (0, 0.7), (1, 0.9), (0, 0.3)], "y int, p double")
    assert metrics.roc_auc(df).head()[0] == 1.0 and metrics.average_precision(df).head()[0] == 1.0
    assert tuple(metrics.calibration_error(df).head()) == (0.3, 0.7)


def brute_nearest(rows):
    """Nearest other row by TF-IDF cosine, of equal ones the smallest id."""
    import re

    docs = {i: re.findall(r"\w{2,}", t.lower()) for i, t in rows if t is not None}
    terms = {i: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for i, w in docs.items()}
    df = Counter(x for t in terms.values() for x in t)
    weights = {}
    for i, t in terms.items():
        w = {x: c * (math.log((1 + len(rows)) / (1 + df[x])) + 1) for x, c in t.items() if df[x] >= 2}
        norm = math.sqrt(sum(v * v for v in w.values()))
        if norm:
            weights[i] = {x: v / norm for x, v in w.items()}
    out = {}
    for i, a in weights.items():
        best = max(((round(sum(v * b.get(x, 0) for x, v in a.items()), 9), -j) for j, b in weights.items() if j != i), default=(0, 0))
        if best[0] >= 0.92 - 1e-9:
            out[i] = (-best[1], round(best[0], 6))
    return out


def test_near_duplicates_raise_the_score(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)]
    rows = []
    for i in range(25):
        words = rng.choices(vocab, k=25)
        rows.append((len(rows), " ".join(words)))
        if i % 2:
            rows.append((len(rows), " ".join([*words[:-1], rng.choice(vocab)])))
        if i % 5 == 0:
            rows += [(len(rows) + k, rows[-1][1]) for k in range(2)]
    rows += [(900, None), (901, ""), (902, "zz9!!! !!! #### ----"), (903, "zz9!!! !!! #### ----"), (904, "zz9!!! !!! #### ----")]
    out = {r.id: r for r in survey.score(spark.createDataFrame(rows, "id long, text string"), near_id="id").collect()}
    expect = brute_nearest(rows)
    got = {i: (r.near_duplicate_index, r.near_duplicate_similarity) for i, r in out.items() if r.near_duplicate_index >= 0}
    assert got.keys() == expect.keys() and all(got[i][0] == expect[i][0] and math.isclose(got[i][1], expect[i][1], abs_tol=1e-6) for i in got)
    assert out[902].flagged and "near_duplicate" in out[902].reasons and out[900].near_duplicate_similarity == 0.0
    kept, report, flagged = survey.clean(spark.createDataFrame(rows, "id long, text string"), near_id="id")
    row = report.head()
    assert row.flagged == len(flagged.collect()) >= 3 and row.total == kept.count() + row.flagged and "near_duplicate" in row.top_reasons
    assert survey.check(spark, "what!!! is this")["reasons"] == "excessive_punctuation;too_short"
    assert similarity.nearest_rows(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


def test_text_statistics(spark):
    texts = [None, "", "a", "aab", "\U0001f600\U0001f600x", "İé"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.entropy(F.col("t"))).collect()]
    expect = [None, 0.0, 0.0, 0.918296, 0.918296, 1.0]
    assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-6)) for a, b in zip(got, expect))


def test_style_of_machine_text(spark):
    code = 'def load_all_data(x: int) -> str:\n    """A.\n\n    Args:\n        x\n    """\n    first_long_name = second_long_name = third_long_name\n'
    parts = spark.createDataFrame([(1, code), (2, None), (3, "")], "id int, code string").select("id", *[c.alias(n) for n, c in style.style_parts(F.col("code")).items()])
    out = {r.id: (r.m, r.h) for r in parts.select("id", F.expr(style.style_sql(style.MACHINE)).alias("m"), F.expr(style.style_sql(style.HUMAN)).alias("h")).collect()}
    assert math.isclose(out[1][0], 0.55 + 0.5 + 0.5) and out[2] == (0, 0) and out[3] == (0, 0)
    row = spark.createDataFrame([("\tx\n\ty\n z\n\n\n",)], "t string").select(*[c.alias(n) for n, c in {**style.metadata(F.col("t")), **style.blank_runs(F.col("t"))}.items()]).head()
    assert (row.indentation_style, row.total_lines, row.non_empty_lines, row.longest_run, row.line_max) == ("tabs", 6, 3, 3, 2.0)


def test_nearest_vectors_and_blocks(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(40)] + [(100, None), (101, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    whole = {(r.id, r.other) for r in vectors.nearest(df, "id", "v").collect()}
    assert whole == {(r.id, r.other) for r in vectors.nearest(df, "id", "v", block=7).collect()} and len(whole) == 41
    pairs = {(r.a, r.b) for r in vectors.cosine_pairs(df, "id", "v", 0.5, block=7).collect()}
    assert pairs == {(r.a, r.b) for r in vectors.cosine_pairs(df, "id", "v", 0.5).collect()} and all(a < b for a, b in pairs)
    assert vectors.nearest(df.limit(0), "id", "v").count() == 0


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 0.5)], "k long, v string, x double")
    for kind in ("json", "parquet", "csv"):
        files.write_data(df, str(tmp_path / f"t.{kind}"))
        assert files.read_data(spark, str(tmp_path / f"t.{kind}")).count() == 2
    assert files.csv_columns(spark, str(tmp_path / "t.csv")) == ["k", "v", "x"]
    with pytest.raises(ValueError):
        files.read_data(spark, "x.xlsx")
    tree = spark.createDataFrame([("src/a.py", "abcdef"), ("src/vendor/b.py", "x"), ("src/c.txt", "y"), ("lib/d.py", "z"), (None, "q")], "path string, text string")
    assert [tuple(r) for r in files.scan_tree(tree, "src/", ("py",), 5, 3).collect()] == [("src/a.py", "abc")]
    made = files.made_corpus(spark, 5, ("x{i}", "y{i}"), 1)
    assert [r.text for r in made.orderBy("id").collect()] == ["x0", "y1", "x2", "y3", "x4"]


def test_store_and_exports(spark, tmp_path):
    log = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    for _ in range(2):
        store.append(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6 and store.lookup(log, v="a").count() == 1 and store.lookup(log, v=None).count() == 0
    assert tuple(bi.batch_summary(log.limit(0).select(F.lit(1).alias("prediction"), F.lit(0.5).alias("confidence"))).head()) == (0, 0, 0, 0, 0.0, 0.0, 0.0)
    assert bi.histogram(spark.createDataFrame([(0.0,), (1.0,), (None,)], "x double"), "x", 20).count() == 2


def test_feature_changes_keep_the_length(spark):
    df = spark.createDataFrame([(i, [float(k) for k in range(20)]) for i in range(30)], "id long, v array<double>")
    for attack in ("noise", "append", "delete", "swap"):
        rows = df.select(ensemble.perturbed_features(F.col("v"), F.col("id"), attack).alias("w")).collect()
        assert rows == df.select(ensemble.perturbed_features(F.col("v"), F.col("id"), attack).alias("w")).collect()
        assert all(len(r.w) == 20 for r in rows) and any(r.w != [float(k) for k in range(20)] for r in rows)
        if attack == "swap":
            assert all(sorted(r.w) == [float(k) for k in range(20)] for r in rows)


def test_search_importance_and_saving(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, i % 2, rng.gauss(2.0 if i % 2 else 0.0, 0.5), rng.gauss(0, 1)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, y int, a double, b double")
    model, scores = learn.grid_search(df, "id", ["a", "b"], "y", "logistic", 3, {"regParam": (0.01, 5.0)})
    assert len(scores) == 2 and max(s for _, s in scores) > 0.9
    assert learn.importances(model, ["a", "b"])[0][0] == "a"
    learn.save(model, str(tmp_path / "model"))
    again = learn.load(str(tmp_path / "model")).transform(df).select("id", "prediction").collect()
    assert again == model.transform(df).select("id", "prediction").collect()
    assert {r.feature for r in learn.attributions(model, df, ["a", "b"]).collect()} == {"a", "b"}
    assert learn.best_model({"x": 0.4, "y": 0.6, "z": 0.6}) == "y" and learn.model_importance({"x": None, "y": 0.5}) == {"x": 0.0, "y": 1.0}
    texts = spark.createDataFrame([("good words here", 1), ("bad things there", 0), (None, 0)] * 10, "t string, y int")
    made = learn.text_classifier(texts, "t", "y").transform(texts.na.fill("")).select("y", "prediction").collect()
    assert all(r.y == r.prediction for r in made)
    assert learn.cross_predict(df.limit(0), "id", ["a", "b"], "y", "logistic").count() == 0


def test_tree_confidence_by_hand(spark):
    row = spark.sql("SELECT 0.8D AS code_organization_score, 0.6D AS type_hint_ratio, 0.9D AS variable_naming_score, 0.0D AS exception_handling_ratio, 0.2D AS docstring_ratio, 1 AS cyclomatic_complexity, 0 AS function_count, 0 AS class_count")
    out = row.select(*[c.alias(n) for n, c in rules.tree_confidence().items()]).head()
    assert (out.machine, out.human, out.prediction) == (0.8, 0.2, 1) and math.isclose(out.confidence, 0.8)
