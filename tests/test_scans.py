"""Scanned trees, language hints, sample checks and the dashboard's files on rows with known answers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from lumora.functions import languages as L
from lumora.functions import tokens as K
from lumora.operators import bi, rules
from lumora.sources import files

PYTHON = "import os\nimport re\nfrom a import b\n" + "def f(x):\n    return x\n" * 8 + "class A:\n    pass\nif x and y or not z:\n    for i in x:\n        while True:\n            break\ntry:\n    pass\nexcept E:\n    raise\nfinally:\n    yield 1\n"


def test_extension_is_a_hint(spark):
    rows = [(1, PYTHON, "a.py"), (2, PYTHON, "a.rs"), (3, "dog", "a.py"), (4, None, "a.py"), (5, " \n", "x.java"), (6, PYTHON, None), (7, PYTHON, "noext"), (8, PYTHON, "A.PY")]
    df = spark.createDataFrame(rows, "id int, code string, path string")
    scores = L.scores(F.col("code"), L.distinct_words(F.col("code")))
    out = {r.id: (r.t.language, r.t.confidence) for r in df.select("id", L.hinted(F.col("code"), F.col("path"), scores).alias("t")).collect()}
    assert all(out[i][0] == "python" and out[i][1] > 0.3 for i in (1, 2, 6, 7, 8)) and out[3] == out[4] == out[5] == ("unknown", 0.0)
    shaped = df.where("id = 1").select(L.scores(F.col("code"), L.distinct_words(F.col("code")))["java"].alias("x")).head().x
    assert shaped < 0.3  # so a wrong extension is no hint


def test_statistics_and_top(spark):
    df = spark.createDataFrame([(1, PYTHON), (2, ""), (3, "DEF x: IMPORT y")], "id int, code string")
    words = L.distinct_words(F.col("code"))
    stats = {r.id: {s.language: s for s in r.s} for r in df.select("id", L.statistics(F.col("code"), words).alias("s")).collect()}
    assert set(stats[1]) == set(L.WORDS) and stats[1]["python"].pattern_matches == 8 + 1 + 3 and stats[1]["python"].keywords_found > 15
    assert stats[2]["python"].keywords_found == 0 and stats[2]["rust"].confidence == 0
    assert stats[3]["python"].keywords_found == 2 and stats[3]["python"].pattern_matches == 0
    best = {r.id: [t.language for t in r.t] for r in df.select("id", L.top(L.scores(F.col("code"), words)).alias("t")).collect()}
    assert best[1][0] == "python" and len(best[1]) == 3 and best[2] == list(L.WORDS)[:3]  # ties: the order of the languages


def test_samples_are_validated(spark):
    rows = [
        (1, "def f(x):\n    return x\n", "python"), (2, "def longer(x:\n", "python"), (14, "def f(x:", "python"), (3, "x = 1", "python"), (4, None, "python"), (5, "  \n", "java"), (6, "x = 1\n" * 10_000, "python"),
        (7, "public static void main; import x; class A", "java"), (8, "const f = () => require('a')", "javascript"), (9, "def f( class import ", "go"), (10, "return outside of it", "python"), (11, "x = '\x00' + 'abc'", "python"),
        (12, "(" * 5000 + ")" * 5000, "python"), (13, "plain text here", None),
    ]
    df = spark.createDataFrame(rows, "id int, code string, lang string").withColumn("length", F.lit("clash"))
    out = {r.id: r for r in rules.validated(df, "code", "lang").collect()}
    assert out[1].is_valid and out[1].issues == [] and out[1].has_functions and not out[1].has_classes and out[1].length == 23
    assert not out[2].is_valid and out[2].issues[0].startswith("Python syntax error") and len(out[2].issues) == 1
    assert [x.split(" ")[0] for x in out[14].issues] == ["Code", "Python"]
    assert not out[3].is_valid and out[3].issues == ["Code too short (< 10 characters)"]
    assert out[4].issues == out[5].issues == ["Empty code sample"] and out[4].length is None and not out[5].has_imports
    assert out[6].issues == ["Code too long (> 50,000 characters)"]
    assert out[7].is_valid and out[7].has_main_method and out[7].has_imports and out[7].has_classes and not out[7].has_functions
    assert out[8].is_valid and out[8].has_functions and out[8].has_imports and not out[8].has_main_method
    assert out[9].is_valid and not out[9].has_functions and not out[10].is_valid and not out[11].is_valid and not out[12].is_valid and out[13].is_valid


def test_trees_are_scored_and_ordered(spark):
    rows = [("b/x.py", "aa", 1, 0.4), ("a/y.py", "bb", 0, 0.9), ("c.py", None, 1, 0.8), ("d.py", " ", 0, 0.8), ("e.py", "cc", 1, 0.7), (".git/f.py", "dd", 1, 1.0), ("g.py", "ee", None, 0.5), ("h.py", "ff", 0, None)]
    df = files.scan_tree(spark.createDataFrame(rows, "path string, text string, p int, c double"))
    out = [(r.path, r.prediction, r.confidence) for r in files.scored_tree(df, F.col("p"), F.col("c")).collect()]
    assert out[:2] == [("e.py", "AI", 0.7), ("b/x.py", "AI", 0.4)] and out[-2:] == [("a/y.py", "Human", 0.9), ("h.py", "Human", 0.0)]
    assert sorted(out[2:-2]) == [("c.py", "Error", 0.0), ("d.py", "Error", 0.0), ("g.py", "Error", 0.0)]
    empty = spark.createDataFrame([], "path string, text string, p int, c double")
    assert files.scored_tree(files.scan_tree(empty), F.col("p"), F.col("c")).count() == 0


def test_similarity_of_token_classes(spark):
    rows = [(1, "def f(x): return x", "def g(x): return x"), (2, "", None), (3, "a 1", None), (4, "x = 'a b'", "y = 'a b'")]
    out = {(r.id, r["class"]): r.similarity for r in K.similarities(spark.createDataFrame(rows, "id int, a string, b string"), "id", "a", "b").collect()}
    assert out[1, "keywords"] == 1.0 and out[1, "delimiters"] == 1.0 and out[1, "identifiers"] == 3 / 5 and (1, "numbers") not in out
    assert not any(i == 2 for i, _ in out) and out[3, "numbers"] == 0.0 and out[4, "strings"] == 1.0


def test_dashboard_files(spark):
    folder = f"/tmp/checkpoints/test-{uuid.uuid4().hex}"
    predicted = spark.createDataFrame([(1, "h", "python", 1, 0.5, "m", "2024-01-31", "import a")], "id int, code_hash string, language string, prediction int, confidence double, model_name string, timestamp string, code string")
    scores = spark.createDataFrame([("m", "f1", None, 0.5), ("m", "auc", None, None)], "model string, metric string, value double, weighted_value double")
    weights = spark.createDataFrame([("token_a", 0.1), ("zz", 0.9)], "feature string, importance double")
    paths = bi.dashboard(folder, predicted, scores, weights, spark.createDataFrame([(3, "x")], "n int, name string"))
    read = {name: spark.read.option("header", True).csv(paths[name]).collect() for name in ("predictions", "performance", "features")}
    assert len(read["predictions"][0]) == 9 and sorted((r.metric, r.value) for r in read["performance"]) == [("auc", "0.0"), ("f1", "0.5")]
    assert [(r.feature, r.category, r["rank"]) for r in sorted(read["features"], key=lambda r: r["rank"])] == [("zz", "other", "1"), ("token_a", "lexical", "2")]
    assert [json.loads(r.value) for r in spark.read.text(paths["stats"]).collect()] == [{"n": 3, "name": "x"}]
