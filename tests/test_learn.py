"""Classifiers on rows that can be told apart, trees against counts by hand, near pairs against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from lumora.operators import learn, similarity, trees


@pytest.mark.parametrize("kind", ["random_forest", "logistic", "boosting", "svm"])
def test_classifiers_tell_classes_apart(spark, kind):
    rng = random.Random(3)
    rows = [(i, i % 2, rng.gauss(2.0 if i % 2 else 0.0, 0.5), rng.gauss(0, 1)) for i in range(240)]
    out = learn.cross_predict(spark.createDataFrame(rows, "id int, y int, a double, b double"), "id", ["a", "b"], "y", kind, 2).collect()
    assert sorted(r.id for r in out) == list(range(240))
    assert all(0 <= r.p <= 1 for r in out)
    assert sum((r.p >= 0.5) == (r.y == 1) for r in out) >= 0.9 * len(out)


def test_tree_row():
    row = trees.tree_row('import os\nclass A:\n    """d"""\n    def f(self, x: int) -> int:\n        if x and self:\n            return x\n        return 0\n')
    assert (row["functions"], row["classes"], row["methods"], row["imports"], row["cyclomatic"], row["nesting"], row["documented"]) == (1, 1, 1, 1, 3, 3, 1)
    assert row["return_hints"] == 1.0 and row["argument_hints"] == 0.5 and row["control_flow"] == 3
    assert trees.tree_row("def (") is None and trees.tree_row(None)["nodes"] == 1
    assert trees.tree_row("x = " + "+".join(["1"] * 300))["nodes"] > 600


def test_tree_features_and_compression_of_edge_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "def ("), (4, "x = 1")], "id int, t string")
    got = {r.id: r for r in trees.tree_features(df, "id", "t").collect()}
    assert [got[i].parsed for i in (1, 2, 3, 4)] == [True, True, False, True] and got[4].stores == 1 and got[3].nodes == 0
    assert {r.id: r.c for r in df.select("id", trees.compression_ratio("t").alias("c")).collect()}[1] == 0.0


@pytest.mark.parametrize("attack", ["substitution", "insertion", "deletion", "reordering", "formatting"])
def test_perturbations_repeat(attack):
    text = "\n".join(f"line {i} = value" for i in range(30))
    assert trees.perturb_text(text, attack, "7") == trees.perturb_text(text, attack, "7") != text
    assert isinstance(trees.perturb_text("", attack, "7"), str)


def _brute(texts, least):
    docs = []
    for t in texts:
        w = re.findall(r"\w{2,}", (t or "").lower())
        docs.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    df = Counter(t for d in docs for t in d)
    vectors = []
    for d in docs:
        v = {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in d.items() if df[t] >= 2}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vectors.append({t: x / norm for t, x in v.items()})
    firsts = [i for i, t in enumerate(texts) if t is not None and texts.index(t) == i]
    dots = {(a, b): sum(x * vectors[b].get(t, 0) for t, x in vectors[a].items()) for a in firsts for b in firsts if a < b}
    return {k: v for k, v in dots.items() if v >= least}


def test_near_pairs_are_those_of_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(25)]
    texts += [t.replace(t.split()[3], rng.choice(words), 1) for t in texts[:10]] + [texts[0], texts[0], None, "", "w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.a, r.b): r.similarity for r in similarity.near_pairs(similarity.weighted_terms(df, "id", "text"), 0.6).collect()}
    expect = _brute(texts, 0.6)
    assert got.keys() == expect.keys() and len(got) >= 8
    assert all(math.isclose(got[k], expect[k], rel_tol=1e-9) for k in got)


def test_vectors_meet_without_a_shuffle_of_copies(spark, monkeypatch):
    rng = random.Random(11)
    words = [[f"{s}{i}" for i in range(40)] for s in "xyz"]
    texts = [" ".join(rng.choices(words[i % 3], k=30)) for i in range(90)]
    texts += [t.replace(t.split()[3], rng.choice(words[0]), 1) for t in texts[:30]]
    plans, stored = [], similarity.settled

    def seen(df, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, **options)

    monkeypatch.setattr(similarity, "settled", seen)
    monkeypatch.setattr(similarity, "BLOCK", 8)
    weighted = similarity.weighted_terms(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text")
    got = {(r.a, r.b): r.similarity for r in stored(similarity.near_pairs(weighted, 0.6)).collect()}
    expect = _brute(texts, 0.6)
    assert got.keys() == expect.keys() and len(got) >= 30 and all(math.isclose(got[k], expect[k], rel_tol=1e-9) for k in got)
    assert "hashpartitioning" not in plans[-1]  # the step in which they meet


def test_blocks_are_packed_small_and_unchanged(spark, monkeypatch):
    """As arrays, vectors took nearly as much room in the shuffle as their numbers; blocks come back from their packing bit by bit."""
    rng = random.Random(12)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=120)) for _ in range(400)]
    weighted = similarity.weighted_terms(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").toArrow()
    packed = similarity._bytes(weighted)
    assert similarity._of_bytes(packed).select(weighted.column_names).to_pylist() == weighted.to_pylist()
    assert len(packed) < weighted.nbytes / 4
    alone = similarity._bytes(weighted.slice(7, 1))
    assert similarity._of_bytes(alone).select(weighted.column_names).to_pylist() == weighted.slice(7, 1).to_pylist()
    stored, wide = similarity.settled, []
    monkeypatch.setattr(similarity, "settled", lambda df, **o: (wide.append(dict(df.dtypes)), stored(df, **o))[1])
    similarity.near_pairs(stored(spark.createDataFrame(weighted.slice(0, 50))), 0.6)
    assert [t for t in wide if "low" in t] == [{"block": "bigint", "low": "array<double>", "high": "array<double>", "vectors": "binary"}]


def test_vocabulary_from_buckets_is_that_of_all_terms(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{k * k}" for k in range(60)], [1 / (k + 1) for k in range(60)], k=25)) for _ in range(120)]
    df = spark.createDataFrame([(i, 1 + i % 2, t) for i, t in enumerate(texts)], "rep int, size long, t string")
    counted = similarity.settled(similarity._counted(df, "int"))
    whole = similarity._vocabulary(counted, 50, 2)
    monkeypatch.setattr(similarity, "SAMPLE", 20)
    monkeypatch.setattr(similarity, "BUCKETS", 64)
    some = similarity._vocabulary(counted, 50, 2)
    assert [(r.term, r.df, r.cf, r.texts) for r in some] == [(r.term, r.df, r.cf, r.texts) for r in whole] and len(some) == 50
    assert all(math.isclose(a.mass, b.mass, rel_tol=1e-12) for a, b in zip(some, whole))


def test_terms_are_not_stored_and_copies_are_one_vector(spark, monkeypatch):
    """Lists of all terms took more room than the texts: only vectors of the vocabulary and counts are written."""
    stored, made = similarity.settled, []

    def seen(df, **options):
        made.append(df.columns)
        return stored(df, **options)

    monkeypatch.setattr(similarity, "settled", seen)
    rows = [(1, "a1 b1 c1"), (2, "a1 b1 c1"), (3, "b1 c1 d1"), (4, None), (5, "A1 b1 c1")]
    for extra in ([], [(1, "a1 b1 c1")]):  # unique ids, and a repeated row
        got = similarity.weighted_terms(spark.createDataFrame(rows + extra, "id int, text string"), "id", "text").collect()
        assert sorted(r.rep for r in got) == [1, 3, 5]
    assert made and not any("term" in c and "tf" in c for c in made)


def test_stored_vectors_hold_few_distinct_weights(spark):
    """Weights divided by each text's norm were nearly all distinct, eight bytes each; a file holds each of the others once."""
    rng = random.Random(7)
    texts = [" ".join(rng.sample([f"w{i}" for i in range(40)], k=3 + i % 20)) for i in range(80)]
    got = similarity.weighted_terms(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").collect()
    assert len({x for r in got for x in r.w}) <= len({k for r in got for k in r.ranks}) < sum(len(r.w) for r in got) / 2
    assert all(math.isclose(r.norm, math.sqrt(sum(x * x for x in r.w)), rel_tol=1e-12) for r in got)


def test_stacking_reads_its_input_once_and_kernels_are_those_of_the_matrix(spark, monkeypatch):
    """Each kind of model, and each reader of what they gave, computed the input anew."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F

    made = []
    stored = learn.settled
    monkeypatch.setattr(learn, "settled", lambda df: made.append(df.columns) or stored(df))
    monkeypatch.setattr(learn, "cross_predict", lambda df, key, features, y, kind, k: df.select(key, y, F.col(features[0]).alias("p")))
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(6)], "id int, y int, a double")
    out = learn.stacked(df, "id", ["a"], "y", ("logistic", "boosting"), 2).collect()
    assert sorted((r.id, r.p_logistic, r.p_boosting) for r in out) == [(i, float(i), float(i)) for i in range(6)]
    assert made == [["id", "y", "a"], ["id", "y", "p_logistic", "p_boosting"]]
    points = spark.createDataFrame([([0.5, -1.0],), ([0.0, 2.0],)], "v array<double>").select(array_to_vector("v").alias("v"))
    got = learn.random_features(points, "v", "k", 2, count=16).select(vector_to_array("v").alias("v"), vector_to_array("k").alias("k")).collect()
    rng = np.random.default_rng(42)
    w, b = rng.normal(0, 0.2**0.5, (16, 2)), rng.uniform(0, 2 * np.pi, 16)
    assert len(got) == 2 and all(np.allclose(r.k, np.cos(w @ np.array(r.v) + b) * (2 / 16) ** 0.5, rtol=1e-12) for r in got)
