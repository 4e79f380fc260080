"""Each query against its SQL on the smallest tables, and edge rows of the survey rules against plain Python."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from lumora.operators import survey
from lumora.plans import catalog, code_catalog, ensemble_catalog, frame_catalog, language_catalog, learn_catalog, model_catalog, program_catalog, scan_catalog, validation_catalog  # noqa: F401 - the others add their queries to the first

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b) -> bool:
    if isinstance(a, (int, float)) and b is not None:
        return math.isclose(float(a), float(b), rel_tol=1e-8, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    relation = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == cols
    key = lambda r: [str(x) if not isinstance(x, float) else f"{x:.6f}" for x in r]
    expect = sorted(([r[names.index(c)] for c in cols] for r in relation.fetchall()), key=key)
    got = sorted(([r[c] for c in cols] for r in df.collect()), key=key)
    assert len(got) == len(expect)
    assert all(same(x, y) for g, e in zip(got, expect) for x, y in zip(g, e))


def test_silent_rules_fire_on_edge_rows(spark):
    rows = [(1, "aaaaaaaaaaaa no"), (2, "what!!! is this"), (3, "12345 67890 12345 67890 #### 12"), (4, None), (5, ""), (6, "x" * 40), (7, "qz7#Kp2@Lm9$Xv4%Rt6^Bn1&Yw3*Ud8(Jf5)Hs0-Gc_Ea+Io=[]{};:<>?/|~"), (8, "same words here now"), (9, "same  words here now "), (10, "same words here now")]
    out = {r.id: r for r in survey.score(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert len(out) == len(rows)
    assert "repeated_characters" in out[1].reasons and "excessive_punctuation" in out[2].reasons and "low_alpha_ratio" in out[3].reasons
    assert "noisy_text_entropy" in out[7].reasons and "low_entropy" in out[6].reasons and "many_exact_duplicates" in out[9].reasons
    assert out[4].n_words == 1 and all(0 <= r.risk_score <= 1 for r in out.values())


def test_stream_scores_as_batch_does(spark, tmp_path):
    from lumora.streaming import scorer

    df = spark.createDataFrame([(i, f"text number {i} !!!") for i in range(20)], "id int, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = scorer.score_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.id, r.risk_score, r.reasons) for r in spark.sql("SELECT * FROM scored").collect()}
    assert got == {(r.id, r.risk_score, r.reasons) for r in survey.score(df, duplicates=False).collect()}


def test_code_files(spark, tmp_path):
    from lumora.sources import files

    for folder, name, text in (("ai", "a.py", "x = 1\n" * 20), ("human", "b.py", "short"), ("human", "c.js", "let y = 2;\n" * 10), ("human", "d.txt", "z" * 100)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    got = {(r.path.rpartition("/")[2], r.label) for r in files.read_code_files(spark, str(tmp_path)).collect()}
    assert got == {("a.py", 1), ("c.js", 0)}
    files.write_csv(spark.createDataFrame([(1, 'a "b",\nc')], "k int, v string"), str(tmp_path / "csv"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "csv")).collect()] == [(1, 'a "b",\nc')]
