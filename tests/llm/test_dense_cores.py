"""Cores of near-equal vectors: links counted by bounds and by blocks equal brute force."""

from __future__ import annotations

import numpy as np
import pytest

from lumora.llm import dense_cores, embed_graph


def around(rng, centre, degrees, n):
    """n vectors at the given angles, low to high, from the centre."""
    d = len(centre)
    side = rng.normal(size=(n, d))
    side -= np.outer(side @ centre, centre)
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    t = np.radians(rng.uniform(*degrees, size=n))[:, None]
    return np.cos(t) * centre + np.sin(t) * side


def brute(x, least=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= least
    np.fill_diagonal(hit, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            return hit.sum(axis=1), label
        label = new


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(dense_cores, "BLOCK", 40)
    monkeypatch.setattr(dense_cores, "VISITORS", 30)


def test_counts_equal_brute_force(spark, small_blocks):
    """A tight core, one whose members reach the rim, two cores near each other, vectors around them, copies, lone vectors."""
    rng = np.random.default_rng(4)
    a, b, c = (v / np.linalg.norm(v) for v in rng.normal(size=(3, 12)))
    beside = around(rng, c, (21, 21), 1)[0]
    x = np.vstack((
        around(rng, a, (0, 0.2), 600), around(rng, a, (17.9, 18.5), 60), around(rng, a, (30, 40), 20),
        around(rng, b, (0, 9), 500), around(rng, b, (9.2, 27), 80),
        around(rng, c, (0, 5), 300), around(rng, beside, (0, 5), 300), rng.normal(size=(300, 12)),
    ))
    x = np.vstack((x, x[:30], x[700:730]))
    order = rng.permutation(len(x))
    x = x[order]
    links, label = brute(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    classes = df.selectExpr("vec_id AS id", "1L AS n", "embedding AS vec")
    _, centres = embed_graph._sample(classes, len(x), 150, 1 << 14, 0.95)
    assert len(centres[12]) >= 4
    out = {r.vec_id: r for r in embed_graph.near_duplicates(df, shard_size=150).collect()}
    assert [out[i].n_links for i in range(len(x))] == links.tolist()
    assert [out[i].component_id for i in range(len(x))] == label.tolist()


def test_a_hot_core_is_counted_without_a_shard(spark):
    """16000 near-equal vectors of 20000: exact counts, and no shard sees them."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    x = np.vstack((around(rng, centre / np.linalg.norm(centre), (0, 3), 16000), rng.normal(size=(4000, 16)))).astype(np.float64)
    classes = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "id long, n long, vec array<double>")
    _, centres = embed_graph._sample(classes, len(x), 1500, 1 << 14, 0.95)
    placed = dense_cores.in_cores(classes, centres, 0.95)
    assert placed.where("core IS NULL").count() <= 4000
    assert placed.groupBy("core", "band").count().where("core IS NOT NULL").count() > 1
    out = embed_graph.near_duplicates(classes.selectExpr("id AS vec_id", "vec AS embedding")).where("vec_id < 16000")
    least, most, kept = out.selectExpr("min(n_links)", "max(n_links)", "count_if(kept)").head()
    near = (x[16000:] / np.linalg.norm(x[16000:], axis=1, keepdims=True)) @ (x[:16000] / np.linalg.norm(x[:16000], axis=1, keepdims=True)).T >= 0.95
    assert least == 15999 + near.sum(axis=0).min() and most == 15999 + near.sum(axis=0).max() and kept == 1


def test_no_core_in_other_lengths_or_at_one(spark):
    rng = np.random.default_rng(6)
    x = around(rng, np.eye(8)[0], (0, 1), 64)
    centres, left = dense_cores.fit_cores(x, x[:2], 1.0, 16)
    assert len(centres) == 0 and len(left) == 64
    centres, left = dense_cores.fit_cores(x, x[:2], 0.95, 16)
    assert len(centres) == 1 and len(left) == 0
    classes = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)] + [(100, 1, [1.0, 0.0])], "id long, n long, vec array<double>")
    placed = dense_cores.in_cores(classes, {8: centres}, 0.95)
    assert [r.id for r in placed.where("core IS NULL").collect()] == [100]
    links = embed_graph.class_links(dense_cores.core_links(placed, {8: centres}, 0.95)).collect()
    assert {(r.links, r.pairs) for r in links} == {(63, 63)} and len(links) == 64


def test_the_last_audit_asks_where_links_are(spark):
    """Two near vectors among 3000: one query by hash meets no link, so the linked ones are asked."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16))
    x[1] = x[0] + 0.001
    classes = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "id long, n long, vec array<double>")
    half = spark.createDataFrame([(0, 1, 1, None)], "id long, links long, pairs long, root long")
    found, true, queries = embed_graph.audit_recall(classes, half, 0.95, 3000, queries=2, most=2)
    assert (found, true, queries) == (1, 1, 2)
