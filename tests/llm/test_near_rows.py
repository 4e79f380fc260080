"""The near-copy stage tells rows apart by their values: repeated and null ids."""

from __future__ import annotations

import random

from tests.llm.test_operators import SCHEMA


def test_one_row_of_each_group_not_of_each_id(spark):
    import corpus_pipeline as cp

    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    one, two, three, four = (" ".join(rng.choices(vocab, k=80)) for _ in range(4))
    rows = [(1, one, "en", "a", 1), (5, one, "en", "a", 1), (5, two, "en", "a", 2), (7, three, "en", "a", 3), (7, three, "en", "a", 3)]
    rows += [(None, three, "en", "a", 3), (None, four, "en", "a", 4), (None, four, None, "a", 4)]
    kept = cp.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, one), (5, two), (7, three), (0, four)])
