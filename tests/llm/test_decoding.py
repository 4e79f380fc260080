"""The registered query and the pipeline's last stage decode what they encode."""

from __future__ import annotations

import shutil
import uuid

from lumora.llm import queries
from tests.llm.test_operators import ROWS, SCHEMA


def test_query_and_stage_decode_every_document(spark):
    import corpus_pipeline as cp

    path = f"/tmp/checkpoints/test-{uuid.uuid4().hex}"
    docs = spark.createDataFrame(ROWS, SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    try:
        for out in (queries.op9_segment_sampling(spark, path), cp.encode_pieces(spark, docs, path)):
            rows = out.collect()
            assert sum(r["sample"] == 0 for r in rows) == len(ROWS) and all(r.lossless is True for r in rows)
    finally:
        shutil.rmtree(path)


def test_the_trie_steps_as_its_pieces_do_and_slices_change_nothing(monkeypatch, spark):
    """Steps through direct slots are those of the pieces; a unit's lattice is built once in a slice, whose size decides nothing."""
    import random

    import numpy as np

    from lumora.llm import segsample
    from lumora.llm.queries import tokenizer_path

    v = segsample.vocabulary(tokenizer_path("piece"))
    for i in range(300, len(v.surface), 97):
        node = int(v.root[v.surface[i][0]])
        for b in v.surface[i][1:]:
            node = int(v.step(np.array([node]), np.array([b]))[0])
        assert v.surface[int(v.piece_at[node])] == v.surface[i]
    assert len(v.child_key) < len(v.slot_key) // 8  # most steps need no search
    rng = random.Random(8)
    words = ["".join(rng.choices("aeinrst", k=rng.randint(1, 9))) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=200))) for i in range(40)], "doc_id long, text string").coalesce(1)
    got = []
    for size in (2000, segsample.SLICE):
        monkeypatch.setattr(segsample, "SLICE", size)
        got.append(sorted((r.doc_id, r.sample, bytes(r.ids)) for r in segsample.sample_segmentations(docs, tokenizer_path("piece")).collect()))
    assert got[0] == got[1] and len(got[0]) == 80
