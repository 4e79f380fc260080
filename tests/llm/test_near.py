"""The pipeline's near-copy stage against all pairs by brute force."""

from __future__ import annotations

import random

import numpy as np

from lumora.llm import near
from tests.llm.test_operators import SCHEMA


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def planted():
    """Originals, and copies with 1 to 12 words changed: similarities on both sides of 0.8."""
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(500)]
    texts = []
    for _ in range(40):
        words = rng.choices(vocab, k=rng.randint(60, 400))
        texts.append(" ".join(words))
        for changes in rng.sample(range(1, 13), 4):
            copy = list(words)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = rng.choice(vocab)
            texts.append(" ".join(copy))
    base = rng.choices(vocab, k=120)  # a large group: more members than are compared pair by pair
    for _ in range(120):
        copy = list(base)
        copy[rng.randrange(120)] = rng.choice(vocab)
        texts.append(" ".join(copy))
    texts.append(texts[0].upper())
    rng.shuffle(texts)
    return texts


def components(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_stage_drops_near_copies_of_similarity_08(spark):
    import corpus_pipeline as cp

    texts = planted()
    root = components(texts)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = [r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(root))
    assert len(set(root)) < len(texts) - 150


def test_blocks_of_a_large_component_lose_no_link(spark):
    """A component dealt to blocks is linked as in one task."""
    from pyspark.sql import functions as F

    texts = [near.plain(t.encode()) for t in dict.fromkeys(t.lower() for t in planted())]
    rows = [(1, i, s.tobytes()) for i, s in enumerate(near.shingles(texts, 5))]
    members = spark.createDataFrame(rows, "component long, cls long, shingles binary")
    got = []
    for block in (4000, 50):
        linked = {r.cls: r.root for r in near.link_members(members, 0.8, block=block).withColumn("x", F.lit(1)).collect()}
        groups = {}
        for i in range(len(texts)):
            groups.setdefault(linked.get(i, i), set()).add(i)
        got.append(sorted(map(sorted, groups.values())))
    assert got[0] == got[1] and len(got[0]) < len(texts) - 100


def test_shingles_of_short_and_empty_texts():
    sets = near.shingles([near.plain(t) for t in (b"", b" \n", b"a B", b"A  b", b"a b c d e", b"a b c d e f a b c d e")], 5)
    assert [len(s) for s in sets] == [0, 0, 1, 1, 1, 6] and np.array_equal(sets[2], sets[3])
