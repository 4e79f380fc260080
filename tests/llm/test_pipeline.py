"""The pipeline's stages against brute force on a small documents table."""

from __future__ import annotations

import hashlib
import math
import shutil
import threading
import uuid
from collections import Counter

import pytest

from lumora.llm import plan
from tests.llm.test_near import jaccard, shingle_set
from tests.llm.test_operators import ROWS, SCHEMA, WORD, brute_targets, clash


@pytest.fixture(scope="module")
def folder(spark):
    path = f"/tmp/checkpoints/test-{uuid.uuid4().hex}"
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{path}/documents.parquet")
    yield path
    shutil.rmtree(path)


def brute_near(rows):
    """Ids that stay: the smallest of each component of Jaccard >= 0.8, null only where there is no other."""
    sets = [shingle_set(r.text or "") for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    groups = {}
    for r, row in zip(root, rows):
        groups.setdefault(r, []).append(row.doc_id)
    return Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())


def brute_cut(rows):
    """Words that stay of each document, by id: those in no window that started earlier."""
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: -1 if r.doc_id is None else r.doc_id):
        words, gone = WORD.findall(r.text or ""), set()
        for i in range(len(words) - 19):
            if tuple(words[i : i + 20]) in seen:
                gone.update(range(i, i + 20))
            seen.add(tuple(words[i : i + 20]))
        out[r.doc_id] = [w for i, w in enumerate(words) if i not in gone]
    return out


def brute_mix(rows):
    """Copies of each document, by id."""
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    target, out = brute_targets(sizes), Counter()
    for r in rows:
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0.0
        draw = int(hashlib.md5(f"mix:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        out[r.doc_id] += math.floor(rate) + (draw < rate - math.floor(rate))
    return +out


def test_stages_are_those_of_brute_force(spark, folder):
    """Each stage on its predecessor's rows with columns besides that are named like its own."""
    import corpus_pipeline as cp

    tables = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in cp.STAGES:
        out = stage(spark, clash(tables[-1]), folder)
        tables.append(spark.createDataFrame(out.collect(), out.schema))
    good, single, cut, mixed, encoded = (t.collect() for t in tables[1:])
    assert all(t.columns == list(cp.COLUMNS) for t in tables[1:5])
    assert good and all(len(WORD.findall(r.text)) >= 10 for r in good)
    assert Counter(r.doc_id for r in single) == brute_near(good) and len(single) < len(good)
    assert {r.doc_id: WORD.findall(r.text or "") for r in cut} == brute_cut(single) and len(cut) == len(single)
    assert sum(len(r.text) for r in cut) < sum(len(r.text) for r in single)
    assert Counter(r.doc_id for r in mixed) == brute_mix(cut)
    assert sum(r["sample"] == 0 for r in encoded) == len(mixed) and all(r.lossless for r in encoded)


def test_stages_take_an_empty_table(spark):
    import corpus_pipeline as cp

    path = f"/tmp/checkpoints/test-{uuid.uuid4().hex}"
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{path}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, empty, path)
        assert out.count() == 0 and (k == len(cp.STAGES) - 1 or out.columns == list(cp.COLUMNS))
    assert cp.run(spark, path).count() == 0
    shutil.rmtree(path)


def test_a_run_leaves_the_tables_of_other_threads(spark):
    made = []
    other = threading.Thread(target=lambda: made.append(plan.materialize(spark.range(5), "other")))
    before = plan.tables_made()
    other.start()
    other.join()
    own = plan.materialize(spark.range(3), "own")
    plan.sweep(before, own)
    assert made[0].count() == 5 and own.count() == 3
    plan.drop(made[0])
    plan.drop(own)


def test_run_gives_the_last_stage(spark, folder):
    import corpus_pipeline as cp

    out = cp.run(spark, folder)
    assert out.columns[:3] == ["doc_id", "sample", "n_pieces"] and out.count() > 0
    assert 4 <= len(cp.STAGES) <= 5 and cp.ORACLE_SQL is None


def test_entry_lists_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert sorted({int(n[2:].split("_")[0]) for n in names if n.startswith("op")}) == list(range(1, 14)) and "pipeline" in names
