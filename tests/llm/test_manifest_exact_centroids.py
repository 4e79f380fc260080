"""The manifest, exact duplicates and centroid clusters against brute force, on rows with every edge, and against their SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.llm import centroids, exact, merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows() -> list[tuple]:
    rng = random.Random(11)
    texts = [" ".join(rng.choices("ab é日 c\x0b".split(" ") + ["word"], k=rng.randint(0, 9))) for _ in range(90)] + [None, "", " \n\t\x0b\x0c\r ", "x" * 300_000, "same text", "same  text", " same text", "sametext", " ", " "]
    out = [(i * 7 - 20, t, ["en", None, "", "dé", "z"][i % 5] if i % 9 else "en", rng.choice(["a", None, ""]), None if i % 8 == 3 else len(t or "")) for i, t in enumerate(texts)]
    out += [out[4], out[4], (None, "same text", "en", "a", 9), (None, "other", None, None, None), (14, "one id, two texts", "en", "a", 1)]
    rng.shuffle(out)
    return out


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    names = ("grp", "idx", "n", "node", "path", "row", "id", "at", "range", "leaf", "given", "block", "digest", "chunk", "size", "keep", "all", "points", "v", "cluster")
    return docs.select("*", *[F.lit("x").alias(c) for c in names])


def leaf(row: tuple, more: int = 0) -> str:
    i, text, lang, source, n = row
    cells = (i, source, lang, n + more if n is not None else None, text)
    return sha("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))


def climb(nodes: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root and each node's (left, right) siblings, level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for w, i in zip(ways, at):
            b = i // arity * arity
            w.append(("".join(nodes[b:i]), "".join(nodes[i + 1 : b + arity])))
        at = [i // arity for i in at]
        nodes = [sha("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
    return nodes[0], ways


def expected_manifest(table: list[tuple], arity: int) -> list[tuple]:
    groups = defaultdict(list)
    for r in table:
        groups["" if r[2] is None else "=" + r[2]].append(r)
    subs, out = {}, []
    for g, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[g] = (members, *climb([leaf(r) for r in members], arity))
    order = sorted(subs, key=lambda g: g.encode())
    root, high = climb([subs[g][1] for g in order], arity)
    for g, top in zip(order, high):
        for r, way in zip(subs[g][0], subs[g][2]):
            way = way + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf(r, int(hit))
            for a, b in way:
                now = sha(a + now + b)
            out.append((r[0], leaf(r), subs[g][1], root, sha("".join(a + b for a, b in way)), now, now == root))
    return out


def key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("arity,levels", [(2, 8), (2, 2), (3, 1)])
def test_manifest_equals_brute_force(clashing, arity, levels):
    out = merkle.manifest(clashing, tampered=merkle.sevenths(), arity=arity, levels=levels)
    got = out.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected_manifest(ROWS, arity), key=key)
    assert 0 < sum(not r.verified for r in got) < len(got) / 2


def test_manifest_without_tampering_holds_and_empty_has_none(spark, docs):
    assert merkle.manifest(docs).where("not verified").count() == 0
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    one = merkle.manifest(docs.where("length(text) > 100000")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].path == []


@pytest.mark.parametrize("chunk_rows,fan", [(1 << 16, 16), (3, 2), (1, 4)])
def test_exact_duplicates_equal_brute_force(clashing, chunk_rows, fan):
    got = exact.duplicates(clashing, chunk_rows=chunk_rows, fan=fan).collect()
    groups = defaultdict(list)
    for r in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    expect = []
    for text, members in groups.items():
        best = min(members)
        expect += [(None if none else i, None if best[1] else best[2], len(members), sha(text)) for _, none, i in members]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(expect, key=key)
    stay = [r for r in got if r.kept]
    assert len(stay) == len(groups) == len({r.text_sha256 for r in stay}) and all(r.doc_id == r.keep_id for r in stay)


def test_exact_duplicates_of_nothing_and_of_unlike_texts(spark):
    assert exact.duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    digests = np.zeros((3, 32), np.uint8)
    digests[:, 31] = (2, 1, 2)  # eight like bytes first
    numbers = {c: np.array([1, 2, 3]) for c in exact.NUMBERS} | {"check_bytes": np.ones(3, int), "check_hash": np.ones(3, int)}
    order, out = exact.merge(digests, numbers)
    assert order[:, 31].tolist() == [1, 2] and out["size"].tolist() == [2, 4] and out["row"].tolist() == [2, 3]
    with pytest.raises(ValueError):
        exact.merge(digests, numbers | {"check_bytes": np.array([1, 1, 2])})


def test_nearest_is_exact_where_floats_are_not():
    rng = np.random.default_rng(3)
    for scale in (3, 1000, 1 << 20, centroids.MOST - 1):
        c = rng.integers(-scale, scale + 1, (16, 64))
        c[7], c[9] = c[3], c[3] + np.eye(64, dtype=np.int64)[0]  # a copy, and one a unit away
        x = np.concatenate([rng.integers(-scale, scale + 1, (300, 64)), c, (c[:8] + c[8:]) // 2, c + rng.integers(-1, 2, (16, 64))])
        want = [min(range(16), key=lambda k: (sum((int(a) - int(b)) ** 2 for a, b in zip(v, c[k])), k)) for v in x]
        assert centroids.nearest(x, c).tolist() == want


def brute_clusters(vectors, count=16, rounds=3):
    good = [(i, [int(np.floor(64 * float(v))) for v in e]) for i, e in vectors if e is not None and len(e) == 64 and all(v is not None and np.isfinite(v) for v in e)]
    ranked = sorted(good, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))
    now = [r[1] for r in ranked[:count]]

    def far(x, c):
        return sum((a - b) ** 2 for a, b in zip(x, c))

    def best(x):
        return min(range(len(now)), key=lambda k: (far(x, now[k]), k))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, x in good:
            own[best(x)].append(x)
        now = [[sum(v) // len(own[k]) for v in zip(*own[k])] if k in own else c for k, c in enumerate(now)]
    placed = [(i, best(x), far(x, now[best(x)])) for i, x in good]
    inertia = defaultdict(int)
    for _, k, d in placed:
        inertia[k] += d
    return [(i, k, d, inertia[k], sum(inertia.values()), sha(",".join(map(str, now[k])))) for i, k, d in placed]


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(v) for v in np.float32(rng.normal(size=64) * 2)]) for i in range(120)]
    vectors += [(200 + i, vectors[5][1]) for i in range(6)] + [(5, vectors[6][1]), (None, vectors[7][1]), (None, vectors[8][1])]
    vectors += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [float("nan")] + [0.0] * 63), (305, [None] + [0.0] * 63), (306, [float("inf")] * 64), (307, [0.0] * 64)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("v"), F.lit(2).alias("cluster"), F.lit(3).alias("id")).repartition(3)
    got = [tuple(r) for r in centroids.cluster(df).collect()]
    assert sorted(got, key=key) == sorted(brute_clusters(vectors), key=key)
    few = df.where("vec_id between 300 and 307 or vec_id < 3")
    assert sorted(map(tuple, centroids.cluster(few).collect()), key=key) == sorted(brute_clusters([v for v in vectors if v[0] is not None and (v[0] < 3 or 300 <= v[0] <= 307)]), key=key)
    assert centroids.cluster(df.where("vec_id = 300")).collect() == [] and centroids.cluster(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="don't fit 64 bits"):
        centroids.cluster(spark.createDataFrame([(1, [2.0**21] * 64)], "vec_id long, embedding array<float>")).collect()


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_exact_dedup", "op13_centroid_clusters"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    expect = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expect, key=key)
