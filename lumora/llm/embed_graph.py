"""Embedding near-dedup by a robust-pruned flat graph.

1. Equal vectors form a class, by 128 bits of hash. For each vector length, centroids are fitted on a sample of at most
   2^18 classes in all; every class joins the shards of its `overlap` nearest centroids, and its nearest is its home.
   Where the sample shows a ball of half the threshold's angle with more classes than a shard takes, those classes form a
   core: all of them link, so they are counted and need no shard (`dense_cores.py`).
2. Each shard builds candidate lists and prunes them robustly (a candidate goes if a kept neighbour is nearer to it, by a
   factor, than the node is), then adjacency lists of all shards are united by node.
3. In its home shard each class searches the united graph greedily from the shard's medoid, with a beam, and then goes on
   expanding every node within range until no new one turns up. Cosines that decide are taken in double precision. A link
   that either side finds counts for both; one that two shards can see counts in the smaller one.
4. Queries are compared with all rows, more of them until enough true links are seen. If the recall of links between
   different vectors is below `least_recall`, everything runs again with twice the overlap, and raises if that can't help.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.dense_cores import core_links, fit_cores, in_cores
from lumora.llm.plan import connected_components, drop, materialize
from lumora.llm.vectors import matrix

DEGREE, BEAM, SLACK = 24, 24, 1.2
AUDIT, ENOUGH, MOST_QUERIES = 512, 400, 1 << 13  # queries of the first audit, true links that settle it, and its end


def fit_centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from a fixed start."""
    c = x[np.random.default_rng(3).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 2048] @ c.T, axis=1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = 3 * DEGREE, slack: float = SLACK) -> list[np.ndarray]:
    """Each row's neighbours: nearest first, without those that a nearer kept one stands for."""
    n, k = len(x), min(candidates, len(x) - 1)
    out = []
    for s in range(0, n, 512):
        sims = x[s : s + 512] @ x.T
        rows = np.arange(len(sims))
        sims[rows, s + rows] = -np.inf
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < n else np.argsort(-sims, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        away = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(sims, near, axis=1), 0))
        alive, kept = np.ones(near.shape, bool), np.full((len(near), degree), -1)
        for d in range(degree):
            has = alive.any(axis=1)
            if not has.any():
                break
            pick = np.argmax(alive, axis=1)
            chosen = near[rows, pick]
            kept[has, d] = chosen[has]
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("qkd,qd->qk", x[near], x[chosen]), 0))
            alive &= slack * between > away
            alive[rows, pick] = False
        out += [r[r >= 0] for r in kept]
    return out


def greedy_range(x: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, least: float, beam: int = BEAM):
    """(query, found) pairs of rows with cosine >= least that the search from the medoid reaches, block by block of queries."""
    n = len(x)
    degree = max([1, *map(len, graph)])
    table = np.full((n, degree), n)
    for i, g in enumerate(graph):
        table[i, : len(g)] = g
    padded = np.vstack((x, np.zeros(x.shape[1])))
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    block = max(16, min(512, (1 << 25) // (n + 1), (1 << 22) // (degree * 8)))
    for s in range(0, len(queries), block):
        q = queries[s : s + block]
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True
        seen[:, medoid] = True
        ids = np.full((len(q), beam), n)
        sims = np.full((len(q), beam), -2.0)
        done = np.ones((len(q), beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = medoid, x[q] @ x[medoid], False
        while not done.all():
            open_ = np.where(done, -3.0, sims)
            pick = np.argmax(open_, axis=1)
            live = np.flatnonzero(open_[rows, pick] > -3.0)
            done[live, pick[live]] = True
            new = table[ids[live, pick[live]]]
            fresh = ~seen[live[:, None], new]
            new = np.where(fresh, new, n)
            seen[live[:, None], new] = True
            got = np.where(fresh, np.einsum("qkd,qd->qk", padded[new], x[q[live]]), -2.0)
            all_ids = np.concatenate((ids[live], new), axis=1)
            all_sims = np.concatenate((sims[live], got), axis=1)
            all_done = np.concatenate((done[live], ~fresh), axis=1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live], sims[live], done[live] = (np.take_along_axis(a, top, axis=1) for a in (all_ids, all_sims, all_done))
        # range expansion: what is in range leads on, however many there are; a node is compared once with the whole block
        in_range = (sims >= least) & (ids < n)
        own = np.zeros((len(q), n), bool)
        own[np.nonzero(in_range)[0], ids[in_range]] = True
        own[rows, q] = True
        checked = np.zeros(n, bool)
        front = np.flatnonzero(own.any(axis=0))
        while len(front):
            near = np.zeros(n + 1, bool)
            near[table[front].ravel()] = True
            near[front] = True
            near = np.flatnonzero(near[:n] & ~checked)
            checked[near] = True
            close = x[q] @ x[near].T >= least
            new = close & ~own[:, near]
            own[:, near] |= close
            front = near[new.any(axis=0)]
        own[rows, q] = False
        found = np.nonzero(own)
        yield q[found[0]], found[1]


def _sample(classes: DataFrame, n: int, shard_size: int, sample_size: int, least: float) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Centroids and centres of cores of each vector length that has more classes than a shard takes, from a sample chosen by hash."""
    size = min(1 << 18, max(sample_size, 8 * n // shard_size))
    share = min(1.0, size / max(n, 1))
    counts = dict(classes.groupBy(F.size("vec")).count().where(F.col("count") > shard_size).collect())
    picked = classes.where(F.pmod(F.xxhash64("id", F.lit("centroid")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vec").limit(2 * size).toArrow()
    lengths = pc.list_value_length(picked["vec"]).to_numpy()
    out, cores = {}, {}
    for d, held in counts.items():
        x = matrix(picked["vec"].filter(pa.array(lengths == d))) if (lengths == d).any() else np.zeros((0, d))
        if len(x) >= 16:
            x = x[np.lexsort(x.T)]
            shards = max(1, min(-(-held // shard_size), len(x) // 8))
            fitted = fit_centroids(x, shards)
            centres, outside = fit_cores(x, fitted, least, max(16, shard_size * len(x) // held))
            if len(centres):
                cores[int(d)] = centres
                shards = max(1, min(-(-held * len(outside) // (len(x) * shard_size)), len(outside) // 8))
                fitted = fit_centroids(outside, shards) if shards > 1 else None
            if fitted is not None:
                out[int(d)] = fitted
    return out, cores


def _members(classes: DataFrame, centroids: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """A row for each shard of each class; shards holds all of them, the home first."""

    def place(batches):
        for b in batches:
            lengths = pc.list_value_length(b.column("vec")).to_numpy()
            for d in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == d))
                n = part.num_rows
                c = centroids.get(d)
                take = 1 if c is None else min(overlap, len(c))
                near = np.zeros((n, 1), np.int64) if c is None else np.argsort(-(matrix(part.column("vec")) @ c.T), axis=1, kind="stable")[:, :take]
                shards = near + (d << 24)
                rows = pa.array(np.repeat(np.arange(n), take))
                of = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * take), pa.array(shards.ravel()))
                home = np.tile(np.arange(take) == 0, n)
                yield pa.RecordBatch.from_arrays([pa.array(shards.ravel()), pa.array(home), of.take(rows), *(part.column(k).take(rows) for k in ("id", "n", "vec"))], ["shard", "home", "shards", "id", "n", "vec"])

    return classes.select("id", "n", "vec").mapInArrow(place, "shard long, home boolean, shards array<long>, id long, n long, vec array<double>")


def _build(table: pa.Table) -> pa.Table:
    ids, x = table["id"].to_numpy(), matrix(table["vec"])
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    graph = robust_prune(x) if len(x) > 1 else [np.zeros(0, int)] * len(x)
    a = np.repeat(ids, [len(g) for g in graph])
    b = ids[np.concatenate([*graph, np.zeros(0, int)]).astype(int)]
    pairs = np.unique(np.stack((np.concatenate((a, b)), np.concatenate((b, a))), axis=1), axis=0)  # edges lead both ways
    edges = np.flatnonzero(np.concatenate((pairs[1:, 0] != pairs[:-1, 0], [True]))) if len(pairs) else np.zeros(0, int)
    lists = np.split(pairs[:, 1], edges[:-1] + 1) if len(pairs) else []
    return pa.table({"node": pa.array(pairs[edges, 0] if len(pairs) else [], pa.int64()), "to": pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))})


def _search(least: float):
    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, x, n = table["id"].to_numpy(), matrix(table["vec"]), table["n"].to_numpy()
        here, size = table["shard"][0].as_py(), len(ids)
        graph = []
        for to in table["to"].to_pylist():
            to = np.unique(np.array(to or [], np.int64))
            at = np.minimum(np.searchsorted(ids, to), size - 1)
            graph.append(at[ids[at] == to])
        is_home = table["home"].to_numpy(zero_copy_only=False)
        home = np.flatnonzero(is_home)
        shards = table["shards"].to_pylist()
        own_shard = np.array([s[0] for s in shards])
        held = np.full((size, max(map(len, shards))), -1, np.int64)
        for i, s in enumerate(shards):
            held[i, : len(s)] = s
        bits = np.zeros((size, -(-size // 8)), np.uint8)  # which pairs of home members were found, a bit each
        links, pairs = np.zeros(size, np.int64), np.zeros(size, np.int64)
        root, touched = np.arange(size), np.zeros(size, bool)
        for q, f in greedy_range(x, graph, home, least):
            touched[q] = touched[f] = True
            inner = is_home[f]
            np.bitwise_or.at(bits, (q[inner], f[inner] // 8), (128 >> (f[inner] % 8)).astype(np.uint8))
            a, b = q[~inner], f[~inner]
            # the visitor's home sees the pair too if the query is a visitor there; then the smaller shard counts it
            both = (held[a] == own_shard[b][:, None]).any(axis=1)
            mine = ~both | (here < own_shard[b])
            a, b = a[mine], b[mine]
            for one, two in ((a, b), (b, a)):
                links += np.bincount(one, n[two], size).astype(np.int64)
                pairs += np.bincount(one, minlength=size)
            while True:  # a forest over the links, so that a dense group sends no more rows than it has members
                low, high = np.minimum(root[q], root[f]), np.maximum(root[q], root[f])
                if (low == high).all():
                    break
                np.minimum.at(root, high, low)
                while not (root[root] == root).all():
                    root = root[root]
        for s in range(0, size, 512):  # a link that either side found counts for both
            found = np.unpackbits(bits[s : s + 512], axis=1, count=size).astype(bool)
            found |= np.unpackbits(bits[:, s // 8 : s // 8 + 64], axis=1)[:, : len(found)].T.astype(bool)
            links[s : s + 512] += found @ n
            pairs[s : s + 512] += found.sum(axis=1)
        counted = np.flatnonzero(is_home | (links > 0))
        other = np.flatnonzero(touched & (root != np.arange(size)))
        rows = np.concatenate((counted, other))
        kind = np.repeat([True, False], [len(counted), len(other)])
        return pa.table({"id": ids[rows], "links": pa.array(np.where(kind, links[rows], 0)), "pairs": pa.array(np.where(kind, pairs[rows], 0)), "root": pa.array(ids[root[rows]], mask=kind)})

    return search


def link_classes(classes: DataFrame, centroids: dict[int, np.ndarray], least: float, overlap: int) -> DataFrame:
    """(id, links, pairs, root): parts of each class's links, by rows and by classes, and rows that join a class to another of its component."""
    members = materialize(_members(classes, centroids, overlap), "members")
    lists = members.select("shard", "id", "vec").groupBy("shard").applyInArrow(_build, "node long, to array<long>")
    graph = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to"))  # overlap * degree at most, both ways
    full = members.join(graph, members.id == graph.node, "left").select("shard", "home", "shards", "id", "n", "vec", "to")
    found = materialize(full.groupBy("shard").applyInArrow(_search(least), "id long, links long, pairs long, root long"), "links")
    drop(members)
    return found


def class_links(found: DataFrame) -> DataFrame:
    """(id, links, pairs) of each class."""
    return found.where("root IS NULL").groupBy("id").agg(F.sum("links").alias("links"), F.sum("pairs").alias("pairs"))


def _true_links(classes: DataFrame, picked: pa.Table, least: float) -> DataFrame:
    """(id, true): how many other classes each picked one links with, by comparison with every class."""
    ids, lengths = picked["id"].to_numpy(), pc.list_value_length(picked["vec"]).to_numpy()
    by_length = {int(d): (ids[lengths == d], matrix(picked["vec"].filter(pa.array(lengths == d)))) for d in np.unique(lengths)}

    def compare(batches):
        for b in batches:
            sizes = pc.list_value_length(b.column("vec")).to_numpy()
            for d in np.unique(sizes).tolist():
                if d in by_length:
                    part = b.filter(pa.array(sizes == d))
                    x, own = matrix(part.column("vec")), part.column("id").to_numpy()
                    of, q = by_length[d]
                    for s in range(0, len(of), 512):
                        hit = (x @ q[s : s + 512].T >= least) & (own[:, None] != of[None, s : s + 512])
                        yield pa.RecordBatch.from_arrays([pa.array(of[s : s + 512]), pa.array(hit.sum(axis=0))], ["id", "true"])

    return classes.select("id", "vec").mapInArrow(compare, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))


def audit_recall(classes: DataFrame, links: DataFrame, least: float, n: int, queries: int = AUDIT, enough: int = ENOUGH, most: int = MOST_QUERIES) -> tuple[int, int, int]:
    """(found, true, queries): links of query classes to other classes, the true ones by comparison with every class.

    Queries are taken by hash, four times as many until `enough` true links are seen, every class is one or there are `most`.
    If none of them has a true link, `most` classes that the search gave a link to are the queries of a last audit.
    """
    counted, linked = class_links(links), False
    while True:
        of = classes.join(counted.where("pairs > 0").select("id"), "id", "left_semi") if linked else classes
        picked = of.select("id", "vec").orderBy(F.xxhash64("id", F.lit("audit"))).limit(queries).toArrow()
        if not picked.num_rows:
            return 0, 0, min(queries, n)
        row = _true_links(classes, picked, least).join(counted, "id", "left").agg(F.sum(F.least("true", F.coalesce("pairs", F.lit(0)))), F.sum("true")).head()
        found, seen = int(row[0] or 0), int(row[1] or 0)
        if seen >= enough or linked or queries >= min(n, most):
            if seen or linked or queries >= n:
                return found, seen, min(queries, n)
            linked = True
        else:
            queries *= 4


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, overlap: int = 3, shard_size: int = 1500, sample_size: int = 1 << 14, least_recall: float = 0.9) -> DataFrame:
    """(id_col, n_links, component_id, kept, audit_recall) of every vector; vectors with a cosine of `least` or more are linked.

    component_id is the smallest id reachable by links, kept says that it is the vector's own. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows with a null id, link with nothing: n_links 0, a component
    of their own. Vectors of different lengths don't link. Equal vectors are one class with all its rows linked, so copies
    never expand to pairs; rows that share id and vector count as links of each other. Other columns are ignored. An empty
    table gives an empty one.

    The search is approximate between different vectors. audit_recall, the same in all rows, is the share of true links
    that the last audit found; 1 if every class was a query and none has a link; null if queries had none, and then a
    warning says that nothing was measured: then neither 8192 classes by hash nor any that the search reached have a link.
    Links within a class and with a core are exact.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(good & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good).withColumns({"h": F.xxhash64("vec"), "g": F.xxhash64(F.lit("second"), "vec")})
    classes = materialize(rows.where("good").groupBy("h", "g").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vec").alias("vec")), "vectors")
    n = classes.count()
    lone = rows.where("NOT good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    ends = [F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")]
    if not n:
        return lone.select(F.col("id").alias(id_col), "n_links", "component_id", *ends, F.lit(None).cast("double").alias("audit_recall"))
    centroids, centres = _sample(classes, n, shard_size, sample_size, least)
    outside, of_cores = classes, None
    if centres:
        placed = materialize(in_cores(classes, centres, least), "placed")
        outside, of_cores = placed.where("core IS NULL").select("id", "n", "vec"), core_links(placed, centres, least)
    most_shards = max([1, *map(len, centroids.values())])
    while True:
        of_shards = link_classes(outside, centroids, least, overlap)
        found_links = of_shards.unionByName(of_cores) if centres else of_shards
        found, true, queries = audit_recall(classes, found_links, least, n)
        if found >= least_recall * true:
            break
        drop(of_shards)
        if overlap >= most_shards:
            raise RuntimeError(f"recall {found} of {true} with every shard of every vector")
        overlap *= 2
    if centres:
        drop(placed)
    recall = found / true if true else 1.0 if queries >= n else None
    if recall is None:
        warnings.warn(f"recall was not measured: {queries} queries have no true link", stacklevel=2)
    groups = connected_components(found_links.where("root IS NOT NULL").select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("h", "g", F.col("id").alias("class"), "n").join(class_links(found_links).withColumnRenamed("id", "class"), "class", "left")
    of_class = of_class.join(groups, F.col("class") == F.col("node"), "left").select(F.col("h").alias("__h"), F.col("g").alias("__g"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "class").alias("component"))
    linked = rows.where("good").join(of_class, (F.col("h") == F.col("__h")) & (F.col("g") == F.col("__g"))).select("id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    return linked.unionAll(lone).select(F.col("id").alias(id_col), "n_links", "component_id", *ends, F.lit(recall).cast("double").alias("audit_recall"))
