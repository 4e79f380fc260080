"""Clusters around centroids, in whole numbers: float32 products screen the centroids, whole numbers decide.

For vectors and centroids of whole numbers, |x - c|^2 - |x|^2 = |c|^2 - 2 x.c. The products x.c of a batch are one float32
matrix product. Whatever its order of summation, with or without fused steps, its error is at most g * |x| * |c|, g = k u / (1 -
k u), for k = components + 2 (two for the operands' rounding to float32) and u = 2**-24. So each score lies in an interval; a
centroid whose interval begins above the least upper end is farther than another. Where more than one is left, distances are
computed in 64-bit integers and the smallest number wins ties.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.plan import materialize

MOST = 1 << 27  # below it, squared distances of 64 components fit 64 bits
UNIT = 2.0**-24


def whole(column: pa.ChunkedArray | pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of `width` finite components, and those as integers floor(scale * x)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # older versions leave one chunk
        column = column.chunk(0)
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64())
    numbers, there = values.fill_null(np.nan).to_numpy(zero_copy_only=False), np.diff(offsets) == width
    good = np.flatnonzero(there & column.is_valid().to_numpy(zero_copy_only=False))
    cells = numbers[offsets[good][:, None] + np.arange(width)] if len(good) else np.zeros((0, width))
    finite = np.isfinite(cells).all(1)
    cells = np.floor(cells[finite] * scale)
    if cells.size and np.abs(cells).max() >= MOST:
        raise OverflowError(f"a component of {MOST // scale} or more: squared distances don't fit 64 bits")
    return good[finite], cells.astype(np.int64)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, the smallest number of equally near ones; exact."""
    k = x.shape[1] + 2
    bound = k * UNIT / (1 - k * UNIT)
    long = (c.astype(np.float64) ** 2).sum(1)
    size = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
    products = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    scores = long - 2.0 * products
    slack = 2.0 * bound * size[:, None] * (np.sqrt(long) * (1 + 1e-12)) + 1e-12 * (np.abs(scores) + long)  # the last for doubles
    upper = (scores + slack).min(1)
    left = scores - slack <= upper[:, None]
    out = left.argmax(1)
    row, centroid = np.nonzero(left & (left.sum(1) > 1)[:, None])
    if len(row):
        exact = distances(x[row], c[centroid])
        order = np.lexsort((centroid, exact, row))
        first = np.ones(len(order), bool)
        first[1:] = row[order][1:] != row[order][:-1]
        out[row[order[first]]] = centroid[order[first]]
    return out


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def _plain(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def first_centroids(rows: DataFrame, count: int, width: int, scale: int, seed: str) -> np.ndarray:
    """The vectors with the smallest sha256 of seed and id; equal ids in order of their components."""
    fit = (F.size("v") == width) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    got = rows.where(F.col("v").isNotNull() & F.coalesce(fit, F.lit(False))).select(key.alias("h"), "v").orderBy("h", "v").limit(count).collect()
    return np.array([np.floor(np.array(r.v) * scale) for r in got], np.float64).astype(np.int64).reshape(-1, width)


def sums(rows: DataFrame, centroids: np.ndarray, width: int, scale: int) -> list:
    """(cluster, count, sums of components) of each cluster that has vectors; a task sends one row a cluster."""

    def part(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), np.int64)
        for batch in batches:
            _, x = whole(batch.column("v"), width, scale)
            near = nearest(x, centroids)
            count += np.bincount(near, minlength=len(centroids))
            order = np.argsort(near, kind="stable")
            if len(order):
                some, begin = np.unique(near[order], return_index=True)
                total[some] += np.add.reduceat(x[order], begin, axis=0)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": at.astype(np.int32), "n": count[at], "s": pa.array(total[at].tolist(), pa.list_(pa.int64()))})

    parts = rows.select("v").mapInArrow(part, "cluster int, n long, s array<long>")
    exact = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """A row for each vector that is kept: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another width, or hold null or non-finite components have no row. Fewer vectors than `count`
    are each a first centroid. Rows that share an id are vectors of their own; a null id is hashed as the empty string.
    Components of 2**27 / scale and more are refused, as their distances don't fit. An empty table has no rows. Other
    columns are left out. The driver holds the centroids and a sum for each.
    """
    rows = _plain(vectors, id_col, vector_col)
    now = first_centroids(rows, count, width, scale, seed)
    for _ in range(rounds if len(now) else 0):
        now = now.copy()
        for r in sums(rows, now, width, scale):
            now[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    final = now

    def assign(batches):
        for batch in batches:
            at, x = whole(batch.column("v"), width, scale)
            near = nearest(x, final) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({id_col: batch.column("id").take(pa.array(at)), "cluster": near.astype(np.int32), "distance": distances(x, final[near]) if len(x) else np.zeros(0, np.int64)})

    placed = materialize(rows.mapInArrow(assign, f"`{id_col}` long, cluster int, distance long"), "placed")
    inertia = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [(k, inertia.get(k, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(final.tolist())]
    known = placed.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = 3) -> str:
    """SQL: a step for each round."""
    near = "(SELECT id, cluster, d FROM (SELECT v.id, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d, row_number() OVER (PARTITION BY v.id ORDER BY d, c.cluster) AS k FROM v CROSS JOIN {c} c) WHERE k = 1)"
    steps = [
        "v AS (SELECT vec_id AS id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || id::VARCHAR)) - 1 AS cluster, x FROM v QUALIFY cluster < 16)",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS {near.format(c=f'c{r}')}",
            f"s{r} AS (SELECT a.cluster, g.i, sum(v.x[g.i])::BIGINT AS s, count(*) AS n FROM a{r} a JOIN v ON v.id = a.id CROSS JOIN (SELECT unnest(range(1, 65)) AS i) g GROUP BY a.cluster, g.i)",
            f"m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY cluster)",
            f"c{r + 1} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster)",
        ]
    steps.append(f"z AS {near.format(c=f'c{rounds}')}")
    return "WITH " + ",\n".join(steps) + f"\nSELECT z.id AS vec_id, z.cluster::INTEGER AS cluster, z.d AS distance, (sum(z.d) OVER (PARTITION BY z.cluster))::BIGINT AS cluster_inertia, (sum(z.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM z JOIN c{rounds} c ON c.cluster = z.cluster"


ORACLE = _oracle()
