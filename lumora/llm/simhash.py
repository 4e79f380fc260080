"""SimHash near-dedup: 64-bit fingerprints, linked within a Hamming distance through vantage-point trees.

1. Fingerprints come from whole texts; equal ones form a class.
2. A vantage-point tree, split at median distances, is fitted on a bounded sample of classes. Every class walks it. With
   d(x) its distance to a node's vantage point and m the radius, it goes in when d <= m and out otherwise; one that
   goes in also goes out when d > m - r, since by the triangle inequality only those can have a partner within r there.
   So each pair within r meets in at least one leaf.
3. Leaves are shards. Each goes on splitting in the same way, then compares bit counts, and emits a spanning forest of
   its links: no more rows than it has members, and the same components as all links have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.arrays import column_bytes
from lumora.llm.plan import connected_components, materialize

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_COLUMN = (np.arange(8) * 256).astype(np.int64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """The majority of each bit over the XXH64 of all shingles of lower-cased words, repeats included; 0 without words."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    h = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return h(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1].tolist()
    hashes = [h(joined[s:e], 42) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist())]
    octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.bincount((octets + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones.ravel() > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id_col, fp): the fingerprint's bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def batch(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            fps = np.array([fingerprint(x, words) for x in column_bytes(t[text_col])], dtype=np.uint64)
            yield from pa.table({id_col: t[id_col], "fp": pa.array(fps.view(np.int64), pa.int64())}).to_batches()

    return docs.select(id_col, text_col).mapInArrow(batch, f"`{id_col}` {kind}, fp long")


def fit_tree(sample: np.ndarray, leaf_share: float) -> list:
    """A nested [vantage, radius, inside, outside] over the sample; None is a leaf."""
    rng = np.random.default_rng(7)

    def build(part: np.ndarray, share: float):
        if share <= leaf_share or len(part) < 16:
            return None
        # of a few vantage points, the one whose median splits best with the fewest members on the border
        best = None
        for v in rng.choice(part, min(8, len(part)), replace=False):
            d = np.bitwise_count(part ^ v)
            m = int(np.median(d))
            inside = int((d <= m).sum())
            if 0 < inside < len(part):
                cost = int((np.abs(d.astype(int) - m) <= 1).sum()) + abs(2 * inside - len(part))
                best = min(best, (cost, int(v), m)) if best else (cost, int(v), m)
        if best is None:
            return None
        d = np.bitwise_count(part ^ np.uint64(best[1]))
        return [best[1], best[2], build(part[d <= best[2]], share / 2), build(part[d > best[2]], share / 2)]

    return build(sample, 1.0)


def leaves(tree, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, leaf number) for each leaf that a fingerprint belongs to, its own or across a border."""
    rows, numbers, count = [], [], 0

    def walk(node, idx):
        nonlocal count
        if node is None:
            rows.append(idx)
            numbers.append(np.full(len(idx), count, np.int64))
            count += 1
            return
        d = np.bitwise_count(fps[idx] ^ np.uint64(node[0])).astype(int)
        walk(node[2], idx[d <= node[1]])
        walk(node[3], idx[d > node[1] - radius])

    walk(tree, np.arange(len(fps)))
    return np.concatenate(rows), np.concatenate(numbers)


def near_pairs(fps: np.ndarray, radius: int, block: int = 512):
    """All pairs (i, j) of distinct fingerprints within the radius, by recursive vantage-point splits; blocks are compared whole."""
    rng = np.random.default_rng(11)
    todo = [(np.arange(len(fps)), len(fps))]
    while todo:
        idx, above = todo.pop()
        if len(idx) > block:
            v = fps[rng.choice(idx)]
            d = np.bitwise_count(fps[idx] ^ v).astype(int)
            m = int(np.median(d))
            inside, outside = idx[d <= m], idx[d > m - radius]
            if max(len(inside), len(outside)) < 0.9 * len(idx):
                todo += [(inside, len(idx)), (outside, len(idx))]
                continue
        for s in range(0, len(idx), block):  # also where all are alike, so that no split helps
            x = fps[idx[s : s + block]]
            for t in range(s, len(idx), block):
                i, j = np.nonzero(np.bitwise_count(x[:, None] ^ fps[idx[t : t + block]][None, :]) <= radius)
                i, j = idx[s + i], idx[t + j]
                keep = fps[i] != fps[j]
                if keep.any():
                    yield i[keep], j[keep]


def forest(n: int, pairs) -> np.ndarray:
    """Each member's root under the links."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while not (root[root] == root).all():
                root = root[root]
    return root


def link_classes(classes: DataFrame, radius: int = 2, leaf_size: int = 4000, sample_size: int = 1 << 15) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp), with the components of all pairs within the radius.

    The tree alone is fitted on a sample of at most sample_size classes, chosen by hash; every class is placed.
    """
    n = classes.count()
    share = min(1.0, sample_size / max(n, 1))
    picked = classes.where(F.pmod(F.xxhash64("fp", F.lit("tree")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * sample_size).collect() if n > leaf_size else []
    tree = fit_tree(np.sort(np.array([r.fp for r in picked], np.int64)).view(np.uint64), leaf_size / max(n, 1)) if picked else None

    def place(batches):
        for b in batches:
            fps = b.column("fp").to_numpy()
            rows, numbers = leaves(tree, fps.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(fps[rows])], ["leaf", "fp"])

    def join(table: pa.Table) -> pa.Table:
        fps = np.unique(table["fp"].to_numpy())
        root = forest(len(fps), near_pairs(fps.view(np.uint64), radius))
        moved = root != np.arange(len(fps))
        return pa.table({"a": fps[moved], "b": fps[root[moved]]})

    return classes.select("fp").mapInArrow(place, "leaf long, fp long").groupBy("leaf").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id_col, fp, component_id): documents whose fingerprints differ in at most `radius` bits are linked.

    component_id is the smallest id reachable by links. A null or empty text has fingerprint 0 and is linked like any
    other; one of fewer words than a shingle is one shingle. Repeated rows are rows of one class. A null id is no
    candidate for component_id, which is null only where no id is known. Other columns are ignored. An empty table
    gives an empty one.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    groups = connected_components(link_classes(prints.select("fp").distinct(), radius))
    named = classes.join(groups, classes.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.select("fp", "component").join(smallest, "component").select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(of_class, prints.fp == F.col("__fp")).select(prints[id_col], "fp", "component_id")
