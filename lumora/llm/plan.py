"""Spark plumbing for the corpus operators: shared storage, chunks by document id, connected components."""

from __future__ import annotations

import threading
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK, TIE = "__chunk", "__tie"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset and the session is local, as in tests, one under /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


class _Made(threading.local):
    """The tables of each thread, so that a run deletes no table of another one beside it."""

    def __init__(self):
        self.tables: list[DataFrame] = []


_made = _Made()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lumora-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    _made.tables.append(out)
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table of materialize() that nothing reads any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        _made.tables = [t for t in _made.tables if t is not df]


def tables_made() -> list[DataFrame]:
    """The tables that materialize() made in this thread and nothing has dropped."""
    return list(_made.tables)


def sweep(before: list[DataFrame], keep: DataFrame) -> None:
    """Deletes every table that this thread made since `before` but `keep`; for a caller that has written all it made from them."""
    for table in tables_made():
        if table is not keep and not any(table is t for t in before):
            drop(table)


class ChunkPlan:
    """Where a document's chunk begins: ranges of ids, some cut further by place within the range.

    edges part the ids; range r is edges[r-1] <= id < edges[r]. A range that holds several chunks is cut evenly by id, or by
    the text's hash where it is a single id. Null ids come first and are cut by hash. The driver holds a few numbers for
    each range, of which there are four a chunk, and one for 16 chunks beyond 16384 chunks.
    """

    def __init__(self, edges: list[int], held: dict[int, int], share: float, low: int, high: int):
        self.edges = np.array(edges, np.int64)
        n = len(edges) + 1
        self.low = np.array([low, *edges], np.int64)
        self.width = np.maximum(np.array([*edges, high + 1], np.float64) - self.low, 1.0)
        self.base, self.cuts = np.zeros(n + 1, np.int64), np.ones(n + 1, np.int64)  # the last entry is for null ids
        chunk, size = 0, 0.0
        for r in [-1, *range(n)]:
            b = held.get(r, 0)
            if b >= 2 * share or (r < 0 and b):
                chunk += size > 0
                self.base[r], self.cuts[r] = chunk, max(1, round(b / share))
                chunk, size = chunk + int(self.cuts[r]), 0.0
            else:
                self.base[r] = chunk
                size += b
                if size >= share:
                    chunk, size = chunk + 1, 0.0
        self.chunks = max(1, chunk + (size > 0 or chunk == 0))

    def __call__(self, ids: np.ndarray, null: np.ndarray, tie: np.ndarray) -> np.ndarray:
        r = np.where(null, len(self.base) - 1, np.searchsorted(self.edges, ids, side="right"))
        by_hash = (tie.view(np.uint64) >> np.uint64(32)).astype(np.float64) / 2.0**32
        at = np.minimum(r, len(self.low) - 1)
        share = np.where(null | (self.width[at] <= 1), by_hash, (ids.astype(np.float64) - self.low[at]) / self.width[at])
        cut = np.clip((share * self.cuts[r]).astype(np.int64), 0, self.cuts[r] - 1)
        return np.minimum(self.base[r] + cut, self.chunks - 1).astype(np.int32)


def plan_chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> tuple[ChunkPlan, int]:
    """The plan for chunks of about chunk_bytes of text, and all bytes of text."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n"))
    total, low, high = sizes.agg(F.sum("n"), F.min("id"), F.max("id")).head()
    total, low, high = total or 0, low or 0, high or 0
    chunks = int(max(-(-total // chunk_bytes), min(parts, total >> 20), 1))
    edges: list[int] = []
    if chunks > 1:
        ranges = min(4 * chunks, max(1 << 16, chunks // 16))
        found = [int(x) for x in sizes.approxQuantile("id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))]
        hot = {x + 1 for x, y in zip(found, found[1:]) if x == y}  # an id in two quantiles becomes a range of its own
        edges = sorted(x for x in {*found, *hot} if low < x <= high)
    at = np.array(edges, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, ids.to_numpy(), side="right").astype(np.int32))

    of_id = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(place(F.coalesce("id", F.lit(0))))
    held = dict(sizes.groupBy(of_id.alias("r")).agg(F.sum("n")).collect()) if chunks > 1 else {0: total}
    return ChunkPlan(edges, held, max(1.0, total / chunks), low, high), total


def in_chunks(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), chunk_bytes: int = 16 << 20) -> tuple[DataFrame, int]:
    """Documents dealt to chunks whose numbers ascend with the id, and the number of chunks. The id is a number.

    Partitions hold many chunks each where there are many: about 256 MB, which a task reads chunk by chunk. Two uses of
    the returned frame in one plan share one exchange, so the text moves once.
    """
    plan, total = plan_chunks(docs, id_col, text_col, chunk_bytes)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = list(dict.fromkeys([id_col, text_col, *keep]))

    @F.pandas_udf("int")
    def place(ids: pd.Series, null: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(plan(ids.to_numpy(), null.to_numpy(), tie.to_numpy()))

    tie, number = F.xxhash64(text_col), F.col(id_col).cast("long")
    dealt = docs.select(place(F.coalesce(number, F.lit(0)), number.isNull(), tie).alias(CHUNK), tie.alias(TIE), *cols)
    return dealt.repartition(max(2, min(plan.chunks, max(parts, total >> 28))), CHUNK), plan.chunks


def doc_order(table, id_col: str, text_col: str) -> np.ndarray:
    """Row order by (id, hash of the text, text), nulls first: the same however the rows arrived."""
    high = pa.array(table[TIE].to_numpy().view(np.uint64) >> np.uint64(32))
    order = table.select([id_col, text_col]).append_column("h", high).append_column("i", [np.arange(table.num_rows)])
    rows = order.sort_by([(id_col, "ascending"), ("h", "ascending"), (text_col, "ascending")])
    at, nulls = rows["i"].to_numpy(), rows[id_col].is_null().to_numpy()
    return np.concatenate((at[nulls], at[~nulls]))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges; component is its smallest node.

    Alternating large-star and small-star rounds: each is a map-side combined minimum a node and an equi-join, so no
    neighbourhood is ever gathered in one place. Every round's edges are a table in the shared folder.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = materialize(pairs, "edges")
    mark = None
    while True:  # every round but the last lowers some label
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new = materialize(moved.select("e.*").where("u <> v").distinct(), "edges")
        old, now = now, new
        drop(old)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())

