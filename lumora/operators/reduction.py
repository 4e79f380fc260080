"""Principal components of vector columns: sums of products by Spark, axes of a small matrix, projection by batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Components:
    """mean (width), axes (components x width) with orthonormal rows, variance along each, and the variance of all."""

    mean: np.ndarray
    axes: np.ndarray
    variance: np.ndarray
    total: float
    rows: int

    @property
    def ratio(self) -> np.ndarray:
        return self.variance / self.total if self.total > 0 else np.zeros(len(self.variance))


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of `width` finite numbers, and those."""
    offsets = column.offsets.to_numpy()
    flat = column.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    good = np.flatnonzero((np.diff(offsets) == width) & column.is_valid().to_numpy(zero_copy_only=False))
    cells = flat[offsets[good][:, None] + np.arange(width)] if len(good) else np.zeros((0, width))
    finite = np.isfinite(cells).all(1)
    return good[finite], cells[finite]


def _summed(rows: DataFrame, width: int, lines: int, part) -> dict[int, np.ndarray]:
    """Sums over all tasks of a matrix of `lines` lines: each task sends its lines, and each line is added up by itself."""

    def send(batches):
        total = None
        for b in batches:
            _, x = matrix(b.column("v"), width)
            now = part(x)
            total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_pydict({"line": np.arange(lines, dtype=np.int32), "x": pa.array(total.tolist(), pa.list_(pa.float64()))})

    def add(table: pa.Table) -> pa.Table:
        x = np.array(table["x"].to_pylist())
        return pa.table({"line": table["line"][:1], "x": pa.array([x[np.lexsort(x.T)].sum(0).tolist()], pa.list_(pa.float64()))})  # in an order of its own, so that reruns agree

    got = rows.mapInArrow(send, "line int, x array<double>").groupBy("line").applyInArrow(add, "line int, x array<double>").collect()
    return {r["line"]: np.array(r["x"]) for r in got}


def fit(df: DataFrame, vector_col: str, components: int, width: int) -> Components:
    """The `components` directions with the most variance, of the vectors of `width` finite numbers; others don't count.

    The driver holds width x width numbers. Variance has n - 1 in the denominator. The largest entry of each axis by absolute
    value is positive, the first of equal ones. Fewer than two vectors have no variance: axes are then the first unit vectors.
    """
    rows = df.select(F.col(vector_col).cast("array<double>").alias("v"))
    first = _summed(rows, width, 1, lambda x: np.concatenate((x.sum(0), [len(x)]))[None, :]).get(0, np.zeros(width + 1))
    n = int(first[-1])
    mean = first[:-1] / max(n, 1)
    products = _summed(rows, width, width, lambda x: (x - mean).T @ (x - mean)) if n > 1 else {}
    covariance = np.array([products.get(i, np.zeros(width)) for i in range(width)]) / max(n - 1, 1)
    if n < 2:
        return Components(mean, np.eye(width)[:components], np.zeros(min(components, width)), 0.0, n)
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    axes = vectors[:, order].T
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    return Components(mean, axes * signs[:, None], np.maximum(values[order], 0.0), float(np.trace(covariance)), n)


def project(df: DataFrame, id_col: str, vector_col: str, found: Components) -> DataFrame:
    """(id, reduced): each vector's place along the axes; null for one that is null, of another width or not finite."""
    kind, width = df.schema[id_col].dataType.simpleString(), len(found.mean)

    def place(batches):
        for b in batches:
            at, x = matrix(b.column("v"), width)
            out = [None] * b.num_rows
            for i, row in zip(at.tolist(), ((x - found.mean) @ found.axes.T).tolist()):
                out[i] = row
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], [id_col, "reduced"])

    return df.select(id_col, F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(place, f"`{id_col}` {kind}, reduced array<double>")
