"""Cosines of embedding tables: every pair above a threshold, and each row's nearest other row.

Rows are dealt to blocks by hash; each two blocks meet in a task, which multiplies them as matrices. All-pairs work grows
with the square of the rows however it is done; what a task holds does not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unit(column) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _met(df: DataFrame, id_col: str, vec_col: str, block: int) -> DataFrame:
    """Rows (lo, hi, side, id, vec), a copy for each pair of blocks; vectors that are null or hold nulls are left out."""
    rows = df.where(F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull())).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    blocks = max(1, -(-df.count() // block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "vec")


def cosine_pairs(df: DataFrame, id_col: str, vec_col: str, least: float, block: int = 4096) -> DataFrame:
    """(a, b, similarity) of rows with a cosine of `least` or more, a < b; ids are unique, vectors of one length; a zero vector has cosine 0."""

    def compare(t: pd.DataFrame) -> pd.DataFrame:
        lo, hi = t["lo"].iloc[0], t["hi"].iloc[0]
        one, two = t[t["own"] == lo], t[t["own"] == hi]
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        sims = _unit(one["vec"]) @ _unit(two["vec"]).T
        i, j = np.nonzero(sims >= least - 1e-12)
        a, b = one["id"].to_numpy()[i], two["id"].to_numpy()[j]
        keep = a < b if lo == hi else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": sims[i, j][keep]})

    return _met(df, id_col, vec_col, block).groupBy("lo", "hi").applyInPandas(compare, "a long, b long, similarity double")


def nearest(df: DataFrame, id_col: str, vec_col: str, block: int = 4096) -> DataFrame:
    """(id, other, similarity): each row's nearest other row by cosine rounded to 9 places, of equal ones the smallest id.

    A lone row has none and is left out, as are rows without a vector.
    """

    def best(of: pd.DataFrame, among: pd.DataFrame) -> pd.DataFrame:
        among = among.sort_values("id")
        sims = np.round(_unit(of["vec"]) @ _unit(among["vec"]).T, 9)
        sims[of["id"].to_numpy()[:, None] == among["id"].to_numpy()[None, :]] = -2
        at = np.argmax(sims, axis=1)  # the first of equal ones
        out = pd.DataFrame({"id": of["id"].to_numpy(), "other": among["id"].to_numpy()[at], "similarity": sims[np.arange(len(of)), at]})
        return out[out["similarity"] > -2]

    def compare(t: pd.DataFrame) -> pd.DataFrame:
        lo, hi = t["lo"].iloc[0], t["hi"].iloc[0]
        one, two = t[t["own"] == lo], t[t["own"] == hi]
        if not len(one) or not len(two):
            return pd.DataFrame({"id": [], "other": [], "similarity": []})
        return best(one, two) if lo == hi else pd.concat([best(one, two), best(two, one)])

    found = _met(df, id_col, vec_col, block).groupBy("lo", "hi").applyInPandas(compare, "id long, other long, similarity double")
    top = found.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("other")).alias("o"))).alias("best"))
    return top.select("id", (-F.col("best.o")).alias("other"), F.col("best.similarity").alias("similarity"))
