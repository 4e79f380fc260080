"""A result store over an append log: latest rows, statistics, retention and metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], time_col: str, id_col: str) -> DataFrame:
    """The row of each key that was written last: an upsert that replaces whole rows.

    A maximum over structs combines on the map side, so a hot key doesn't meet in one sort as a window's would.
    """
    rest = [c for c in log.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(time_col, id_col))
    return log.groupBy(*keys).agg(last.alias("__last")).select(*keys, "__last.*")


def stats(log: DataFrame, key: str, value: str) -> DataFrame:
    return log.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def retained(log: DataFrame, time_col: str, as_of, days: int) -> DataFrame:
    """Rows of the last `days` days before as_of, which the caller names."""
    return log.where(F.col(time_col) >= F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days)))


def unpivot_metrics(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(ids, metrics, "metric", "value")


def by_day(log: DataFrame, time_col: str, key: str) -> DataFrame:
    return log.groupBy(F.date_trunc("day", F.col(time_col)).cast("date").alias("day"), key).agg(F.count("*").alias("n"))


def append(log: DataFrame, path: str) -> None:
    """Adds rows to a log of Parquet files; latest() makes an upsert of them."""
    log.write.mode("append").parquet(path)


def lookup(log: DataFrame, **keys) -> DataFrame:
    """Rows whose columns equal the given values: a filter that Parquet scans take; null values match nothing."""
    for column, value in keys.items():
        log = log.where(F.col(column) == F.lit(value))
    return log


def deleted(log: DataFrame, time_col: str, as_of, days: int) -> DataFrame:
    """One row: how many rows retained() drops and keeps; a null time is dropped."""
    young = F.col(time_col) >= F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))
    kept = F.count_if(young)
    return log.agg((F.count("*") - kept).alias("deleted"), kept.alias("kept"))
