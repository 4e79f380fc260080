"""A store of the latest row of each key, kept up by a stream: each batch rewrites the buckets it touches and no others.

Keys are dealt to a fixed number of buckets. A batch reads its buckets from where the last version has them, merges, writes them to
a folder of its own and then commits a manifest (bucket: folder) under its number. Readers see the last manifest; a batch that
comes again after a failure is known by its number and left out.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.operators import store

BUCKET = "__bucket"


class Store:
    """path is shared by the driver and all executors. keys decide which rows replace each other; time_col, then tie_col, which stays.

    days: rows older than so many days before the newest time that any batch brought go, if it is given; null times go then.
    Rows with a null key are rows of that key. buckets is fixed when the store is made.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], time_col: str, tie_col: str, buckets: int = 64, days: int | None = None):
        self.spark, self.path, self.keys, self.time, self.tie, self.buckets, self.days = spark, path.rstrip("/"), keys, time_col, tie_col, buckets, days
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._fs_path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _versions(self) -> list[int]:
        folder = self._fs_path(f"{self.path}/manifests")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(m.group(1)) for m in (re.fullmatch(r"(\d+)\.json", n) for n in names) if m)

    def _manifest(self, version: int) -> dict:
        text = self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).head()
        return json.loads(text[0])

    def _commit(self, version: int, manifest: dict) -> None:
        """The manifest appears whole or not at all: it is written aside and renamed."""
        aside, final = (self._fs_path(f"{self.path}/manifests/{n}") for n in (f"_{version}.writing", f"{version}.json"))
        out = self.fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self.fs.rename(aside, final) and not self.fs.exists(final):
            raise RuntimeError(f"could not commit {final}")

    def read(self) -> DataFrame | None:
        """The latest rows that are young enough, or None before the first batch."""
        versions = self._versions()
        if not versions:
            return None
        manifest = self._manifest(versions[-1])
        return self._young(self._rows(manifest, None), manifest["newest"])

    def _young(self, rows: DataFrame, newest: str | None) -> DataFrame:
        if self.days is None or newest is None:
            return rows
        return rows.where(F.col(self.time) >= F.lit(newest).cast(rows.schema[self.time].dataType) - F.make_interval(days=F.lit(self.days)))

    def _rows(self, manifest: dict, only: set[int] | None) -> DataFrame:
        schema = self.spark.createDataFrame([], manifest["schema"]).schema
        folders = [f"{self.path}/{f}/{BUCKET}={b}" for b, f in manifest["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, version: int) -> None:
        """Takes the rows of a batch in; one whose number isn't above the last one's has been taken in before."""
        versions = self._versions()
        if versions and version <= versions[-1]:
            return
        before = self._manifest(versions[-1]) if versions else {"buckets": {}, "newest": None, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)}
        touched = {r[0] for r in batch.select(self._bucket()).distinct().collect()}  # numbers of buckets
        if not touched:
            return
        newest = max(filter(None, [before["newest"], batch.agg(F.max(self.time).cast("string")).head()[0]]), default=None)  # both in one format
        rows = self._young(self._rows(before, touched).unionByName(batch), newest)
        folder = f"data/{version}"
        latest = store.latest(rows, self.keys, self.time, self.tie).select(batch.columns).withColumn(BUCKET, self._bucket())
        latest.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        held = {int(m.group(1)) for m in (re.fullmatch(rf"{BUCKET}=(\d+)", s.getPath().getName()) for s in self.fs.listStatus(self._fs_path(f"{self.path}/{folder}"))) if m}
        kept = {b: f for b, f in before["buckets"].items() if int(b) not in touched}
        self._commit(version, {"schema": before["schema"], "newest": newest, "buckets": kept | {str(b): folder for b in sorted(held)}})

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests before the last `keep` and folders that no kept one names; returns how many folders went."""
        versions = self._versions()
        named = {f for v in versions[-keep:] for f in self._manifest(v)["buckets"].values()}
        gone = 0
        for s in self.fs.listStatus(self._fs_path(f"{self.path}/data")) if self.fs.exists(self._fs_path(f"{self.path}/data")) else []:
            if f"data/{s.getPath().getName()}" not in named and int(s.getPath().getName()) <= versions[-1]:
                self.fs.delete(s.getPath(), True)
                gone += 1
        for v in versions[:-keep]:
            self.fs.delete(self._fs_path(f"{self.path}/manifests/{v}.json"), False)
        return gone

    def follow(self, stream: DataFrame, checkpoint: str):
        """A query that merges every micro-batch of the stream; its number is the stream's, so a restart repeats none."""
        return stream.writeStream.foreachBatch(lambda df, number: self.merge(df, number)).option("checkpointLocation", checkpoint)


def with_json(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """df with the columns as one JSON text, and without them; null fields are left out of it."""
    return df.withColumn(name, F.to_json(F.struct(*columns))).drop(*columns)


def from_json(df: DataFrame, name: str, schema: str) -> DataFrame:
    """df with the fields of a JSON column by a schema, and without it; what doesn't parse, or isn't there, is null."""
    return df.withColumn("__parsed", F.from_json(name, schema)).select(*[c for c in df.columns if c != name], "__parsed.*")
