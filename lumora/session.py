"""Session defaults shared by tests, the bench and scripts."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lumora")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without that setting, as in tests, uses one under /tmp."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if folder:
        return folder
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def settled(df: DataFrame, **options) -> DataFrame:
    """df as a table in the shared folder, computed once for several readers; it survives lost executors. released() deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lumora-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def released(df: DataFrame) -> None:
    """Deletes a table of settled() that nothing reads any more."""
    path = getattr(df, "_settled_path", None)
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextmanager
def with_batches(spark: SparkSession, rows: int):
    """What runs meanwhile sends Python that many rows at once; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


BATCH_ROWS = 1000  # of an Arrow batch: whole texts and lists of their words travel in one
BATCH_BYTES, SPARKS_BYTES = "8m", "67108864b"  # the latter is Spark's default


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task's JVM and worker hold of an Arrow batch, whatever a partition has and however long its texts are; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == SPARKS_BYTES:  # a caller's own limit stays
        spark.conf.set(name, BATCH_BYTES)
