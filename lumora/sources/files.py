"""Sources and sinks: CSV, JSON and Parquet, whole files labelled by folder, file trees and made corpora.

Spark has no source for Excel workbooks, and the library that pandas needs for them isn't a dependency: save as CSV first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; quoted line breaks stay in their field. Give a schema for large files: inferring reads twice."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_code_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("py", "java", "js"), least: int = 50) -> DataFrame:
    """(path, text, label, preview) of a tree; label is 1 under a folder `ai`, else 0; files under `least` characters go."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").text(path, wholetext=True)
    out = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    out = out.withColumn("label", F.col("path").rlike(r"/ai/").cast("int")).where(F.length(F.trim("text")) >= least)
    return out.withColumn("preview", F.substring("text", 1, 200))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", "\"").mode("overwrite").csv(path)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The names in a CSV's header: only that line is read."""
    return spark.read.option("header", True).csv(path).columns


def read_data(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: csv, json (one object a line) or parquet."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        return read_csv(spark, path)
    if kind in ("json", "parquet"):
        return getattr(spark.read, kind)(path)
    raise ValueError(f"no source for .{kind}")


def write_data(df: DataFrame, path: str) -> None:
    """A table by its suffix, in place of what is there: csv, json (one object a line, nulls kept) or parquet."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        write_csv(df, path)
    elif kind == "json":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"no sink for .{kind}")


#: Folders of a tree that hold others' files.
VENDOR = ("vendor", "node_modules", "dist", "build", "venv", ".venv", "__pycache__", ".git")
VENDOR_PATTERN = "|".join(v.replace(".", r"\.") for v in VENDOR)


def scan_tree(files: DataFrame, prefix: str = "", suffixes: tuple[str, ...] | None = None, most_files: int | None = None, most_chars: int | None = None, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """The files under a prefix, outside vendor folders, with one of the suffixes, the first by path, each cut to most_chars.

    Limits are parameters of a listing and off unless given. A null path is no file; a null text stays null.
    """
    out = files.where(F.col(path_col).startswith(prefix)) if prefix else files.where(F.col(path_col).isNotNull())
    out = out.where(~F.col(path_col).rlike(rf"(^|/)({VENDOR_PATTERN})/"))
    if suffixes:
        out = out.where(F.col(path_col).rlike(r"(?i)\.(" + "|".join(suffixes) + r")([?#].*)?$"))
    if most_chars is not None:
        out = out.withColumn(text_col, F.substring(text_col, 1, most_chars))
    return out if most_files is None else out.orderBy(path_col).limit(most_files)


def scored_tree(files: DataFrame, prediction: Column, confidence: Column, text_col: str = "text") -> DataFrame:
    """The files with prediction (AI, Human or Error) and confidence, ordered by prediction and then by falling confidence.

    The two columns score a file: 1 means AI. A null or blank text, and one without a prediction, is an Error with
    confidence 0. Columns of those names are replaced.
    """
    blank = F.coalesce(~F.col(text_col).rlike(r"\S"), F.lit(True)) | prediction.isNull()
    label = F.when(blank, "Error").when(prediction == 1, "AI").otherwise("Human")
    score = F.when(blank, 0.0).otherwise(F.coalesce(confidence.cast("double"), F.lit(0.0)))
    return files.withColumns({"prediction": label, "confidence": score}).orderBy("prediction", F.desc("confidence"))


def made_corpus(spark: SparkSession, n: int, templates: tuple[str, ...], label: int = 0) -> DataFrame:
    """(id, text, label) of n rows: template id modulo their number, with {i} standing for the id."""
    choice = F.element_at(F.array(*[F.lit(t) for t in templates]), (F.col("id") % len(templates) + 1).cast("int"))
    return spark.range(n).select("id", F.replace(choice, F.lit("{i}"), F.col("id").cast("string")).alias("text"), F.lit(label).alias("label"))
