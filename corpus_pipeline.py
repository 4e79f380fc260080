"""A corpus pipeline over `documents`: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm import mixing, near, quality, segsample, substring
from lumora.llm.plan import materialize, sweep, tables_made
from lumora.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


BATCH_ROWS = 1000  # of an Arrow batch: whole texts of many kilobytes travel in one


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task's JVM and worker hold of an Arrow batch; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) <= 0 or int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's perplexity band.

    Null and empty texts fail the base rules and go. Repeated rows are judged alike. A null language is a language. Other
    columns are left out. An empty table gives an empty one.
    """
    small_batches(spark)
    scored = quality.quality(docs, keep=COLUMNS).where("kept")
    return scored.select(*[F.col(f"k_{c}").alias(c) for c in COLUMNS])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents whose 5-word shingles have a Jaccard similarity of 0.8 or more, that with the smallest id.

    Candidates are SimHash fingerprints within 2 bits, through vantage-point shards, and, as a radius that reaches 0.8 (10
    of 64 bits on average) prunes nothing, min-wise keys besides; true similarity decides. Null and empty texts are copies
    of each other; a null id yields to any other; an empty table gives an empty one; other columns are left out.
    """
    small_batches(spark)
    return near.drop_near_copies(docs, COLUMNS, words=5, least=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that started earlier; what stays keeps its spacing and line breaks.

    One that loses nothing keeps its text and n_chars as they are, a null text with it. Every row stays, if need be with
    an empty text. Repeated rows: the first keeps its words. Other columns are left out. An empty table gives an empty one.
    """
    small_batches(spark)
    cut = substring.dedup_substrings(docs, keep=("text", "lang", "source", "n_chars"), layout=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null or empty text has size 0 and is taken like any other of its source; a source without words is taken no times.
    A null source is a source of its own. Rows that share an id share a draw. Other columns are left out. An empty table
    gives an empty one.
    """
    return mixing.emit(mixing.mix(docs)).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document as piece ids; lossless: decoding them gave the text.

    Null and empty texts have one segmentation without pieces. Repeated rows have equal segmentations, as the row key
    seeds them. Other columns are left out. An empty table gives an empty one.
    """
    small_batches(spark)
    return segsample.sample_segmentations(docs, tokenizer_path("piece"))


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]
ORACLE_SQL = None  # language model, sampling and file formats are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is a table in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables_made()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(before, docs)  # what the stage and those before it wrote has been read
    return docs
