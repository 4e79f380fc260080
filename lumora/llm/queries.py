"""One query for each corpus operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm import centroids, embed_graph, exact, licenses, merkle, mixing, quality, segsample, simhash, substring, suffix, url_filter, wavelet

TOKENIZERS = {"word": "word_bpe_49k.json", "piece": "piece_bpe_32k.model"}


def tokenizer_path(kind: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZERS[kind]))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "perplexity")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_graph.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = wavelet.write_files(_table(spark, sf_dir, "documents"), tokenizer_path("word"))
    return wavelet.read_files(files).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.dedup_suffixes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source / language / id."""
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt")))))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op9_segment_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segsample.sample_segmentations(_table(spark, sf_dir, "documents"), tokenizer_path("piece"))
    return out.select("doc_id", "sample", "n_pieces", "logp", "gumbel", "inclusion", F.crc32("ids").alias("ids_crc32"), "lossless")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.manifest(_table(spark, sf_dir, "documents"), tampered=merkle.sevenths())
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(_table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality, op2_substring_dedup, op3_embedding_dedup, op4_simhash_dedup, op5_wavelet_tokens, op6_suffix_dedup, op7_license_scan, op8_url_filter, op9_segment_sampling, op10_source_mix, op11_merkle_manifest, op12_exact_dedup, op13_centroid_clusters, pipeline)}
ORACLES = {"op8_url_filter": url_filter.ORACLE, "op10_source_mix": mixing.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_exact_dedup": exact.ORACLE, "op13_centroid_clusters": centroids.ORACLE}
