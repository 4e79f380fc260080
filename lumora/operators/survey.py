"""Free-text response integrity: metrics, an explainable risk score, duplicates and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions import text as T
from lumora.operators import similarity

#: Reason, what it adds, and when, over the metric columns. The conditions are SQL that both engines read.
RULES = (
    ("too_short", 0.25, "n_words <= 4"),
    ("high_symbol_ratio", 0.25, "n_chars >= 20 AND special_ratio > 0.28"),
    ("low_alpha_ratio", 0.20, "n_chars >= 20 AND alpha_ratio < 0.55 AND digit_ratio + special_ratio > 0.45"),
    ("low_entropy", 0.20, "n_chars >= 25 AND entropy < 3.3"),
    ("noisy_text_entropy", 0.15, "n_chars >= 25 AND entropy > 5.2 AND alpha_ratio < 0.70"),
    ("repeated_characters", 0.25, "repeated_run"),
    ("excessive_punctuation", 0.15, "many_marks"),
    ("low_word_diversity", 0.18, "n_words >= 12 AND unique_ratio < 0.55"),
    ("repeated_ngrams", 0.22, "n_words >= 15 AND (max_bigram > 0.18 OR max_trigram > 0.14)"),
    ("uniform_sentence_lengths", 0.12, "n_words >= 25 AND sentence_cv < 0.20"),
)
NEAR_RULES = (("near_duplicate", 0.25, "near_duplicate_index >= 0"),)
DUPLICATE_RULES = (("many_exact_duplicates", 0.35, "duplicate_group_size >= 3"), ("exact_duplicate", 0.20, "duplicate_group_size = 2"))


def metrics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the metrics of the normalised text; a null text reads nan, so no metric is null."""
    df = df.withColumn("norm", T.normalized(F.col(text_col)))
    df = df.withColumns({"__stats": T.word_statistics(F.col("norm")), "n_chars": F.length("norm").cast("long")})
    one = F.greatest(F.col("n_chars"), F.lit(1))
    counts = {"digits": r"\p{Nd}+", "letters": r"\p{L}+", "spaces": r"\s+"}
    df = df.withColumns({f"__{k}": T.removed_length(F.col("norm"), p) for k, p in counts.items()})
    special = F.greatest(F.col("n_chars") - F.col("__digits") - F.col("__letters") - F.col("__spaces"), F.lit(0))
    df = df.withColumns({
        **{c: F.col(f"__stats.{c}") for c in ("n_words", "unique_ratio", "entropy", "max_bigram", "max_trigram")},
        "digit_ratio": F.col("__digits") / one,
        "alpha_ratio": F.col("__letters") / one,
        "special_ratio": special / one,
        "repeated_run": F.col("norm").rlike(r"(.)\1{6,}"),
        "many_marks": F.col("norm").rlike(r"([!?;.,])\1{2,}"),
        "sentence_cv": T.sentence_variation(F.col("norm")),
    })
    return df.drop("__digits", "__letters", "__spaces", "__stats")


def score(df: DataFrame, text_col: str = "text", duplicates: bool = True, threshold: float = 0.65, near_id: str | None = None, least: float = 0.92, nearest: bool = True) -> DataFrame:
    """df with metrics, duplicate_group_size, risk_score, flagged, label and reasons (sorted, joined by ;).

    Copies are counted by the md5 of the normalised text in an aggregate with map-side combine, and joined back, so a
    text that a third of the rows share is one row there. With near_id, a unique id column, also near_duplicate_index and
    near_duplicate_similarity: the most similar other row (of equal ones that with the smallest id) where the TF-IDF cosine
    is `least` or more, else -1 and 0; it adds to the score. Without `nearest` only whether there is one is found out, for less, and
    those two columns are left out. A null text has no near row; near ids aren't negative. An empty table gives an empty one. Columns named like those made are replaced.
    """
    out = metrics(df, text_col).withColumn("norm_md5", F.md5("norm")).drop("norm")
    rules = RULES
    if duplicates:
        sizes = df.select(F.md5(T.normalized(F.col(text_col))).alias("__md5")).groupBy("__md5").agg(F.count("*").alias("duplicate_group_size"))
        out = out.drop("duplicate_group_size").join(sizes, out.norm_md5 == F.col("__md5")).drop("__md5")
        rules = RULES + DUPLICATE_RULES
    if near_id:
        if nearest:
            near = similarity.nearest_rows(df, near_id, text_col, least).select(F.col("id").alias("__near"), F.col("other").alias("__other"), F.col("similarity").alias("__similarity"))
        else:
            near = similarity.near_rows(df, near_id, text_col, least).select(F.col("id").alias("__near"), F.col("id").alias("__other"), F.lit(1.0).alias("__similarity"))
        out = out.join(near, F.col(near_id) == F.col("__near"), "left")
        out = out.withColumns({"near_duplicate_index": F.coalesce("__other", F.lit(-1)).cast("long"), "near_duplicate_similarity": F.coalesce(F.round("__similarity", 6), F.lit(0.0))})
        out, rules = out.drop("__near", "__other", "__similarity"), rules + NEAR_RULES
    hits = [F.when(F.expr(cond), F.lit(weight)).otherwise(F.lit(0.0)) for _, weight, cond in rules]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    names = [F.when(F.expr(cond), F.lit(name)) for name, _, cond in rules]
    out = out.withColumn("risk_score", F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 6))
    out = out.withColumn("flagged", F.col("risk_score") >= F.lit(float(threshold)))
    out = out.withColumn("label", F.when(F.col("flagged"), F.lit("Flagged")).otherwise(F.lit("OK")))
    out = out.withColumn("reasons", F.array_join(F.array_sort(F.array_compact(F.array(*names))), ";"))
    return out if nearest or not near_id else out.drop("near_duplicate_index", "near_duplicate_similarity")


def check(spark: SparkSession, text: str | None) -> dict:
    """The score of one text, without the rules on copies."""
    return score(spark.createDataFrame([(text,)], "text string"), duplicates=False).drop("norm_md5").head().asDict()


def clean(df: DataFrame, text_col: str = "text", threshold: float = 0.65, near_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that aren't flagged, the report, up to 25 flagged rows by falling score) of an uploaded table."""
    scored = score(df, text_col, threshold=threshold, near_id=near_id)
    flagged = scored.where("flagged").orderBy(F.desc("risk_score"), "norm_md5").limit(25)
    return cleaned(scored), report(scored, threshold), flagged


def report(scored: DataFrame, threshold: float = 0.65, most: int = 15) -> DataFrame:
    """One row: total, flagged, flag_rate, rows with a copy, risk_threshold and top_reasons as `reason:n` joined by ;."""
    out = scored.agg(F.count("*").alias("total"), F.count_if("flagged").alias("flagged"), F.count_if(F.col("duplicate_group_size") >= 2).alias("exact_duplicate_rows"))
    out = out.withColumn("flag_rate", F.when(F.col("total") > 0, F.round(F.col("flagged") / F.col("total"), 6)).otherwise(F.lit(0.0)))
    top = top_reasons(scored, most).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "reason"))).alias("top"))  # `most` rows
    named = top.select(F.array_join(F.transform("top", lambda x: F.concat_ws(":", x["reason"], -x["k"])), ";").alias("top_reasons"))
    return out.withColumn("risk_threshold", F.lit(float(threshold))).join(F.broadcast(named))


def top_reasons(scored: DataFrame, most: int = 15) -> DataFrame:
    """The commonest reasons: a top-k report."""
    each = scored.select(F.explode(F.split("reasons", ";")).alias("reason")).where("reason <> ''")
    return each.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(most)


def cleaned(scored: DataFrame) -> DataFrame:
    return scored.where("NOT flagged")


def exact_duplicates(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """A row for each normalised text that comes twice or more: its md5, number of rows and first id."""
    key = F.md5(T.normalized(F.col(text_col)))
    return df.groupBy(key.alias("norm_md5")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n >= 2")
