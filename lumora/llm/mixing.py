"""Mixing sources to target weights, with Spark aggregates and a hash-seeded draw a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word, for every engine: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target words of each source: share of all words by weight, no source above `most` times its own.

    sizes: (source, source_size). What a capped source can't take goes to the others by weight. That ends at the level at
    which min(level * weight, most * size) sums to the share, which running sums over the sources ordered by
    size / weight give without a loop. One row a source is all this sees.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = capped.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("budget"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("cap").over(by_fill), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0)).alias("weight_before"),
    )
    # the level if all sources before this one are full and none after: it rises up to the first that isn't full, then falls
    level = (F.col("budget") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    at = filled.withColumn("level", F.max(level).over(everything))
    target = F.least(F.col("cap"), F.col("level") * F.col("weight"))
    return at.select("source", "source_size", target.alias("target"))


def draw(id_col: str, seed: str) -> Column:
    """A number in [0, 1) from the md5 of seed and id: the same on every run and engine."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Each document with mix_size, mix_source_size, mix_target, mix_rate and mix_copies.

    Copies are floor(rate) and one more if the document's draw is below the fraction; rate is target / words of the
    source, so it is at most `most`. A null text has size 0. A null source is a source of its own, the last in order. A
    source without words has rate 0. Rows that share an id share a draw; a null id draws as the empty string. The columns
    mix_* replace any that are there. Sums group by source with map-side combine, so a hot source costs no more than
    others; the join back is by a broadcast only while Spark finds the sources small enough.
    """
    sized = docs.withColumn("mix_size", word_count(F.col(text_col)))
    sizes = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("mix_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).select(F.col("source").alias("__source"), F.col("source_size").alias("__size"), F.col("target").alias("__target"))
    out = sized.join(targets, F.col(source_col).eqNullSafe(F.col("__source")), "left")
    out = out.withColumns({"mix_source_size": F.col("__size"), "mix_target": F.col("__target")})
    out = out.withColumn("mix_rate", F.when(F.col("__size") > 0, F.col("__target") / F.col("__size")).otherwise(F.lit(0.0)))
    whole = F.floor("mix_rate")
    return out.withColumn("mix_copies", (whole + (draw(id_col, seed) < F.col("mix_rate") - whole).cast("long")).cast("long")).drop("__source", "__size", "__target")


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, without the mix_* columns."""
    copies = mixed.where("mix_copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return copies.drop("__copy", *[c for c in mixed.columns if c.startswith("mix_")])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM s),
w AS (SELECT *, (CASE (k - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
f AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(weight) OVER () AS aw,
      coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
      coalesce(sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb FROM w),
l AS (SELECT *, max((budget - cb) / (aw - wb)) OVER () AS lev FROM f),
t AS (SELECT source, source_size, least(cap, lev * weight) AS target FROM l),
e AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM e
"""
