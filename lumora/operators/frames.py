"""Projections, cleaning, order and set operations over whole tables.

Unless said otherwise, rows stay as they are and as often as they come, an empty table gives an empty one, and columns that
aren't named are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: The names under which a label column is looked for, in this order.
LABEL_NAMES = ("label", "labels", "target", "y", "class")


def subset(df: DataFrame, keep: Sequence[str] | None = None, leave: Sequence[str] = ()) -> DataFrame:
    """The columns of keep that exist, in that order (all, if None), without those of leave."""
    names = df.columns if keep is None else [c for c in keep if c in df.columns]
    return df.select(*[c for c in names if c not in set(leave)])


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)])


def reindex(df: DataFrame, columns: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """The key columns, then exactly `columns` as doubles: nulls and missing columns are 0, others are left out."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns]
    return df.select(*key, *filled)


def width_align(vector: Column, width: int) -> Column:
    """A vector cut or padded with zeros to `width`; null stays null."""
    kept = F.slice(vector, 1, width)
    return F.concat(kept, F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(kept), F.lit(0))))


def to_number(column: Column) -> Column:
    """A double, null where the text is none."""
    return column.cast("string").try_cast("double")


def finite(column: Column) -> Column:
    """0 for null, NaN and infinities."""
    bad = F.isnan(column) | (F.abs(column) == F.lit(math.inf))
    return F.coalesce(F.when(~bad, column), F.lit(0.0))


def clip(column: Column, most: float = 1e6) -> Column:
    """The value within -most and most; NaN and null are 0."""
    return F.coalesce(F.when(column.isNotNull() & ~F.isnan(column), F.greatest(F.least(column, F.lit(most)), F.lit(-most))), F.lit(0.0))


def label_column(df: DataFrame, names: Sequence[str] = LABEL_NAMES) -> str | None:
    """The first of the names that is a column."""
    return next((c for c in names if c in df.columns), None)


def repaired_label(label: Column, path: Column) -> Column:
    """The label; where it is null, 1 if a folder of the path is `ai`, else 0."""
    return F.coalesce(label.cast("int"), path.rlike(r"[/\\]ai[/\\]").cast("int"), F.lit(0))


def recode(prediction: Column, names: tuple[str, str] = ("Human Written", "AI Generated")) -> Column:
    """The second name for 1, else the first: also for null."""
    return F.when(prediction == 1, names[1]).otherwise(names[0])


def percent(share: Column) -> Column:
    return F.round(share * 100, 1)


def ordered(df: DataFrame, *by: tuple[str, bool], tie: str, most: int | None = None) -> DataFrame:
    """Rows by (column, whether it falls), then by tie; with most, only the first ones: a top-k, without a full sort."""
    out = df.orderBy(*[F.desc(c) if falls else F.asc(c) for c, falls in by], tie)
    return out if most is None else out.limit(most)


def union_by_name(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows of both; a column that one side lacks is null there."""
    return one.unionByName(two, allowMissingColumns=True)


def mean_abs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean_abs): a row for each column; null values don't count, and a column of nulls has null."""
    means = df.agg(*[F.avg(F.abs(F.col(c).cast("double"))).alias(c) for c in columns])
    return means.unpivot([], list(columns), "feature", "mean_abs")


def variation(df: DataFrame, value: str, by: str, sample: bool = False) -> DataFrame:
    """(by, n, mean, spread, cv): spread with n, or with sample n - 1, in the denominator; 0 for one row; cv 0 unless the mean is positive."""
    spread = F.coalesce((F.stddev_samp if sample else F.stddev_pop)(value), F.lit(0.0))
    out = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), spread.alias("spread"))
    cv = F.when(F.col("mean") > 0, F.col("spread") / F.col("mean")).otherwise(F.lit(0.0))
    return out.select(by, "n", *[F.round(c, 6).alias(n) for n, c in (("mean", F.col("mean")), ("spread", F.col("spread")), ("cv", cv))])


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """df with <column>_code, the place of the value among the sorted distinct ones from 0; null stays null."""
    from pyspark.sql import Window

    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("__value")).distinct()
    codes = values.withColumn("__code", (F.row_number().over(Window.orderBy("__value")) - 1).cast("long"))  # a row a class
    out = df.join(codes, F.col(column) == F.col("__value"), "left")
    return out.withColumn(f"{column}_code", F.col("__code")).drop("__value", "__code")


def label_values(coded: DataFrame, code: str, classes: DataFrame, column: str) -> DataFrame:
    """The inverse of label_codes: coded with the value of each code, from a table (column, <column>_code)."""
    names = classes.select(F.col(column).alias("__value"), F.col(f"{column}_code").alias("__code")).distinct()
    return coded.join(names, F.col(code) == F.col("__code"), "left").withColumn(column, F.col("__value")).drop("__value", "__code")
