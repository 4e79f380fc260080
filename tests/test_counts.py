"""Counts of values that are nearly as many as the rows, and what a query sends Python at once."""

from __future__ import annotations

import random
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from lumora.plans import language_catalog
from lumora.plans.catalog import table


def test_counts_hold_a_bounded_part_in_each_task(spark):
    rng = random.Random(8)
    values = [rng.choice(["é", "", "a b", *(f"w{rng.randrange(900)}" for _ in range(4))]) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "gram string").repartition(3)
    for rows in (64, 1 << 20):
        out = language_catalog.counted(df, "gram", 40_000, piece=4096, rows=rows)
        assert {r.gram: r.n for r in out.collect()} == Counter(values)
    assert out.rdd.getNumPartitions() == 1 + 40_000 // 4096  # follows the input, whatever the session's setting
    assert language_catalog.counted(df.limit(0), "gram", 0).collect() == []


def test_ngrams_are_not_aggregated_before_they_move(spark):
    """A task held all pairs of its split, and later all of one of the session's partitions."""
    plan = language_catalog.token_ngrams(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    after, before = plan.split("REPARTITION_BY_NUM")
    assert "HashAggregate" in after and "HashAggregate" not in before


def test_a_batch_of_long_texts_is_small(spark):
    """A thousand texts were one batch however long they were."""
    table(spark, "/root/testdata/sf0.001", "documents")  # sets the limits

    @F.pandas_udf("long")
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    held = spark.range(0, 300, 1, 1).select(together(F.repeat(F.lit("x"), 100_000)).alias("n"))
    assert held.agg(F.max("n")).head()[0] <= (8 << 20) + 100_000
