"""Columns of features from a text column: Spark's own functions, and Arrow passes for counts that need a table a text."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """White space collapsed and trimmed; null reads 'nan', as the survey rules have it."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("nan")), r"\s+", " "))


def removed_length(text: Column, pattern: str) -> Column:
    """Characters that runs of the pattern take: cheaper than counting matches one by one."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def _entropy(text: str) -> float:
    n = len(text)
    if not n:
        return 0.0
    codes = np.sort(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    counts = np.diff(np.concatenate((np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))), [n])))
    share = counts / n
    return float(-(share * np.log2(share)).sum())


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, base 2, in one Arrow pass: linear in the text, whatever its alphabet; null gives null."""

    @F.pandas_udf("double")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _entropy(t) for t in texts], dtype="float64")

    return bits(text)


def word_statistics(norm: Column) -> Column:
    """A struct of n_words, unique_ratio, entropy, max_bigram and max_trigram of a normalised text, in one Arrow pass."""

    @F.pandas_udf("n_words long, unique_ratio double, entropy double, max_bigram double, max_trigram double")
    def count(texts: pd.Series, lowered: pd.Series) -> pd.DataFrame:
        find, rows = re.compile("[a-z0-9']+").findall, []
        for text, low in zip(texts, lowered):
            w = find(low)
            shares = [max(Counter(zip(*(w[i:] for i in range(n)))).values()) / (len(w) - n + 1) if len(w) >= n else 0.0 for n in (2, 3)]
            rows.append((len(w), len(set(w)) / max(len(w), 1), _entropy(text), *shares))
        return pd.DataFrame(rows, columns=["n_words", "unique_ratio", "entropy", "max_bigram", "max_trigram"])

    return count(norm, F.lower(norm))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def moments(values: Column, finish) -> Column:
    """finish(number, sum, mean, population deviation) of an array, which is read once."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def last(acc):
        m = acc["s"] / acc["n"]
        return finish(acc["n"], acc["s"], m, F.sqrt(F.greatest(acc["q"] / acc["n"] - m * m, F.lit(0.0))))

    return F.aggregate(values, start, lambda acc, x: F.struct((acc["n"] + 1).alias("n"), (acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q")), last)


def sentence_variation(text: Column) -> Column:
    """Deviation over mean of the words a sentence, where there are two sentences or more."""
    parts = F.filter(F.split(F.trim(text), r"[.!?]+\s+"), lambda s: F.trim(s) != "")
    sizes = F.transform(parts, lambda s: F.size(words(s)).cast("double"))
    return moments(sizes, lambda n, total, m, dev: F.when((n >= 2) & (total > 0), dev / (m + F.lit(1e-9))).otherwise(F.lit(0.0)))


def longest_blank_run(text: Column) -> Column:
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, line):
        run = F.when(F.trim(line) == "", acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(lines(text), start, step, lambda acc: acc["best"])


def branch_count(text: Column, names: tuple[str, ...] = ("if", "elif", "else", "for", "while", "try", "except", "and", "or")) -> Column:
    return F.regexp_count(text, F.lit(r"\b(" + "|".join(names) + r")\b"))
