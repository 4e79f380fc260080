"""A caller's own model in a job: a function from texts to numbers, called by batches, whose results are checked.

The function is called in tasks as function(texts) and returns a row of `width` numbers for each text. It must not depend on which
texts are called together. What loads a model belongs inside it, once a process; Spark decides where it runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SENTENCE_END = re.compile(r"[.!?]+\s+")
Function = Callable[[list[str]], np.ndarray]


class WrongShape(ValueError):
    """A function's result doesn't have a row for each text, or not `width` numbers in each."""


def _called(function: Function, texts: list[str], width: int) -> np.ndarray:
    out = np.asarray(function(texts), float)
    if out.ndim == 1 and width == 1:
        out = out[:, None]
    if out.shape != (len(texts), width):
        raise WrongShape(f"the function gave {out.shape} for {len(texts)} texts of width {width}")
    return out


def called(function: Function, texts: list[str], width: int, strict: bool) -> tuple[list[np.ndarray | None], list[str | None]]:
    """Results and errors of texts; unless strict, a batch that fails is called text by text, so that only the culprit has none.

    A wrong shape is always an error of the whole job: it says that the function doesn't fit, not that a text doesn't.
    """
    if not texts:
        return [], []
    try:
        return list(_called(function, texts, width)), [None] * len(texts)
    except WrongShape:
        raise
    except Exception as e:
        if strict:
            raise
        if len(texts) == 1:
            return [None], [f"{type(e).__name__}: {e}"[:500]]
        results, errors = [], []
        for t in texts:
            r, e = called(function, [t], width, strict)
            results, errors = results + r, errors + e
        return results, errors


def batch_features(df: DataFrame, id_col: str, text_col: str, function: Function, width: int, strict: bool = True, most: int = 256) -> DataFrame:
    """(id, features, error): what the function says of each text, in calls of at most `most` texts.

    A null text isn't given to the function: its features and error are null. Without strict, a text on which the function
    fails has null features and the error's words. Repeated rows are called again; an empty table gives an empty one, and
    the function is then not called. Other columns are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, most):
                b = whole.slice(i, most)
                texts = b.column(1).to_pylist()
                at = [k for k, t in enumerate(texts) if t is not None]
                results, errors = called(function, [texts[k] for k in at], width, strict)
                features, said = [None] * len(texts), [None] * len(texts)
                for k, r, e in zip(at, results, errors):
                    features[k], said[k] = None if r is None else r.tolist(), e
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(features, pa.list_(pa.float64())), pa.array(said, pa.string())], [id_col, "features", "error"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, features array<double>, error string")


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE_END.split(text.strip()) if s.strip()]


def sentence_perplexities(df: DataFrame, id_col: str, text_col: str, perplexity: Function, most: int = 10) -> DataFrame:
    """(id, perplexities): a caller's perplexity of each of a text's first `most` sentences, the sentences of a batch in one call.

    What isn't finite is left out, as is a sentence on which the function fails. A null text has none, as has an empty one.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                parts = [sentences(t)[:most] if t else [] for t in b.column(1).to_pylist()]
                results, _ = called(perplexity, [s for p in parts for s in p], 1, False)
                values, at = [], 0
                for p in parts:
                    found = [float(r[0]) for r in results[at : at + len(p)] if r is not None and np.isfinite(r[0])]
                    values, at = values + [found], at + len(p)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.list_(pa.float64()))], [id_col, "perplexities"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, perplexities array<double>")
