"""Exact duplicates by a tree-merge of sorted digest runs.

Each chunk of rows makes a run: its distinct digests in order, with the row that stays and the number of rows. Runs meet in
rounds: in round r, `fan` groups in a row exchange the parts of their runs that begin with the same r digits of the digest, and
each of those meetings merges the parts to one run. After log_fan(chunks) rounds all runs of a first part have met. As equal
digests are one record from the first run on, a copy that a third of all rows are is a record a chunk, and a task holds about a
chunk's worth of records at every level. Equal digests must agree in two more figures of their texts, or the job fails.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.plan import materialize

RUN = "grp long, path long, digest binary, size long, check_bytes long, check_hash long, points long, id long, row long"
NUMBERS = ("size", "check_bytes", "check_hash", "points", "id", "row")
NO_ID = np.iinfo(np.int64).max


def _ordered(digests: np.ndarray) -> np.ndarray:
    """The order of 32-byte digests; parts that are in order already are merged, not sorted anew."""
    words = digests.view(">u8").reshape(-1, 4).astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    ranked = words[order]
    tied = ranked[1:, 0] == ranked[:-1, 0]
    if (tied & (ranked[1:] != ranked[:-1]).any(1)).any():  # unlike digests with eight like bytes
        order = np.lexsort(words.T[::-1])
    return order


def merge(digests: np.ndarray, numbers: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Distinct digests in order; of equal ones the numbers of the row with the most points, then least id, then least row."""
    order = _ordered(digests)
    ranked = digests[order]
    first = np.ones(len(order), bool)
    first[1:] = (ranked[1:] != ranked[:-1]).any(1)
    number = np.cumsum(first) - 1
    cols = {c: v[order] for c, v in numbers.items()}
    for c in ("check_bytes", "check_hash"):
        if (cols[c] != cols[c][first][number]).any():
            raise ValueError("texts of one digest differ")
    best = np.lexsort((cols["row"], cols["id"], -cols["points"], number))[np.flatnonzero(first)]
    out = {c: v[best] for c, v in cols.items()}
    out["size"] = np.bincount(number, cols["size"], first.sum()).astype(np.int64) if len(order) else cols["size"]
    return ranked[first], out


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _run(grp: int, path: int, digests: np.ndarray, numbers: dict[str, np.ndarray]) -> pa.Table:
    n = len(digests)
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), n, [None, pa.py_buffer(np.ascontiguousarray(digests))]).cast(pa.binary())
    return pa.table({"grp": np.full(n, grp, np.int64), "path": np.full(n, path, np.int64), "digest": raw, **{c: numbers[c] for c in NUMBERS}})


def _merged(table: pa.Table) -> pa.Table:
    """Parts of runs that meet, as one run."""
    out = merge(_digests(table["digest"]), {c: table[c].to_numpy() for c in NUMBERS})
    return _run(table["grp"][0].as_py(), table["path"][0].as_py(), *out)


def digest_rows(docs: DataFrame, id_col: str, text_col: str, chunk_rows: int) -> DataFrame:
    """A stored row for each of docs: id, digest of the text without white space, and chunk; the texts are read once."""
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", "")
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("points"), plain.alias("plain"))
    figures = known.select("id", "points", F.unhex(F.sha2("plain", 256)).alias("digest"), F.octet_length("plain").cast("long").alias("check_bytes"), F.xxhash64("plain").alias("check_hash"), F.monotonically_increasing_id().alias("row"))
    return materialize(figures.withColumn("chunk", F.expr(f"row div {chunk_rows}")), "digests")


def tree_merge(rows: DataFrame, fan: int = 16) -> tuple[DataFrame, DataFrame]:
    """(runs by chunk, the merged runs): a row for each distinct digest of a chunk, and for each distinct digest.

    Chunks are numbered without gaps first. fan is a power of two.
    """
    bits = fan.bit_length() - 1
    if fan != 1 << bits or bits < 1 or bits > 8:
        raise ValueError("fan is a power of two up to 256")
    chunks = sorted(r[0] for r in rows.select("chunk").distinct().collect())  # a number for each chunk
    known = np.array(chunks, np.int64)

    def begin(table: pa.Table) -> pa.Table:
        ids = table["id"].fill_null(NO_ID).to_numpy()
        numbers = {"size": np.ones(table.num_rows, np.int64), "id": ids, **{c: table[c].to_numpy() for c in ("check_bytes", "check_hash", "points", "row")}}
        return _run(int(np.searchsorted(known, table["chunk"][0].as_py())), 0, *merge(_digests(table["digest"]), numbers))

    first = materialize(rows.groupBy("chunk").applyInArrow(begin, RUN), "runs")
    now, level = first, 0
    while fan**level < len(chunks):
        level += 1
        digits = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")  # the first 56 bits
        now = now.withColumns({"path": F.shiftright(digits, 56 - bits * level), "grp": F.expr(f"grp div {fan}")})
        now = now.groupBy("grp", "path").applyInArrow(_merged, RUN)
        if level % 3 == 0:
            now = materialize(now, "merged")
    return first, now


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = 1 << 16, fan: int = 16) -> DataFrame:
    """A row for each of docs: id, keep_id, group_size, kept, text_sha256 (of the text without ASCII white space).

    Of equal texts the row with the most code points stays, then that with the least id; a null id yields to any other, and
    of rows alike in both one stays. A null text is an empty one, equal to those of white space alone. Ids are integers.
    An empty table has no rows. Other columns are left out, whatever their names.
    """
    rows = digest_rows(docs, id_col, text_col, chunk_rows)
    runs, merged = tree_merge(rows, fan)
    groups = materialize(merged.where("size > 1").select("digest", F.col("size").alias("all"), F.col("id").alias("keep"), F.col("row").alias("keep_row")), "groups")
    # a digest has a row a chunk at most here, and in the join after it the rows of one chunk
    known = runs.select("grp", "digest", F.expr(f"row div {chunk_rows}").alias("chunk")).join(groups, "digest").drop("grp")
    out = rows.join(known, ["chunk", "digest"], "left")
    alone = F.col("keep_row").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.nullif(F.col("keep"), F.lit(int(NO_ID))))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("all", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
