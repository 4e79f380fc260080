"""A radix exchange: chunks ask, for each of their records, about equal records in all other chunks.

Records are sorted by a 64-bit key. A chunk sends one message for each first byte of the key, so 256 at most. Messages of
256 chunks in a row meet by that byte; unless those are all chunks, they are merged, equal records once, and go on by
the key's next byte, and so on. Every level sends 256 messages for each group of chunks, so messages grow in proportion
to the input, a task holds about a chunk's worth of records, and a record that all chunks have arrives 256 times at most.
Answers, a byte a record, go the same way back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 256
SCHEMA = "path long, grp int, member int, data binary"


def levels(chunks: int) -> int:
    n = 1
    while FAN**n < chunks:
        n += 1
    return n


def pack(answers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(answers.tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def sort_records(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct records in order, each record's index among them, whether it is the first of its kind, and counts.

    A field `many` doesn't tell records apart; it is 1 in the result where any of the equal records has it, or several are equal.
    """
    names = [f for f in records.dtype.names if f != "many"]
    order = np.lexsort([records[f] for f in reversed(names)]) if len(names) > 1 else np.argsort(records[names[0]], kind="stable")
    ranked = records[order]
    new = np.ones(len(records), bool)
    if len(records):
        new[1:] = False
        for f in names:
            new[1:] |= ranked[f][1:] != ranked[f][:-1]
    index = np.empty(len(records), np.int64)
    index[order] = np.cumsum(new) - 1
    first = np.zeros(len(records), bool)
    first[order[new]] = True
    distinct = ranked[new]
    counts = np.bincount(index, minlength=len(distinct))
    if "many" in records.dtype.names:
        distinct["many"] = np.bincount(index, records["many"], len(distinct)) + counts > 1
    return distinct, index, first, counts


@dataclass
class Question:
    """What records are and how they are answered.

    key_bytes: how many bytes of a record that is a key alone are sent, the path's included; 0 sends records whole.
    decide: answers of distinct records when all that are equal have met, from (records, counts). hand_on: a member's
    answer from (the merged record's answer, whether it is the first among the members, how many members have it).
    """

    dtype: np.dtype
    decide: Callable[[np.ndarray], np.ndarray]
    hand_on: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    key_bytes: int = 0

    def write(self, records: np.ndarray, level: int) -> bytes:
        if not self.key_bytes:
            return records.tobytes()
        return np.ascontiguousarray(records["key"].astype(">u8").view(np.uint8).reshape(-1, 8)[:, level : self.key_bytes]).tobytes()

    def read(self, data: bytes, path: int, level: int) -> np.ndarray:
        if not self.key_bytes:
            return np.frombuffer(data, self.dtype)
        rows = np.zeros((len(data) // (self.key_bytes - level), 8), np.uint8)
        rows[:, :level] = np.frombuffer(path.to_bytes(level, "big"), np.uint8)
        rows[:, level : self.key_bytes] = np.frombuffer(data, np.uint8).reshape(len(rows), -1)
        out = np.zeros(len(rows), self.dtype)
        out["key"] = rows.view(">u8").ravel()
        return out

    def cut(self, records: np.ndarray) -> np.ndarray:
        """Sorted distinct records as the exchange tells them apart: without the bytes of the key that aren't sent."""
        if not self.key_bytes:
            return records
        drop = np.uint64(8 * (8 - self.key_bytes))
        out = np.zeros(len(records), self.dtype)
        out["key"] = (records["key"] >> drop) << drop
        return out


def _edges(records: np.ndarray, path: int, level: int) -> np.ndarray:
    """Where each next byte begins among sorted records below the path (one more at the end)."""
    first = [((path * FAN + b) << (64 - 8 * (level + 1))) for b in range(1, FAN)]
    return np.concatenate(([0], np.searchsorted(records["key"], np.array(first, np.uint64)), [len(records)]))


def _messages(q: Question, records: np.ndarray, path: int, level: int, grp: int, member: int) -> pa.Table:
    at = _edges(records, path, level)
    some = [b for b in range(FAN) if at[b] < at[b + 1]]
    data = [q.write(records[at[b] : at[b + 1]], level + 1) for b in some]
    n = len(some)
    return pa.table({"path": pa.array([path * FAN + b for b in some], pa.int64()), "grp": pa.array([grp] * n, pa.int32()), "member": pa.array([member] * n, pa.int32()), "data": pa.array(data, pa.binary())})


def first_messages(q: Question, records: np.ndarray, chunk: int) -> pa.Table:
    """A chunk's messages; records are sorted, distinct and cut."""
    return _messages(q, records, 0, 0, chunk // FAN, chunk)


def no_messages() -> pa.Table:
    return pa.table({"path": pa.array([], pa.int64()), "grp": pa.array([], pa.int32()), "member": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})


def _met(q: Question, table: pa.Table, level: int):
    table = table.sort_by("member")
    parts = [q.read(d, table["path"][0].as_py(), level) for d in table["data"].to_pylist()]
    return table, parts, *sort_records(np.concatenate(parts))


def _back(q: Question, table: pa.Table, parts, answers, index, first, counts) -> pa.Table:
    out = q.hand_on(answers[index], first, counts[index]).astype(np.uint8)
    split = np.split(out, np.cumsum([len(p) for p in parts])[:-1])
    return pa.table({"path": table["path"], "grp": table["grp"], "member": table["member"], "data": pa.array([pack(x) for x in split], pa.binary())})


def gather(q: Question, answers: pa.Table, records: np.ndarray, path: int = 0, level: int = 0) -> np.ndarray:
    """The answers of sorted records, from one row (path, data) for each next byte."""
    at = _edges(records, path, level)
    out = np.zeros(len(records), np.uint8)
    for p, data in zip(answers["path"].to_pylist(), answers["data"].to_pylist()):
        b = p - path * FAN
        got = unpack(data)
        if len(got) != at[b + 1] - at[b]:
            raise RuntimeError("the documents changed between two reads")
        out[at[b] : at[b + 1]] = got
    return out


def ask(messages: DataFrame, q: Question, chunks: int, level: int = 1) -> DataFrame:
    """(path, grp, member, data): the answer of each message of this level, whose member is the chunk at the first."""
    if FAN**level >= chunks:

        def last(table: pa.Table) -> pa.Table:
            table, parts, distinct, index, first, counts = _met(q, table, level)
            return _back(q, table, parts, q.decide(distinct), index, first, counts)

        return messages.groupBy("path", "grp").applyInArrow(last, SCHEMA)

    def merge(table: pa.Table) -> pa.Table:
        table, _, distinct, *_ = _met(q, table, level)
        grp = table["grp"][0].as_py()
        return _messages(q, distinct, table["path"][0].as_py(), level, grp // FAN, grp)

    def resolve(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, parts, distinct, index, first, counts = _met(q, table, level)
        return _back(q, table, parts, gather(q, answers, distinct, table["path"][0].as_py(), level), index, first, counts)

    inner = ask(messages.groupBy("path", "grp").applyInArrow(merge, SCHEMA), q, chunks, level + 1)
    inner = inner.select(F.shiftright("path", 8).alias("__path"), F.col("member").alias("__grp"), "path", "data")
    return messages.groupBy("path", "grp").cogroup(inner.groupBy("__path", "__grp")).applyInArrow(resolve, SCHEMA)
