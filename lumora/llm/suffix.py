"""Suffix-array dedup: maximal repeats of byte strings, from the common-prefix interval tree of enhanced suffix arrays.

A suffix array of all text can't be shared out, so strings meet by content first:

1. Every window of `length` bytes has one anchor, its leftmost least 64-byte gram by hash. Windows in a row with one
   anchor form a segment. Equal windows have equal anchors at equal distance, so whatever is equal lies in segments of
   one anchor's group.
2. Chunks send (anchor, BLAKE2 digest of the segment) through the radix exchange, a distinct pair once a chunk. A group
   with one segment, seen once, repeats nothing. A segment seen more often is a repeat as a whole: a tree of one interval.
3. Of a group of several distinct segments the bytes of each go once to a bucket. It builds an enhanced suffix array,
   scans its intervals with a stack, and reports those whose occurrences differ in the byte to their left.
4. A group of more than MOST distinct segments, as all contexts of one very common line are, is split: each of its
   segments is cut into pieces by the window's distance to the anchor, FINE distances a piece, and pieces meet by the bytes
   that all windows of such a piece share. A group that is still too large is cut to single windows, of which equal ones
   alone meet. So no group that a task holds grows with the input, and none is dropped.
5. Chunks read their texts again from the same exchange and remove what the repeats cover.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.arrays import BASE, Slice, column_bytes, mix, powers, runs, slices
from lumora.llm.exchange import SCHEMA, Question, ask, first_messages, gather, no_messages, sort_records
from lumora.llm.plan import CHUNK, doc_order, in_chunks

GRAM = 64
SLICE = 1 << 19
MOST, FINE = 256, 16
_POSITION = np.uint64((1 << 20) - 1)
REMOVE, SEND, SPLIT = 1, 2, 4
_RECORD = np.dtype([("key", "<u8"), ("a", "<u8"), ("b", "<u8"), ("many", "u1")])
_ITEM = np.dtype([("item", "<i8"), ("s", "<i4"), ("e", "<i4")])


def _least_in_window(order: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row: running minima from both ends of blocks of that size."""
    n = len(order) - width + 1
    blocks = -(-len(order) // width)
    x = np.full(blocks * width, np.uint64(2**64 - 1))
    x[: len(order)] = order
    x = x.reshape(blocks, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(s: Slice, length: int) -> dict[str, np.ndarray]:
    """Of all texts of a slice: start and end (exclusive) in the slice, place of the anchor, hash of the anchor."""
    data, n = s.bytes, len(s.bytes)
    none = np.zeros(0, np.int64)
    if n < length:
        return {"start": none, "end": none, "at": none, "anchor": none.astype(np.uint64)}
    power, inverse = powers(n + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])))
    gram = mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    width = length - GRAM + 1
    step = (1 << 20) - width
    at = []
    for k in range(0, n - length + 1, step):  # 20 bits of position fit beside the hash
        part = gram[k : k + step + width - 1]
        order = (part & ~_POSITION) | np.arange(len(part), dtype=np.uint64)
        at.append((_least_in_window(order, width) & _POSITION).astype(np.int64) + k)
    anchor = np.concatenate(at)
    starts = np.arange(len(anchor))
    ends = np.repeat(s.offsets[1:] - 1, np.diff(s.offsets))[: len(anchor)]
    valid = starts + length <= ends
    edge = np.flatnonzero(valid & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~valid[:-1])))
    last = np.flatnonzero(valid & np.concatenate(((anchor[1:] != anchor[:-1]) | ~valid[1:], [True])))
    end = last + length
    a = anchor[edge]
    return {"start": edge, "end": end, "at": a, "anchor": mix(gram[a] + np.uint64(BASE))}  # least hashes are all small: mixed again, they spread


def common_prefix(raw: bytes, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes from x and from y on are equal, at most `most`: compared, eight bytes a step."""
    words = np.ndarray((len(raw) + 1,), "<u8", buffer=raw + b"\0" * 8, strides=(1,))
    out = most.copy()
    live, done = np.arange(len(x)), 0
    while len(live):
        differ = words[x[live] + done] ^ words[y[live] + done]
        hit = np.flatnonzero(differ)
        low = differ[hit] & (~differ[hit] + np.uint64(1))
        out[live[hit]] = np.minimum(out[live[hit]], done + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        done += 8
        live = live[(differ == 0) & (most[live] > done)]
    return out


class SuffixArray:
    """The enhanced suffix array of strings, as far as common prefixes of `length` bytes or more need it.

    A suffix whose first `length` bytes no other suffix has is in no such interval, so it is left out; hashes of these
    prefixes bring the others together, and each bunch is sorted by what follows. order: starts of the suffixes; prefix:
    the common prefix of each with the one before it, 0 where a bunch begins.
    """

    def __init__(self, strings: list[bytes], length: int):
        sizes = np.array([len(x) for x in strings], np.int64)
        raw = b"".join(strings)
        data = np.frombuffer(raw, np.uint8)
        self.begin = np.cumsum(sizes) - sizes
        ends = np.repeat(self.begin + sizes, sizes)
        self.string = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        power, self.inverse = powers(len(data) + 1)
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])))
        starts = np.flatnonzero(np.arange(len(data)) + length <= ends)
        head = self._hash(starts, length)
        by = np.argsort(head, kind="stable")
        head, starts = head[by], starts[by]
        same = head[1:] == head[:-1]
        shared = np.append(same, False) | np.insert(same, 0, False)
        head, starts = head[shared], starts[shared]
        new = np.insert(head[1:] != head[:-1], 0, True)[: len(starts)]
        first = np.append(np.flatnonzero(new), len(starts)).tolist()
        places, stops = starts.tolist(), ends[starts].tolist()
        stop_of = dict(zip(places, stops))
        order: list[int] = []
        exact = [False] * len(first)
        for i, j in zip(first[:-1], first[1:]):
            bunch = places[i:j]
            bunch.sort(key=lambda p: raw[p + length : stop_of[p]])
            order += bunch
        pair = np.flatnonzero(~new)
        while True:
            self.order = np.array(order, np.int64)
            x, y = self.order[pair - 1], self.order[pair]
            prefix = common_prefix(raw, x, y, np.minimum(ends[x] - x, ends[y] - y))
            wrong = np.unique(np.searchsorted(first, pair[prefix < length], side="right") - 1)
            wrong = [k for k in wrong.tolist() if k >= 0 and not exact[k]]
            if not wrong:
                break
            for k in wrong:  # hashes brought unequal strings together
                exact[k] = True
                order[first[k] : first[k + 1]] = sorted(order[first[k] : first[k + 1]], key=lambda p: raw[p : stop_of[p]])
        self.prefix = np.zeros(len(order), np.int64)
        self.prefix[pair] = prefix
        self.before = np.concatenate(([0], data[:-1])).astype(np.int64) if len(data) else np.zeros(0, np.int64)
        self.before[self.begin[sizes > 0]] = -1 - np.flatnonzero(sizes > 0)

    def _hash(self, at: np.ndarray, size) -> np.ndarray:
        return mix((self.total[at + size] - self.total[at]) * self.inverse[at])


def maximal_repeats(order: np.ndarray, prefix: np.ndarray, before: np.ndarray, length: int):
    """(common length, first, last) of the intervals of order whose suffixes share `length` bytes or more and differ to the left.

    before: the byte to the left of each suffix; negative and unlike any other where there is none. One pass with a
    stack: an interval closes when the common prefix falls, and hands on whether its left bytes are one and which.
    """
    found = []
    long = prefix >= length
    starts, ends = runs(long)
    for s, e in zip((starts - 1).tolist(), ends.tolist()):
        common, left = prefix[s:e].tolist(), before[order[s:e]].tolist()
        stack: list[list] = []  # [common, first, left byte or None if diverse]
        common.append(0)
        for i in range(1, len(common)):
            c, first, byte = common[i], i - 1, left[i - 1]
            while stack and stack[-1][0] > c:
                top = stack.pop()
                if top[2] != byte:
                    top[2] = None
                if top[2] is None:
                    found.append((top[0], s + top[1], s + i - 1))
                first, byte = top[1], top[2]
            if stack and stack[-1][0] == c:
                if stack[-1][2] != byte:
                    stack[-1][2] = None
            elif c:
                stack.append([c, first, byte])
    return found


def repeats_in(strings: list[bytes], length: int):
    """(common length, strings, positions) of the maximal repeats of `length` bytes or more, with all occurrences."""
    a = SuffixArray(strings, length)
    for common, first, last in maximal_repeats(a.order, a.prefix, a.before, length):
        at = a.order[first : last + 1]
        yield common, a.string[at], at - a.begin[a.string[at]]


def _decide(records: np.ndarray) -> np.ndarray:
    """What to do with each distinct record, ordered by key."""
    key = records["key"]
    group = np.cumsum(np.concatenate((np.zeros(min(1, len(key)), bool), key[1:] != key[:-1])))
    size = np.bincount(group, minlength=1)[group]
    return np.where(records["many"] > 0, REMOVE, 0) | np.where(size > MOST, SPLIT, np.where(size > 1, SEND, 0))


#: One of the equal records, the first, speaks for all where bytes are sent or split.
QUESTION = Question(_RECORD, _decide, lambda answer, first, count: np.where(first, answer, answer & REMOVE))


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray, size: int = 16) -> np.ndarray:
    """The BLAKE2 digest of each byte span, as rows of 64-bit numbers."""
    of = hashlib.blake2b
    out = b"".join([of(raw[s:e], digest_size=size).digest() for s, e in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(out, "<u8").reshape(-1, size // 8)


def _records(key: np.ndarray, digest: np.ndarray) -> np.ndarray:
    out = np.zeros(len(key), _RECORD)
    out["key"], out["a"], out["b"] = key, digest[:, -2], digest[:, -1]
    return out


class _Level:
    """Byte spans of a chunk with the place of their anchor, and what the other chunks answered about them."""

    def __init__(self, start: np.ndarray, end: np.ndarray, at: np.ndarray, records: np.ndarray):
        self.start, self.end, self.at = start, end, at
        self.distinct, self.index, self.first, _ = sort_records(records)
        self.todo = np.zeros(len(start), np.uint8)

    def hear(self, answers: pa.Table) -> None:
        self.todo = gather(QUESTION, answers, self.distinct)[self.index]

    def chosen(self, what: int) -> np.ndarray:
        return np.flatnonzero(self.first & (self.todo & what > 0))


class _Chunk:
    """A chunk's segments; of those to be split the pieces, and of these the windows."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, length: int):
        self.docs = table.take(doc_order(table, id_col, text_col))
        self.number, self.length = table[CHUNK][0].as_py(), length
        self.texts = column_bytes(self.docs[text_col])
        self.raw = b"\n".join(self.texts) + b"\n"
        self.offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in self.texts])))
        parts: dict[str, list] = {"start": [], "end": [], "at": [], "anchor": []}
        for first, s in slices(self.texts, SLICE):
            for k, v in segments(s, length).items():
                parts[k].append(v if k == "anchor" else v + self.offsets[first])
        start, end, at, anchor = (np.concatenate([*parts[k], np.zeros(0, np.uint64 if k == "anchor" else np.int64)]) for k in parts)
        self.levels = [_Level(start, end, at, _records(anchor, digests(self.raw, start, end)))]

    def hear(self, answers: pa.Table) -> None:
        """Takes each level's answers and makes the next level of what is to be split."""
        level = answers["level"].to_numpy() if answers.num_rows else np.zeros(0, np.int32)
        for k, cut in ((0, self._pieces), (1, self._windows), (2, None)):
            self.levels[k].hear(answers.filter(pa.array(level == k)))
            split = self.levels[k].chosen(SPLIT)
            if cut is None or not len(split):
                break
            self.levels.append(cut(self.levels[k], split))

    def _pieces(self, of: _Level, split: np.ndarray) -> _Level:
        near, far = of.at[split] - (of.end[split] - self.length), of.at[split] - of.start[split]  # distances of the windows
        least = near // FINE
        n = far // FINE - least + 1
        which = np.repeat(np.arange(len(split)), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + least[which]
        at = of.at[split][which]
        start = at - np.minimum(far[which], FINE * k + FINE - 1)
        end = at - np.maximum(near[which], FINE * k) + self.length
        shared = digests(self.raw, at - FINE * k, at - FINE * k - FINE + 1 + self.length, 8)[:, 0]
        return _Level(start, end, at, _records(mix(shared ^ (k.astype(np.uint64) << np.uint64(48))), digests(self.raw, start, end)))

    def _windows(self, of: _Level, split: np.ndarray) -> _Level:
        n = of.end[split] - of.start[split] - self.length + 1
        start = np.repeat(of.start[split] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        digest = digests(self.raw, start, start + self.length, 24)
        return _Level(start, start + self.length, start, _records(digest[:, 0], digest))


def _has_split(answers: pa.Table) -> bool:
    return any((np.frombuffer(x, np.uint8) & SPLIT).any() for x in map(_plain, answers["data"].to_pylist()))


def _plain(data: bytes) -> bytes:
    from lumora.llm.exchange import unpack

    return unpack(data).tobytes()


def _scanned(length: int, most: int = 1 << 19):
    """Covered intervals of each sent span, from the maximal repeats of its group."""

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), (CHUNK, "ascending"), ("item", "ascending")])
        keys, data = table["key"].to_numpy(), table["data"].to_pylist()
        items = np.empty(table.num_rows, _ITEM)
        items["item"], items["s"], items["e"] = table["item"].to_numpy(), np.iinfo(np.int32).max, -1
        edges = np.concatenate((np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), [len(keys)])).tolist()
        sizes = np.concatenate(([0], np.cumsum([len(x) for x in data])))
        first = 0
        for g in range(len(edges) - 1):
            if g + 2 < len(edges) and sizes[edges[g + 2]] - sizes[first] <= most:
                continue  # whole groups, about `most` bytes together
            last = edges[g + 1]
            for common, of, at in repeats_in(data[first:last], length):
                of = of + first
                # all windows of a span hold its anchor, so what repeats in it is one interval around that
                np.minimum.at(items["s"], of, at)
                np.maximum.at(items["e"], of, at + common)
            first = last
        hit = np.flatnonzero(items["e"] > 0)
        chunks = table[CHUNK].to_numpy()[hit]
        out = [(int(c), items[hit[chunks == c]].tobytes()) for c in np.unique(chunks)]
        n = len(out)
        return pa.table({CHUNK: pa.array([c for c, _ in out], pa.int32()), "path": pa.array([0] * n, pa.int64()), "data": pa.array([d for _, d in out], pa.binary()), "level": pa.array([3] * n, pa.int32())})

    return scan


def _union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that intervals cover; touching ones are one."""
    order = np.argsort(begin, kind="stable")
    begin, upto = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.concatenate((np.ones(min(1, len(begin)), bool), begin[1:] > upto[:-1]))
    return begin[new], upto[np.append(np.flatnonzero(new)[1:] - 1, len(upto) - 1)] if len(upto) else upto


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep: tuple[str, ...] = (), chunk_bytes: int = 8 << 20) -> DataFrame:
    """Removes each byte that a string of `length` bytes covers which also starts anywhere else, in any document.

    Matches don't cross documents; overlapping ones count; strings are judged on the input. Returns a row for each input
    row: id_col, the columns of keep, n_bytes, n_removed, kept_bytes (what is left, joined) and spans (maximal removed
    runs in bytes, end exclusive).

    The id is a number. A null text is empty; a text under `length` bytes stays whole. All copies of equal rows are
    removed alike, as each also starts in the others. A null id counts as smallest, which decides only who sends a
    segment. Other columns are ignored. An empty table gives an empty one. length must be over 64 + FINE. Whole spans are
    equal if their 128-bit BLAKE2 digests are; strings within them are compared byte by byte.
    """
    if length < GRAM + FINE:
        raise ValueError(f"length must be {GRAM + FINE} or more")
    dealt, n = in_chunks(docs, id_col, text_col, keep, chunk_bytes)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    buckets = max(n, 2)
    reply = f"{CHUNK} int, path long, data binary, level int"

    def chunk(table: pa.Table) -> _Chunk:
        return _Chunk(table, id_col, text_col, length)

    def send(table: pa.Table) -> pa.Table:
        c = chunk(table)
        return first_messages(QUESTION, c.levels[0].distinct, c.number)

    def send_split(level: int):
        def again(table: pa.Table, answers: pa.Table) -> pa.Table:
            if not table.num_rows or not _has_split(answers.filter(pa.array(answers["level"].to_numpy() == level - 1))):
                return no_messages()
            c = chunk(table)
            c.hear(answers)
            return first_messages(QUESTION, c.levels[level].distinct, c.number) if len(c.levels) > level else no_messages()

        return again

    def send_bytes(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"bucket": [], "key": [], CHUNK: [], "item": [], "data": []}
        if table.num_rows and answers.num_rows:
            c = chunk(table)
            c.hear(answers)
            for k, level in enumerate(c.levels[:2]):
                for i in level.chosen(SEND).tolist():
                    key = int(level.distinct["key"][level.index[i]])
                    rows["bucket"].append((key * buckets) >> 64)
                    rows["key"].append(key - (1 << 63))
                    rows[CHUNK].append(c.number)
                    rows["item"].append((k << 40) + i)
                    rows["data"].append(c.raw[level.start[i] : level.end[i]])
        types = {"bucket": pa.int32(), "key": pa.int64(), CHUNK: pa.int32(), "item": pa.int64(), "data": pa.binary()}
        return pa.table({k: pa.array(v, types[k]) for k, v in rows.items()})

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        c = chunk(table)
        c.hear(answers)
        level = answers["level"].to_numpy() if answers.num_rows else np.zeros(0, np.int32)
        found = np.frombuffer(b"".join(answers.filter(pa.array(level == 3))["data"].to_pylist()), _ITEM)
        begin, end = [], []
        for k, spans_of in enumerate(c.levels):
            whole = np.flatnonzero(spans_of.todo & REMOVE)
            part = found[found["item"] >> 40 == k]
            base = spans_of.start[part["item"] & ((1 << 40) - 1)]
            begin += [spans_of.start[whole], base + part["s"]]
            end += [spans_of.end[whole], base + part["e"]]
        b, e = _union(np.concatenate(begin), np.concatenate(end))
        edges = np.searchsorted(b, c.offsets)
        kept, spans = [], []
        for i, text in enumerate(c.texts):
            o = int(c.offsets[i])
            own = [(int(x) - o, int(y) - o) for x, y in zip(b[edges[i] : edges[i + 1]], e[edges[i] : edges[i + 1]])]
            rest, done = [], 0
            for x, y in own:
                rest.append(text[done:x])
                done = y
            kept.append(b"".join([*rest, text[done:]]) if own else text)
            spans.append([{"start": x, "end": y} for x, y in own])
        out = {id_col: c.docs[id_col]} | {k: c.docs[k] for k in keep}
        out |= {"n_bytes": pa.array([len(t) for t in c.texts], pa.int64()), "n_removed": pa.array([len(t) - len(k) for t, k in zip(c.texts, kept)], pa.int64())}
        out |= {"kept_bytes": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
        return pa.table(out)

    def answered(messages: DataFrame, level: int) -> DataFrame:
        return ask(messages, QUESTION, n).select(F.col("member").alias(CHUNK), "path", "data", F.lit(level).alias("level"))

    answers = answered(dealt.groupBy(CHUNK).applyInArrow(send, SCHEMA), 0)
    for level in (1, 2):
        more = dealt.groupBy(CHUNK).cogroup(answers.groupBy(CHUNK)).applyInArrow(send_split(level), SCHEMA)
        answers = answers.unionAll(answered(more, level))
    sent = dealt.groupBy(CHUNK).cogroup(answers.groupBy(CHUNK)).applyInArrow(send_bytes, f"bucket int, key long, {CHUNK} int, item long, data binary")
    found = sent.groupBy("bucket").applyInArrow(_scanned(length), reply)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep)) + ", n_bytes long, n_removed long, kept_bytes binary, spans array<struct<start:int,end:int>>"
    return dealt.groupBy(CHUNK).cogroup(answers.unionAll(found).groupBy(CHUNK)).applyInArrow(cut, schema)
