"""Substring dedup: Rabin-Karp hashes of every window of words, counted over all documents.

1. Documents are dealt to chunks by id range, so a smaller chunk holds the earlier documents.
2. Each chunk hashes every window and asks, through the radix exchange, which hashes another chunk has too. That takes five
   bytes of each distinct hash, one more with each level of the exchange, so a few windows are asked about in vain.
3. For those alone the chunk sends the whole hash and a second one, of other word hashes and no polynomial, and hears
   which an earlier chunk has. Word hashes depend on seeds drawn anew for each call, so no text can be made to collide.
4. Each chunk reads its texts again from the same exchange, merges the windows that started earlier into maximal
   intervals and removes them.
"""

from __future__ import annotations

import re
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.arrays import column_bytes, covered, release, runs, tree_hashes, window_hashes, word_hashes
from lumora.llm.exchange import SCHEMA, Question, ask, first_messages, gather, levels, no_messages, sort_records
from lumora.llm.plan import CHUNK, doc_order, in_chunks

_KEY = np.dtype([("key", "<u8")])
_PAIR = np.dtype([("key", "<u8"), ("check", "<u8")])
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shared_question(chunks: int) -> Question:
    """Does another chunk have the hash, as far as it is sent?"""
    return Question(_KEY, lambda records: np.zeros(len(records), np.uint8), lambda answer, first, count: answer | (count > 1), 4 + levels(chunks))


#: Does an earlier chunk have both hashes?
EARLIER = Question(_PAIR, lambda records: np.zeros(len(records), np.uint8), lambda answer, first, count: answer | ~first)


class _Chunk:
    """A chunk's windows."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, width: int, seeds: tuple[int, int], shared: Question):
        self.docs = table.take(doc_order(table, id_col, text_col))
        self.number = table[CHUNK][0].as_py()
        self.texts, self.width, self.seeds, self.shared = column_bytes(self.docs[text_col]), width, seeds, shared
        words, self.first_word = word_hashes(self.texts, seeds[0])
        self.n_words = len(words)
        self.starts, self.hashes = window_hashes(words, self.first_word, width)
        del words
        release()  # of the chunk before, and what hashing left
        self.keys, self.index, _, self.counts = sort_records(shared.cut(self.hashes.view(_KEY)))

    def asked(self, answers: pa.Table) -> np.ndarray:
        """Which windows another chunk may have too."""
        return gather(self.shared, answers, self.keys)[self.index] > 0

    def pairs(self, windows: np.ndarray) -> np.ndarray:
        """Both hashes of some windows."""
        out = np.zeros(len(windows), _PAIR)
        if len(windows):
            out["key"] = self.hashes[windows]
            out["check"] = tree_hashes(word_hashes(self.texts, self.seeds[1])[0], self.starts[windows], self.width)
        return out


def _layout(text: bytes, kept: list[tuple[int, int]]) -> bytes:
    """The kept runs of words with the space between their words; a line feed joins runs if one was between them, else a space."""
    spans, out, done = [m.span() for m in _WORD.finditer(text)], [], 0
    for s, e in kept:
        start, end = spans[s][0], spans[e - 1][1]
        if out:
            out.append(b"\n" if b"\n" in text[done:start] else b" ")
        out.append(text[start:end])
        done = end
    return b"".join(out)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, keep: tuple[str, ...] = (), chunk_bytes: int = 8 << 20, layout: bool = False) -> DataFrame:
    """Removes each word that a window of `width` words covers whose word sequence also starts earlier.

    Earlier: in a document with a smaller id, or in the same one further left. Windows are judged on the input. Returns a
    row for each input row: id_col, the columns of keep, n_words, n_removed, kept_text (kept words joined by a space; with
    layout, as they stood, and the whole text where nothing went) and spans (removed word intervals, end exclusive).

    The id is a number. A null or empty text has no words and an empty kept_text. A text shorter than the window keeps
    all its words. Rows that share an id are ordered by a hash of the text, then by the text, so of equal rows the first
    keeps its words; a null id counts as smallest. Other columns are ignored, whatever their names. An empty table gives
    an empty one. Equality is that of two 64-bit hashes under seeds drawn for each call.
    """
    dealt, n = in_chunks(docs, id_col, text_col, keep, chunk_bytes)
    shared = shared_question(n)
    seeds = (secrets.randbits(64), secrets.randbits(64))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def chunk(table: pa.Table) -> _Chunk:
        return _Chunk(table, id_col, text_col, width, seeds, shared)

    def send(table: pa.Table) -> pa.Table:
        try:
            c = chunk(table)
            return first_messages(shared, c.keys, c.number)
        finally:
            c = None
            release()

    def send_pairs(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return no_messages()
        try:
            c = chunk(table)
            return first_messages(EARLIER, sort_records(c.pairs(np.flatnonzero(c.asked(answers))))[0], c.number)
        finally:
            c = None
            release()

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        c = chunk(table)
        second = answers["second"].to_numpy(zero_copy_only=False) if answers.num_rows else np.zeros(0, bool)
        asked = c.asked(answers.filter(pa.array(~second)))
        some = np.flatnonzero(asked | (c.counts[c.index] > 1))
        distinct, index, first, _ = sort_records(c.pairs(some))
        of_asked = np.zeros(len(distinct), bool)
        of_asked[index] = asked[some]
        earlier = np.zeros(len(distinct), bool)
        earlier[of_asked] = gather(EARLIER, answers.filter(pa.array(second)), distinct[of_asked]) > 0
        gone = covered(c.n_words, c.starts[some[~first | earlier[index]]], width)
        total = np.concatenate(([0], np.cumsum(gone)))
        n_removed = total[c.first_word[1:]] - total[c.first_word[:-1]]
        kept, spans = [], []
        for i, text in enumerate(c.texts):
            if n_removed[i]:
                flags = gone[c.first_word[i] : c.first_word[i + 1]]
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(*runs(flags))])
                if layout:
                    kept.append(_layout(text, list(zip(*(x.tolist() for x in runs(~flags))))))
                else:
                    kept.append(b" ".join([w for w, x in zip(text.split(), flags.tolist()) if not x]))
            else:
                spans.append([])
                kept.append(text if layout else b" ".join(text.split()))
        out = {id_col: c.docs[id_col]} | {k: c.docs[k] for k in keep}
        out |= {"n_words": pa.array(np.diff(c.first_word), pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        out |= {"kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
        c = None
        release()
        return pa.table(out)

    one = ask(dealt.groupBy(CHUNK).applyInArrow(send, SCHEMA), shared, n).select(F.col("member").alias(CHUNK), "path", "data", F.lit(False).alias("second"))
    pairs = dealt.groupBy(CHUNK).cogroup(one.groupBy(CHUNK)).applyInArrow(send_pairs, SCHEMA)
    two = ask(pairs, EARLIER, n).select(F.col("member").alias(CHUNK), "path", "data", F.lit(True).alias("second"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep)) + ", n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>"
    return dealt.groupBy(CHUNK).cogroup(one.unionAll(two).groupBy(CHUNK)).applyInArrow(remove, schema)
