"""Token ids in wavelet-matrix files: one compressed file a shard with access, rank, select, count and occurrences.

A file is zstd over a header, the documents' ids and token counts, and one bit-plane a bit of the largest id, most
significant first. Each plane holds that bit of every token in the order that the planes above leave: zeros first, then
ones, both stable. Ranks are sums of bits a block, made when a file is opened.
"""

from __future__ import annotations

import functools
import json
import re
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm.arrays import Slice, column_bytes, equal_spans, slices
from lumora.llm.plan import CHUNK, doc_order, in_chunks, materialize

MAGIC = b"WVM1"
END_ID = 1


class WaveletMatrix:
    """Tokens as bit-planes."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros

    @classmethod
    def build(cls, tokens: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(tokens.max(initial=0)).bit_length())
        seq = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> seq.dtype.type(b)) & seq.dtype.type(1) != 0
            planes.append(np.packbits(bit))
            low = seq[~bit]
            zeros.append(len(low))
            seq = np.concatenate((low, seq[bit]))
        return cls(len(tokens), planes, zeros)

    def tokens(self) -> np.ndarray:
        """All tokens, by undoing the planes from the least significant up."""
        bits = len(self.planes)
        seq = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for b in range(bits):
            bit = np.unpackbits(self.planes[bits - 1 - b], count=self.n).view(bool)
            z = self.zeros[bits - 1 - b]
            up = np.empty_like(seq)
            up[~bit] = seq[:z]
            up[bit] = seq[z:] | seq.dtype.type(1 << b)
            seq = up
        return seq.astype(np.uint32)

    @functools.cached_property
    def _sums(self) -> list[np.ndarray]:
        return [np.concatenate(([0], np.cumsum(np.bitwise_count(p).astype(np.int64)))) for p in self.planes]

    @functools.cached_property
    def _zero_sums(self) -> list[np.ndarray]:
        return [np.arange(len(x)) * 8 - x for x in self._sums]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        byte, rest = divmod(i, 8)
        more = int(self.planes[level][byte] >> (8 - rest)).bit_count() if rest else 0
        return int(self._sums[level][byte]) + more

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i // 8]) >> (7 - i % 8) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences before `end` lie below the last plane."""
        bits = len(self.planes)
        if token >> bits:
            return 0, 0
        low, high = 0, end
        for level in range(bits):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> (bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, end: int) -> int:
        """How often the token is among the first `end` tokens."""
        low, high = self._range(token, min(max(end, 0), self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the token's occurrence number k, from 0."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at, bits = low + k, len(self.planes)
        for level in range(bits - 1, -1, -1):
            one = token >> (bits - 1 - level) & 1
            at = self._find(level, one, at - self.zeros[level] if one else at)
        return at

    def _find(self, level: int, bit: int, k: int) -> int:
        """The place of the plane's bit number k of that value: by halving over the sums, then within a byte."""
        sums, low, high = self._sums[level], 0, len(self.planes[level])
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if (int(sums[mid]) if bit else 8 * mid - int(sums[mid])) <= k else (low, mid)
        k -= int(sums[low]) if bit else 8 * low - int(sums[low])
        places = np.flatnonzero(np.unpackbits(self.planes[level][low : low + 1]) == bit)
        return low * 8 + int(places[k])

    def occurrences(self, token: int) -> list[int]:
        """All places of a token, in order: its run below the last plane is led up plane by plane at once."""
        low, high = self._range(token, self.n)
        at, bits = np.arange(low, high), len(self.planes)
        for level in range(bits - 1, -1, -1):
            one = token >> (bits - 1 - level) & 1
            k = at - self.zeros[level] if one else at
            sums = self._sums[level] if one else self._zero_sums[level]
            byte = np.searchsorted(sums, k, side="right") - 1
            held = np.unpackbits(self.planes[level][byte][:, None], axis=1) == one
            inside = np.cumsum(held, axis=1) == (k - sums[byte] + 1)[:, None]
            at = byte * 8 + np.argmax(inside, axis=1)
        return at.tolist()

def pack(tokens: np.ndarray, ids: np.ndarray, has_id: np.ndarray, counts: np.ndarray) -> bytes:
    """A shard's file."""
    m = WaveletMatrix.build(tokens)
    head = MAGIC + struct.pack("<QQQ", len(tokens), len(counts), len(m.planes)) + struct.pack(f"<{len(m.zeros)}Q", *m.zeros)
    body = [head, ids.astype("<i8").tobytes(), has_id.astype(np.uint8).tobytes(), counts.astype("<u4").tobytes(), *(p.tobytes() for p in m.planes)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """The matrix, the documents' ids, whether each has one, and their token counts."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    if raw[:4] != MAGIC:
        raise ValueError("not a token file")
    n, docs, bits = struct.unpack_from("<QQQ", raw, 4)
    zeros = list(struct.unpack_from(f"<{bits}Q", raw, 28))
    at = 28 + 8 * bits
    parts = []
    for kind, size in (("<i8", docs), ("u1", docs), ("<u4", docs), *[("u1", -(-n // 8))] * bits):
        parts.append(np.frombuffer(raw, kind, size, at))
        at += parts[-1].nbytes
    return WaveletMatrix(n, parts[3:], zeros), parts[0], parts[1].astype(bool), parts[2]


#: The normalizer and pre-tokenizer that the short way stands for.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: That pattern for words below U+0250, where letters are what isalpha() says; a line feed parts words.
_PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u01bb]+")  # ASCII and Latin letters without marks
_SLOTS = 22


def follows_rules(path: str) -> bool:
    """Whether a tokenizer's file has the rules of the short way; use_regex and the like may be left at their defaults."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)

    def same(a, b) -> bool:
        if isinstance(a, dict) and isinstance(b, dict):
            return all(same(b[k], a[k]) if k in a else k in ("add_prefix_space", "trim_offsets", "use_regex") for k in b)
        if isinstance(a, list) and isinstance(b, list):
            return len(a) == len(b) and all(map(same, a, b))
        return a == b

    return all(same(held.get(k), RULES[k]) for k in RULES)


class WordEncoder:
    """Token ids of words, by the tokenizers library.

    A tokenizer with RULES drops white space and splits at it, so a text's ids are those of its words in a row. Words of
    ASCII and Latin letters without the tokenizer's special strings are their own normal form but for case, so they take a
    short way: their pieces go to the library's model. Other words go through the whole tokenizer. Words met before are
    found by their hash in open-addressed arrays, of at most `most` words, and compared byte by byte; then they start anew.
    Of words with one hash the first has the place, others are found by their bytes.
    """

    def __init__(self, path: str, most: int = 1 << 21):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.by_word = follows_rules(path)
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: "".join(p for p, _ in level.pre_tokenize_str(chr(c))) for c in range(0x21, 0x250) if not chr(c).isspace()}
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << _SLOTS, -1, np.int32)
        self.raw, self.at, self.long, self.odd = bytes(8), np.zeros(0, np.int64), np.zeros(0, np.int64), {}  # the words' bytes
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and each word's number of ids."""
        texts = b"\n".join(words).decode().split("\n") if words else []
        lone = {i: self.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if "<|" in t or not _PLAIN.fullmatch(t)}
        for i in lone:
            texts[i] = ""
        ids: list[int] = []
        counts: list[int] = []
        pieces: dict[str, tuple[int, ...]] = {}
        get, tokenize, letters, before, at = pieces.get, self.model.tokenize, self.letters, 0, 0
        for piece in _PIECES.findall("\n".join(texts).lower() + "\n") if texts else []:
            if piece == "\n":
                ids += lone.get(at, ())
                counts.append(len(ids) - before)
                before, at = len(ids), at + 1
            else:
                found = get(piece)
                if found is None:
                    found = pieces[piece] = tuple([t.id for t in tokenize(piece if piece.isascii() else piece.translate(letters))])
                ids += found
        return np.array(ids, np.uint32), np.array(counts, np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's word number, -1 if it isn't known."""
        out = np.full(len(hashes), -1, np.int32)
        if not len(self.keys):
            return out
        slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        held = self.slots[slot]
        hit = self.keys[held] == hashes
        hit &= held >= 0
        out[hit] = held[hit]
        live = np.flatnonzero(~hit & (held >= 0))
        step = 1
        while len(live):
            held = self.slots[(slot[live] + step) & ((1 << _SLOTS) - 1)]
            hit = (held >= 0) & (self.keys[held] == hashes[live])
            out[live[hit]] = held[hit]
            live = live[~hit & (held >= 0)]
            step += 1
        return out

    def _add(self, hashes: np.ndarray, words: list[bytes]) -> None:
        ids, size = self.encode_words(words)
        number = np.arange(len(self.keys), len(self.keys) + len(hashes), dtype=np.int32)
        long = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.concatenate((self.at, len(self.raw) - 8 + np.cumsum(long) - long))
        self.long, self.raw = np.concatenate((self.long, long)), b"".join((self.raw[:-8], *words, bytes(8)))
        self.begin = np.concatenate((self.begin, (len(self.flat) + np.cumsum(size) - size).astype(np.int32)))
        self.flat = np.concatenate((self.flat, ids.astype(self.flat.dtype)))
        self.keys, self.size = np.concatenate((self.keys, hashes)), np.concatenate((self.size, size.astype(np.int32)))
        slot, live = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64), np.arange(len(hashes))
        while len(live):
            at = slot[live]
            free = self.slots[at] < 0
            self.slots[at[free]] = number[live[free]]
            live = live[self.slots[at] != number[live]]
            slot[live] = (slot[live] + 1) & ((1 << _SLOTS) - 1)
        for i in np.flatnonzero(self._find(hashes) != number).tolist():
            self.odd[words[i]] = int(number[i])

    def __call__(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The number of every word of a slice, and each text's first word (one more at the end)."""
        starts, ends, first = s.words()
        where, number, hashes = s.numbers(starts, ends)
        if len(self.keys) > self.most:
            self.clear()
        begin, size, hashes = starts[where], ends[where] - starts[where], hashes[where]
        word = lambda i: s.raw[begin[i] : begin[i] + size[i]]
        index = self._find(hashes)
        held = np.flatnonzero(index >= 0)
        other = self.long[index[held]] != size[held]
        some = held[~other]
        other[~other] = ~equal_spans(s.raw, begin[some], self.raw, self.at[index[some]], size[some])
        for i in held[other].tolist():
            index[i] = self.odd.get(word(i), -1)
        new = np.flatnonzero(index < 0)
        if len(new):
            known = len(self.keys)
            self._add(hashes[new], [word(i) for i in new.tolist()])
            index[new] = known + np.arange(len(new))
        index = index[number]
        return index, first


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_texts(texts: list[bytes], encoder: WordEncoder) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, the end id after each text, and each text's number of ids."""
    if not encoder.by_word:
        ids = [encoder.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
        return np.array([x for row in ids for x in (*row, END_ID)], np.uint32), np.array([len(row) + 1 for row in ids], np.int64)
    tokens, counts = [], []
    for _, s in slices(texts):  # bounds what a gather holds
        index, first = encoder(s)
        size = np.insert(encoder.size[index], first[1:], 1).astype(np.int64)
        begin = np.insert(encoder.begin[index], first[1:], 0).astype(np.int64)
        upto = np.cumsum(size)
        ids = encoder.flat[np.repeat(begin - (upto - size), size) + np.arange(upto[-1])]
        last = upto[first[1:] + np.arange(s.count)]
        ids[last - 1] = END_ID
        tokens.append(ids)
        counts.append(np.diff(np.concatenate(([0], last))))
    return np.concatenate([*tokens, np.zeros(0, np.uint16)]), np.concatenate([*counts, np.zeros(0, np.int64)])


def write_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """Encodes the documents and writes a file a shard: a table (shard, n_docs, n_tokens, data) in the shared folder.

    Shards ascend by id, and documents within a shard by (id, text). A null or empty text is the end id alone. A null id
    counts as smallest and stays null. Rows that share an id are documents of their own. Other columns are ignored. An
    empty table gives no shard.
    """
    dealt, _ = in_chunks(docs, id_col, text_col, (), chunk_bytes)

    def encode(table: pa.Table) -> pa.Table:
        shard = table[CHUNK][0].as_py()
        table = table.take(doc_order(table, id_col, text_col))
        tokens, counts = encode_texts(column_bytes(table[text_col]), _encoder(tokenizer_path))
        ids = table[id_col].cast(pa.int64())
        data = pack(tokens, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(), counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(counts)], pa.int64()), "n_tokens": pa.array([len(tokens)], pa.int64()), "data": pa.array([data], pa.binary())})

    return materialize(dealt.groupBy(CHUNK).applyInArrow(encode, "shard int, n_docs long, n_tokens long, data binary"), "tokens")


def read_files(files: DataFrame, id_col: str = "doc_id", most_broadcast: int = 1_000_000) -> DataFrame:
    """(id_col, start, n_tokens, tokens) of every document, from the files: tokens are little-endian unsigned 32-bit integers."""
    offsets = files.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("before"))

    def decode(batches):
        for b in batches:
            for shard, data in zip(b.column("shard").to_pylist(), b.column("data")):
                m, ids, has_id, counts = unpack(data.as_py())
                tokens = m.tokens().astype("<u4")
                ends = np.cumsum(counts.astype(np.int64))
                for k in range(0, len(counts), 2048):
                    at = [0 if not k else int(ends[k - 1]), *ends[k : k + 2048].tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * (len(at) - 1), pa.int32()), pa.array(ids[k : k + 2048], mask=~has_id[k : k + 2048]), pa.array(at[:-1], pa.int64()), pa.array(counts[k : k + 2048].astype(np.int64)), pa.array([tokens[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())],
                        ["shard", "id", "at", "n_tokens", "tokens"],
                    )

    rows = files.select("shard", "data").mapInArrow(decode, "shard int, id long, at long, n_tokens long, tokens binary")
    if files.count() <= most_broadcast:  # 12 bytes a shard
        offsets = F.broadcast(offsets)
    return rows.join(offsets, "shard").select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "tokens")
