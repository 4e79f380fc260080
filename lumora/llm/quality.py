"""Quality rules: counts of a text, and the perplexity of a byte n-gram model with modified Kneser-Ney smoothing.

The model has one distribution a language. An n-gram is `ORDER` bytes in a long, under a code for the language, so keys
are exact. Tasks count their n-grams, Spark sums them, and discounts, continuation counts and interpolated
probabilities are DataFrame steps. Each distinct text counts once, and no document is scored by a model that counted it or
a copy of it: texts fall into two folds by hash, and each fold is scored by the other's counts. An n-gram that only its
own fold has keeps a row with a count of zero, which the interpolation gives its backed-off probability. So each n-gram of
a document is in the model, and a document's perplexity needs the highest order alone.

The model goes to the tasks as sorted arrays of keys and log-probabilities if it has at most `broadcast_rows` rows (12
bytes each). Of a larger one each chunk of documents asks for what its distinct n-grams need, as packed messages by the
key's remainder, so that what moves stays below the texts themselves. Both give the same sums.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm.arrays import BASE, SPACE, Slice, column_bytes, covered, pairs, release, slices
from lumora.llm.plan import CHUNK, drop, materialize

ORDER = 5
WIDTH, FLOOR = 6.0, 0.25  # of the bands, in quartile distances and nats
SHORT = 400  # bytes; a mean over fewer varies more, and its band widens with the root
_BITS = 8 * ORDER
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
PATHS, MEET = 251, 256  # of the model's keys by remainder, a prime; chunks whose messages meet in one task
_MESSAGE = "path int, grp int, member int, data binary"


def language_code(lang: Column) -> Column:
    """22 bits for a language; null has one of its own."""
    return F.when(lang.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(lang), F.lit((1 << 22) - 1)) + 1).cast("long")


def fold_code(lang: Column, text: Column) -> Column:
    """The language's code and the text's fold below it."""
    return F.shiftleft(language_code(lang), 1) + F.pmod(F.shiftright(F.xxhash64(text), 17), F.lit(2))


def text_counts(s: Slice) -> dict[str, np.ndarray]:
    """The base counts of each text of a slice."""
    starts, ends, first = s.words()
    texts = len(s.offsets) - 1
    n_words = np.diff(first)
    space = SPACE[s.bytes]
    per_text = lambda flags: np.add.reduceat(flags.astype(np.int64), s.offsets[:-1]) if texts else np.zeros(0, np.int64)
    out = {"n_words": n_words, "word_chars": per_text(~space & ((s.bytes & 0xC0) != 0x80)), "n_symbols": per_text(SYMBOLS[s.bytes])}

    line_ends = np.flatnonzero(s.bytes == 0x0A)  # a text's last line ends at the byte that parts the texts
    line_starts = np.concatenate(([0], line_ends[:-1] + 1)) if len(line_ends) else line_ends
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    of_text = np.searchsorted(s.offsets, line_starts, side="right") - 1
    distinct = np.unique(of_text * (len(line_starts) + 1) + s.numbers(line_starts, line_ends)[1], return_index=True)[1]
    out["n_dup_lines"] = np.bincount(of_text, minlength=texts) - np.bincount(of_text[distinct], minlength=texts)

    one = s.numbers(starts, ends)[1]  # words by number, then runs of two, four and five
    at = np.flatnonzero(np.arange(len(starts)) + 5 <= np.repeat(first[1:], n_words))
    two = pairs(one[:-1], one[1:])
    four = pairs(two[:-2], two[2:])
    windows = pairs(four[:-1], one[4:])[at] if len(at) else at
    of_text = np.searchsorted(first, at, side="right") - 1
    _, index, count = np.unique(of_text * (len(starts) + 1) + windows, return_inverse=True, return_counts=True)
    total = np.concatenate(([0], np.cumsum(covered(len(starts), at[count[index] > 1], 5))))
    out["n_repeat_words"] = total[first[1:]] - total[first[:-1]]
    return out


def ngram_keys(texts: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of every n-gram of the texts, and each text's first one (one more at the end).

    Every text is preceded by ORDER - 1 line feeds and followed by one, which is its end.
    """
    raw = b"\n" * (ORDER - 1) + (b"\n" * ORDER).join(texts) + b"\n" + b"\0" * 8
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    blocks = np.cumsum(sizes + ORDER - 1)
    key = np.ndarray((blocks[-1],), ">u8", buffer=raw, strides=(1,)).astype(np.uint64) >> np.uint64(64 - _BITS)
    keep = np.ones(len(key), bool)
    keep[(blocks[:, None] - np.arange(1, ORDER)[None, :]).ravel()] = False  # these reach into the next text
    key = key[keep].view(np.int64)
    key |= np.repeat(codes << _BITS, sizes)
    return key, np.concatenate(([0], np.cumsum(sizes)))


def _count(batches):
    """Each task's distinct n-grams and their counts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        key, index = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return key, np.bincount(index, np.concatenate([c for _, c in held]), len(key)).astype(np.int64)

    for b in batches:
        texts, codes = column_bytes(b.column("text")), b.column("code").to_numpy()
        for at, s in slices(texts):
            held.append(np.unique(ngram_keys(texts[at : at + s.count], codes[at : at + s.count])[0], return_counts=True))
            if sum(len(k) for k, _ in held) > 4_000_000:
                held = [merged()]
    if held:
        key, n = merged()
        for k in range(0, len(key), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(key[k : k + (1 << 18)]), pa.array(n[k : k + (1 << 18)])], ["key", "n"])
    key = n = held = None
    release()


def distinct_texts(source: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(text, code) of source (text, code, hash), each distinct text of a code once.

    Only texts that occur more than once move: their hashes part them from the others, by a broadcast if they are few.
    """
    several = materialize(source.groupBy("hash", "code").count().where("count > 1").select("hash", "code"), "copies")
    if several.count() <= broadcast_rows:
        several = F.broadcast(several)
    lone = source.join(several, ["hash", "code"], "left_anti").select("text", "code")
    copied = source.join(several, ["hash", "code"], "left_semi").groupBy("hash", "code").agg(F.first("text").alias("text"))
    return lone.unionAll(copied.select("text", "code"))


def other_fold(counts: DataFrame) -> DataFrame:
    """(key, n, own): for each n-gram of a fold or of the other one, its count in the other, and whether the fold has it."""
    flip = F.col("key").bitwiseXOR(F.lit(1 << _BITS))
    both = F.array(F.struct("key", F.lit(0).cast("long").alias("n"), F.lit(True).alias("own")), F.struct(flip.alias("key"), "n", F.lit(False).alias("own")))
    return counts.select(F.explode(both).alias("x")).select("x.*").groupBy("key").agg(F.sum("n").alias("n"), F.max("own").alias("own"))


def _shift(order: int) -> Column:
    """The language of an n-gram's key of that order."""
    return F.shiftrightunsigned("key", 8 * order)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(key, logp) of each n-gram of the highest order, interpolated with the lower ones.

    Counts of the highest order are as seen, and may be zero; a lower order counts the distinct bytes to the left. Discounts per order
    and language come from counts of counts (Chen and Goodman); where those are too sparse, they are absolute. Each order
    is a table in the shared folder, dropped when the next one has it.
    """
    orders = {ORDER: counts}
    for o in range(ORDER - 1, 0, -1):
        lower = F.shiftleft(_shift(o + 1), 8 * o).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << (8 * o)) - 1)))
        orders[o] = materialize(orders[o + 1].groupBy(lower.alias("key")).agg(F.count_if(F.col("n") > 0).alias("n")), "ngrams")
    below = None
    for o in range(1, ORDER + 1):
        lang = _shift(o).alias("lang")
        seen = orders[o].groupBy(lang).agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"c{k}") for k in (1, 2, 3, 4)])
        y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))
        fits = F.least("c1", "c2", "c3", "c4") > 0
        cuts = [F.when(fits, F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(f"c{k + 1}") / F.col(f"c{k}")))).otherwise(F.lit(min(0.75 * k, 1.5))).alias(f"d{k}") for k in (1, 2, 3)]
        seen = seen.select("lang", *cuts)
        history = F.shiftrightunsigned("key", 8).alias("history")
        grams = orders[o].select(*orders[o].columns, lang, history).join(seen, "lang")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        grams = grams.withColumn("cut", F.least(cut, F.col("n") * F.lit(0.95)))
        totals = grams.groupBy("history").agg(F.sum("n").alias("all"), F.sum("cut").alias("freed"))
        grams = grams.join(totals, "history")
        if below is None:  # the lowest order shares what it freed among all 256 bytes
            p = (F.col("n") - F.col("cut") + F.col("freed") / 256) / F.col("all")
            now = grams.select("key", F.when(F.col("all") > 0, p).otherwise(F.lit(1 / 256)).alias("p"))
        else:
            lower = F.shiftleft(_shift(o), 8 * (o - 1)).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << (8 * (o - 1))) - 1)))
            grams = grams.withColumn("lower", lower).join(below.select(F.col("key").alias("lower"), F.col("p").alias("q")), "lower")
            p = (F.col("n") - F.col("cut") + F.col("freed") * F.col("q")) / F.col("all")
            p = F.when(F.col("all") > 0, p).otherwise(F.col("q"))  # a history that the counts don't have says nothing
            now = grams.select("key", p.alias("p"), *(c for c in orders[o].columns if c == "own"))
        below, used = materialize(now, "probabilities"), below
        for t in (orders[o], used):
            if t is not None:
                drop(t)
    below = below.where("own") if "own" in below.columns else below
    return below.select("key", F.log("p").cast("float").alias("logp"))


class SortedModel:
    """Sorted keys and log-probabilities, with a table of direct slots in front for most lookups."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray):
        self.keys, self.logp = keys, logp
        bits = max(10, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_key, self.slot_logp = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        order = np.argsort(logp, kind="stable")  # of keys with one slot the likelier stays
        slot = self._slot(keys[order])
        self.slot_key[slot], self.slot_logp[slot] = keys[order], logp[order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(BASE)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.slot_logp[slot]
        missed = np.flatnonzero(self.slot_key[slot] != keys)
        out[missed] = self.logp[np.searchsorted(self.keys, keys[missed])]
        return out


@functools.lru_cache(maxsize=2)
def _loaded(broadcast_id: int, holder) -> SortedModel:
    keys, logp = holder.value
    return SortedModel(np.frombuffer(keys, np.int64), np.frombuffer(logp, np.float32))


def _by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(np.float64), offsets[:-1]) if len(offsets) > 1 else np.zeros(0)


def _distinct(texts: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of the texts by path, then key, and where each path begins (one more at the end)."""
    found = [np.unique(ngram_keys(texts[at : at + s.count], codes[at : at + s.count])[0]) for at, s in slices(texts)]
    key = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))
    path = (key % PATHS).astype(np.uint8)
    return key[np.argsort(path, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(path, minlength=PATHS))))


def _asked(dealt: DataFrame, model: DataFrame, chunks: int) -> DataFrame:
    """(path, grp, member, data): for each chunk (member) and path the packed log-probabilities of its distinct n-grams.

    A message has a chunk's keys of a path. Those of MEET chunks meet the model's rows of the path, so a task holds some
    megabytes and the model is sent once for each MEET chunks.
    """

    def ask(table: pa.Table) -> pa.Table:
        key, at = _distinct(column_bytes(table["text"]), table["code"].to_numpy())
        chunk, packer = table[CHUNK][0].as_py(), zstandard.ZstdCompressor(level=1)
        some = [p for p in range(PATHS) if at[p] < at[p + 1]]
        data = [packer.compress(np.diff(key[at[p] : at[p + 1]], prepend=0).tobytes()) for p in some]
        return pa.table({"path": pa.array(some, pa.int32()), "grp": pa.array([chunk // MEET] * len(some), pa.int32()), "member": pa.array([chunk] * len(some), pa.int32()), "data": pa.array(data, pa.binary())})

    def answer(messages: pa.Table, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["key"].to_numpy())
        key, logp = rows["key"].to_numpy()[order], rows["logp"].to_numpy()[order]
        data, packer, reader = [], zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for x in messages["data"]:
            asked = np.cumsum(np.frombuffer(reader.decompress(x.as_py()), np.int64))
            at = np.searchsorted(key, asked)
            if not len(key) or at.max() == len(key) or (key[at] != asked).any():
                raise RuntimeError("an n-gram of the documents is not in the model")
            data.append(packer.compress(logp[at].tobytes()))
        return messages.set_column(3, "data", pa.array(data, pa.binary()))

    messages = dealt.groupBy(CHUNK).applyInArrow(ask, _MESSAGE)
    groups = F.sequence(F.lit(0), F.lit((chunks - 1) // MEET))
    rows = model.select(F.pmod("key", F.lit(PATHS)).cast("int").alias("path"), F.explode(groups).alias("grp"), "key", "logp")
    return messages.groupBy("path", "grp").cogroup(rows.groupBy("path", "grp")).applyInArrow(answer, _MESSAGE)


def score(docs: DataFrame, model: DataFrame, id_col: str, text_col: str, lang_col: str, keep: tuple[str, ...] = (), broadcast_rows: int = 4_000_000, chunk_bytes: int = 16 << 20) -> DataFrame:
    """id_col, the columns of keep, the base counts, the number of n-grams and the mean negative log-probability (nll)."""
    spark, n_model = docs.sparkSession, model.count()
    again = f"k_{text_col}"  # the text under its other name needs no second copy on the way
    source = docs.select(id_col, F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), fold_code(F.col(lang_col), F.col(text_col)).alias("code"), F.xxhash64(text_col).alias("hash"), *[F.col(c).alias(f"k_{c}") for c in keep if c != text_col])
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields} | {again: "string"}
    kept = [id_col, "lang", "hash", *[f"k_{c}" for c in keep]]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + "".join(f", {k} long" for k in (*STATS, "n_grams")) + ", sum_logp double"

    def scores(rows, lookup) -> list[pa.Array]:
        """The columns of the result for a table or batch of documents."""
        texts, codes = column_bytes(rows["text"]), rows["code"].to_numpy()
        parts = {k: [np.zeros(0, np.int64)] for k in (*STATS, "n_grams", "sum_logp")}
        for at, s in slices(texts):
            for k, v in text_counts(s).items():
                parts[k].append(v)
            key, offsets = ngram_keys(texts[at : at + s.count], codes[at : at + s.count])
            parts["n_grams"].append(np.diff(offsets))
            parts["sum_logp"].append(_by_text(lookup(key), offsets))
        counts = [pa.array(np.concatenate(parts[k]), pa.int64()) for k in (*STATS, "n_grams")]
        return [*(rows["text" if c == again else c] for c in kept), *counts, pa.array(np.concatenate(parts["sum_logp"]), pa.float64())]

    names, holder = [*kept, *STATS, "n_grams", "sum_logp"], None
    if n_model <= broadcast_rows:
        table = model.sort("key").toArrow()
        holder = spark.sparkContext.broadcast((table["key"].to_numpy().tobytes(), table["logp"].to_numpy().tobytes()))

        def scored(batches):
            try:
                for b in batches:
                    yield pa.RecordBatch.from_arrays(scores(b, _loaded(id(holder), holder)), names)
            finally:
                _loaded.cache_clear()  # a worker lives on through other operators' tasks
                release()

        out = source.mapInArrow(scored, schema)
    else:
        total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).head()[0] or 0
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        chunks = int(max(1, -(-total // chunk_bytes), min(tasks, total >> 20)))
        chunk = F.pmod(F.xxhash64(id_col, "text"), F.lit(chunks)).cast("int")  # copies of a text are dealt by their ids
        dealt = source.select(chunk.alias(CHUNK), "*").repartition(max(2, min(chunks, max(tasks, total >> 28))), CHUNK)

        def looked_up(table: pa.Table, answers: pa.Table) -> pa.Table:
            key, at = _distinct(column_bytes(table["text"]), table["code"].to_numpy())
            logp, reader = np.zeros(len(key), np.float32), zstandard.ZstdDecompressor()
            for p, x in zip(answers["path"].to_pylist(), answers["data"]):
                logp[at[p] : at[p + 1]] = np.frombuffer(reader.decompress(x.as_py()), np.float32)
            order = np.argsort(key)
            try:
                return pa.table(scores(table, SortedModel(key[order], logp[order])), names)
            finally:
                release()

        answers = _asked(dealt, model, chunks)
        out = dealt.groupBy(CHUNK).cogroup(answers.groupBy("member")).applyInArrow(looked_up, schema)
    out = out.withColumn("nll", -F.col("sum_logp") / F.col("n_grams")).drop("sum_logp")
    out._holder = holder
    return out


def bands(scored: DataFrame, width: float = WIDTH, step: float = 0.01, floor: float = FLOOR) -> DataFrame:
    """(lang, q1, q3, margin): per language, the quartiles of nll and `width` times their distance, at least `floor`.

    Each distinct text (column hash) counts once, so copies don't move the band. The quartiles are those of a histogram
    with bins of `step`: exact in any order of the rows, a few hundred rows a language. Documents that fail the base rules
    don't count.
    """
    once = scored.where("NOT base_failed").groupBy("lang", "hash").agg(F.min("nll").alias("nll"))
    bins = once.groupBy("lang", F.floor(F.col("nll") / step).alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("lang").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    mid = (F.col("bin") + 0.5) * step
    q = bins.groupBy("lang").agg(*[F.min(F.when(F.col("upto") >= F.col("all") * x, mid)).alias(name) for name, x in (("q1", 0.25), ("q3", 0.75))])
    out = F.greatest(width * (F.col("q3") - F.col("q1")), F.lit(floor))
    return q.select(F.col("lang").alias("__lang"), "q1", "q3", out.alias("margin"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = (), broadcast_rows: int = 4_000_000) -> DataFrame:
    """Base counts, perplexity and verdict of each document; columns of keep come along as k_<name>.

    base_failed: fewer than 10 words, or over 20 % of the words in five-word windows that the text repeats. kept: not
    base_failed, and the perplexity within its language's band, which is wider for texts under SHORT bytes. A null or empty text has no words and so fails; a null
    language is a language. Repeated rows are scored alike. Other columns are ignored. An empty table gives an empty one.
    """
    source = docs.select(F.col(text_col).alias("text"), fold_code(F.col(lang_col), F.col(text_col)).alias("code"), F.xxhash64(text_col).alias("hash"))
    seen = distinct_texts(source).mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    model = kneser_ney(materialize(other_fold(seen), "ngrams"))
    scored = score(docs, model, id_col, text_col, lang_col, keep, broadcast_rows)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    holder = scored._holder
    scored = materialize(scored.withColumn("base_failed", failed), "scores")
    if holder is not None:
        holder.destroy()
    limits = bands(scored)
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    margin = F.col("margin") * F.greatest(F.lit(1.0), F.sqrt(SHORT / F.greatest("n_grams", F.lit(1))))
    out = out.withColumns({"nll_low": F.col("q1") - margin, "nll_high": F.col("q3") + margin})
    inside = F.coalesce(F.col("nll").between(F.col("nll_low"), F.col("nll_high")), F.lit(True))
    return out.withColumn("perplexity", F.exp("nll")).withColumn("kept", ~F.col("base_failed") & inside).drop("__lang", "q1", "q3", "margin", "hash")
