"""Near copies by true similarity: documents whose sets of `words`-word shingles have a Jaccard similarity of `least` or more.

1. Texts with the same lower-cased words form a class. Classes whose SimHash fingerprints differ in at most `radius` bits
   are candidates of each other, found through the vantage-point shards of simhash.py.
2. A fingerprint radius that reaches 0.8 (10 of 64 bits on average) prunes nothing, so a class has BANDS min-wise keys
   besides, each over ROWS hashes of its shingles. Two classes of similarity s share one with chance
   1 - (1 - s**ROWS)**BANDS: 0.999995 at 0.8, more above.
3. Classes that share a key are joined to the key's smallest one, and the components of all these edges are candidates: a
   pair that is linked by a key or by fingerprints lies within one. No pairs are formed, so the rows grow with the classes.
4. Each candidate's shingle sets meet in one task, which links those of similarity `least` or more, counted exactly. A
   component of more than `block` members is dealt to blocks, and each two of its blocks meet in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.arrays import BASE, column_bytes, mix, parts, release, slices, window_hashes
from lumora.llm.plan import connected_components, drop, materialize
from lumora.llm.simhash import fingerprint, link_classes

BANDS, ROWS = 40, 6
_FACTORS = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SMALL = 48  # up to so many members, all pairs are tried


def plain(text: bytes) -> bytes:
    """The lower-cased words with one space between."""
    return b" ".join(text.translate(_LOWER).split())


def class_keys(texts: list[bytes]) -> np.ndarray:
    """The class of each plain text."""
    return np.array([xxhash.xxh64_intdigest(t, 5) for t in texts], np.uint64).view(np.int64)


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each plain text; one of fewer words is one shingle, an empty one has none."""
    out = []
    for _, s in slices(texts):
        starts, ends, first = s.words()
        at, hashes = window_hashes(s.hashes(starts, ends), first, words)
        cut = np.searchsorted(at, first)
        for i in range(s.count):
            if cut[i] < cut[i + 1]:
                out.append(np.unique(hashes[cut[i] : cut[i + 1]]))
            else:
                whole = s.raw[s.offsets[i] : s.offsets[i + 1] - 1]
                out.append(np.array([xxhash.xxh64_intdigest(whole, 6)] if whole else [], np.uint64))
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each set (rows); the sets have at least one member."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    first = 0
    while first < len(sets):  # about 2**18 hashes at a time
        upto, size = first, 0
        while upto < len(sets) and (upto == first or size + len(sets[upto]) <= 1 << 18):
            size += len(sets[upto])
            upto += 1
        flat = np.concatenate(sets[first:upto])
        begin = np.cumsum([0, *map(len, sets[first : upto - 1])])
        for band in range(BANDS):
            key = np.full(upto - first, band + 1, np.uint64) * np.uint64(BASE)
            for factor in _FACTORS[band * ROWS : (band + 1) * ROWS]:
                key = mix(key ^ np.minimum.reduceat(flat * factor, begin))
            out[first:upto, band] = key
        first = upto
    return out


def _similar(one: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    """Which sets have a Jaccard similarity of `least` or more with one."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    both = np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return both >= least * (sizes + len(one) - both) - 1e-9


def roots(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Each set's root under the links of all pairs that share a key (all pairs of a few sets) and are similar enough.

    Sets that are linked already aren't compared again, so a large group of copies costs about one pass.
    """
    n = len(sets)
    root = np.arange(n)
    if n <= _SMALL:
        buckets = [np.arange(n)]
    else:
        keys = band_keys(sets)
        buckets = []
        for band in range(BANDS):
            order = np.argsort(keys[:, band], kind="stable")
            edge = np.flatnonzero(np.diff(keys[order, band])) + 1
            buckets += [b for b in np.split(order, edge) if len(b) > 1]
    for bucket in buckets:
        for k, i in enumerate(bucket):
            if (root[bucket] == root[bucket[0]]).all():
                break
            others = bucket[k + 1 :]
            others = others[root[others] != root[i]]
            if len(others):
                hit = others[_similar(sets[i], [sets[j] for j in others], least)]
                linked = np.unique(root[np.append(hit, i)])
                root[np.isin(root, linked)] = linked[0]
    return root


def row_key(columns: tuple[str, ...]) -> Column:
    """64 bits of a row; a null differs from every value."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def link_members(members: DataFrame, least: float, per_task: int = 2000, block: int = 4000) -> DataFrame:
    """(cls, root) of the members (component, cls, shingles) that are linked with another; root is one class of the group."""
    sizes = materialize(members.groupBy("component").count(), "sizes")
    rows, largest = sizes.agg(F.sum("count"), F.max("count")).head()
    tasks = max(1, (rows or 0) // per_task)

    def link(table: pa.Table) -> pa.Table:
        component, cls = table["group"].to_numpy(), table["cls"].to_numpy()
        order = np.lexsort((cls, component))
        order = order[np.concatenate(([True], (np.diff(cls[order]) != 0) | (np.diff(component[order]) != 0)))]  # repeated rows
        raw = table["shingles"].to_pylist()
        moved, to = [], []
        for group in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            root = roots([np.frombuffer(raw[i], np.uint64) for i in group], least)
            moved.append(cls[group])
            to.append(cls[group[root]])
        return pa.table({"cls": np.concatenate(moved), "root": np.concatenate(to)})

    if (largest or 0) <= block:
        dealt = members.withColumn("group", F.col("component")).withColumn("task", F.pmod(F.xxhash64("component"), F.lit(tasks)))
        return dealt.select("task", "group", "cls", "shingles").groupBy("task").applyInArrow(link, "cls long, root long").where("cls <> root")
    blocks = F.ceil(F.col("count") / block).cast("int")
    dealt = members.join(sizes, "component").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> own OR blocks = 1")
    met = met.withColumn("group", F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")))
    # components of one block share tasks; a pair of blocks has a task of its own
    met = met.withColumn("task", F.when(F.col("blocks") > 1, F.col("group")).otherwise(F.pmod(F.xxhash64("component"), F.lit(tasks))))
    edges = met.select("task", "group", "cls", "shingles").groupBy("task").applyInArrow(link, "cls long, root long").where("cls <> root")
    groups = connected_components(edges, "cls", "root")
    return groups.where("node <> component").select(F.col("node").alias("cls"), F.col("component").alias("root"))


def drop_near_copies(docs: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, radius: int = 2) -> DataFrame:
    """The columns of one row of each group of documents linked by a similarity of `least` or more: that with the smallest id.

    Rows are told apart by their values, not by id, so an id may come with several texts; equal rows are one. A row
    without an id stays only where no member of its group has one. Rows without words are copies of each other. Columns
    other than those asked for are ignored. An empty table gives an empty one.
    """
    keyed = docs.select(*columns, row_key(columns).alias("__row"))

    def sign(batches):
        release()
        for b in batches:
            for part in (b.slice(*at) for at in parts(b.column("text"), 1 << 20)):
                texts = [plain(t) for t in column_bytes(part.column("text"))]
                sets = shingles(texts, words)
                size = np.array([BANDS if len(s) else 0 for s in sets], np.int32)
                some = [s for s in sets if len(s)]
                keys = band_keys(some).view(np.int64).ravel() if some else np.zeros(0, np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(keys))
                prints = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), pa.array(class_keys(texts)), pa.array(prints), bands], ["id", "row", "cls", "fp", "bands"])
        b = part = texts = sets = some = keys = bands = prints = None
        release()

    kind = docs.schema[id_col].dataType.simpleString()
    source = keyed.select(F.col(id_col).alias("id"), F.col("__row").alias("row"), F.col(text_col).alias("text"))
    signed = materialize(source.mapInArrow(sign, f"id {kind}, row long, cls long, fp long, bands array<long>"), "signatures")

    classes = signed.dropDuplicates(["cls"])
    keys = materialize(classes.select("cls", F.explode("bands").alias("band")), "bands")
    shared = keys.groupBy("band").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a < z").select("band", "a")
    by_key = keys.join(shared, "band").where("cls <> a").select("a", F.col("cls").alias("b"))
    prints = materialize(classes.where("size(bands) > 0").groupBy("fp").agg(F.min("cls").alias("least"), F.max("cls").alias("most")), "prints")
    near_prints = materialize(link_classes(prints.select("fp"), radius), "fingerprint-links")
    same_print = classes.where("size(bands) > 0").join(prints.where("least < most"), "fp").where("cls <> least").select(F.col("least").alias("a"), F.col("cls").alias("b"))
    one, two = (prints.select(F.col("fp").alias(c), F.col("least").alias(f"cls_{c}")) for c in ("a", "b"))
    by_print = near_prints.join(one, "a").join(two, "b").select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))
    groups = materialize(connected_components(by_key.unionAll(same_print).unionAll(by_print)), "candidates")
    for table in (keys, prints, near_prints):
        drop(table)

    one = signed.groupBy("cls").agg(F.min("row").alias("row"))
    wanted = groups.select(F.col("node").alias("cls"), "component").join(one, "cls")

    def members(batches):
        release()
        for b in batches:
            for part in (b.slice(*at) for at in parts(b.column("text"), 1 << 20)):
                sets = shingles([plain(t) for t in column_bytes(part.column("text"))], words)
                yield pa.RecordBatch.from_arrays([part.column("component"), part.column("cls"), pa.array([x.tobytes() for x in sets], pa.binary())], ["component", "cls", "shingles"])
        b = part = sets = None
        release()

    found = source.select("row", "text").join(wanted, "row").select("component", "cls", "text")
    held = materialize(found.mapInArrow(members, "component long, cls long, shingles binary"), "shingles")
    linked = materialize(link_members(held, least), "links")
    drop(held)
    drop(groups)

    rows = signed.groupBy("id", "row", "cls").agg(F.count("*").alias("n")).join(linked, "cls", "left")
    best = rows.groupBy(F.coalesce("root", "cls").alias("group")).agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "cls", "row", "n")).alias("best"))
    chosen = materialize(best.select(F.col("best.row").alias("__row"), F.col("best.n").alias("__n")), "chosen")
    drop(signed)
    drop(linked)
    kept = keyed.join(chosen, "__row")
    single = kept.where("__n = 1").select(*columns)
    equal = kept.where("__n > 1").dropDuplicates(["__row"]).select(*columns)
    return single.unionAll(equal)
