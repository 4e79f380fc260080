"""Cores: balls so narrow that all vectors in one link, counted without comparing them.

Two vectors within half the threshold's angle of one centre link by the triangle inequality. A core's members lie in bands by
their angle to the centre. What a vector outside has to do with a band follows from its own angle to the centre: it links with
all of the band, with none, or has to be compared; only then do vectors meet, in blocks of bounded size. Angles keep a margin
far above rounding, so nothing is decided by a bound that a comparison would decide otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.plan import drop, materialize
from lumora.llm.vectors import matrix

BANDS, MARGIN = 16, 1e-6
BLOCK, VISITORS = 2048, 8192  # members of a band and vectors outside that meet in one task
LINKS = "id long, links long, pairs long, root long"


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def fit_cores(x: np.ndarray, starts: np.ndarray, least: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of balls that hold `most` rows of the sample x or more each, and the rows in none. starts are first guesses."""
    whole = float(np.arccos(np.clip(least, -1.0, 1.0)))
    half = whole / 2 - MARGIN
    left, centres = x, []
    for c in starts if half > 0 else []:
        for reach in (whole, half, half):
            near = left @ c >= np.cos(reach)
            if near.sum() < most:
                break
            mean = left[near].mean(axis=0)
            c = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 0 else c
        near = left @ c >= np.cos(half)
        if near.sum() >= most:
            centres.append(c)
            left = left[~near]
    return np.array(centres).reshape(-1, x.shape[1]), left


def by_length(batches, centres: dict[int, np.ndarray]):
    """(part of a batch, its unit vectors, its centres) for each vector length; the centres are None where there are none."""
    for b in batches:
        lengths = pc.list_value_length(b.column("vec")).to_numpy()
        for d in np.unique(lengths).tolist():
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096).filter(pa.array(lengths[s : s + 4096] == d))
                if part.num_rows:
                    yield part, matrix(part.column("vec")), centres.get(d)


def in_cores(classes: DataFrame, centres: dict[int, np.ndarray], least: float) -> DataFrame:
    """(id, n, vec, core, band, away): each class with its nearest core, if it lies in it, and its angle to the centre."""
    half = float(np.arccos(least)) / 2 - MARGIN

    def place(batches):
        for part, x, c in by_length(batches, centres):
            n, d = x.shape
            if c is None:
                core, away = np.zeros(n, np.int64), np.full(n, np.inf)
            else:
                all_ = angles(x, c)
                core = np.argmin(all_, axis=1)
                away = all_[np.arange(n), core]
            out = away > half
            band = np.minimum(np.where(out, 0, away) / half * BANDS, BANDS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("id", "n", "vec")), pa.array((d << 24) + core, mask=out), pa.array(band, mask=out), pa.array(np.where(out, 0.0, away), mask=out)], ["id", "n", "vec", "core", "band", "away"])

    return classes.select("id", "n", "vec").mapInArrow(place, "id long, n long, vec array<double>, core long, band int, away double")


def _meetings(placed: DataFrame, centres: dict[int, np.ndarray], least: float, held: dict[int, dict[int, tuple]]) -> DataFrame:
    """For each class and core it isn't in: links decided by bounds, and the bands that it has to be compared with.

    Two cores meet once, as the members of the later one with the earlier core. Rows with links are the class's own; rows with
    n and no vec are what a band's members gain, a row a batch; rows with vec are to be compared.
    """
    whole = float(np.arccos(least))
    bands = [(core, band, *v[:2]) for core, of in held.items() for band, v in of.items()]
    facts = {d: [b for b in bands if b[0] >> 24 == d] for d in centres}
    root = {core: min(v[4] for v in of.values()) for core, of in held.items()}

    def meet(batches):
        for part, x, c in by_length(batches, centres):
            if c is None:
                continue
            d = x.shape[1]
            away = angles(x, c)
            own = part.column("core").fill_null(np.iinfo(np.int64).max).to_numpy()
            ids, n = part.column("id").to_numpy(), part.column("n").to_numpy()
            links, pairs, to = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.full(len(x), -1)
            roots, gains, asked = [], [], []
            for core, band, low, high in facts[d]:
                a = away[:, core - (d << 24)]
                met = (own > core) & (a - high <= whole + MARGIN)
                all_ = met & (a + high <= whole - MARGIN)
                if all_.any():
                    rows, kinds = held[core][band][2:4]
                    links[all_] += rows
                    pairs[all_] += kinds
                    new = np.flatnonzero(all_ & (to != core))
                    to[new] = core
                    roots += [(int(ids[i]), root[core]) for i in new]
                    gains.append((core, band, int(n[all_].sum()), int(all_.sum())))
                ask = np.flatnonzero(met & ~all_)
                if len(ask):
                    asked.append((core, band, ask))
            some = np.flatnonzero(pairs)
            empty = lambda k, t: pa.nulls(k, t)
            long, vec = pa.int64(), part.column("vec").type
            names = ["core", "band", "id", "n", "vec", "links", "pairs", "root"]
            yield pa.RecordBatch.from_arrays([empty(len(some), long), empty(len(some), pa.int32()), pa.array(ids[some]), empty(len(some), long), empty(len(some), vec), pa.array(links[some]), pa.array(pairs[some]), empty(len(some), long)], names)
            k = len(roots)
            yield pa.RecordBatch.from_arrays([empty(k, long), empty(k, pa.int32()), pa.array([r[0] for r in roots], long), empty(k, long), empty(k, vec), pa.array([0] * k, long), pa.array([0] * k, long), pa.array([r[1] for r in roots], long)], names)
            k = len(gains)
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in gains], long), pa.array([g[1] for g in gains], pa.int32()), empty(k, long), pa.array([g[2] for g in gains], long), empty(k, vec), empty(k, long), pa.array([g[3] for g in gains], long), empty(k, long)], names)
            for core, band, ask in asked:
                k, at = len(ask), pa.array(ask)
                yield pa.RecordBatch.from_arrays([pa.array([core] * k, long), pa.array([band] * k, pa.int32()), pa.array(ids[ask]), pa.array(n[ask]), part.column("vec").take(at), empty(k, long), empty(k, long), empty(k, long)], names)

    return placed.select("id", "n", "vec", "core").mapInArrow(meet, "core long, band int, id long, n long, vec array<double>, links long, pairs long, root long")


def _compare(least: float):
    def compare(table: pa.Table) -> pa.Table:
        member = table["member"].to_numpy(zero_copy_only=False)
        ids, n, x = table["id"].to_numpy(), table["n"].to_numpy(), matrix(table["vec"])
        a, b = np.flatnonzero(member), np.flatnonzero(~member)
        links, pairs, root = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.full(len(ids), -1)
        for s in range(0, len(a), 512):
            some = a[s : s + 512]
            hit = x[some] @ x[b].T >= least
            links[some] += hit @ n[b]
            pairs[some] += hit.sum(axis=1)
            links[b] += n[some] @ hit
            pairs[b] += hit.sum(axis=0)
            first = some[np.argmax(hit, axis=0)] if len(b) else b
            root[b] = np.where(hit.any(axis=0), first, root[b])
        some, led = np.flatnonzero(pairs), np.flatnonzero(root >= 0)
        rows = np.concatenate((some, led))
        counted = np.arange(len(rows)) < len(some)
        return pa.table({"id": ids[rows], "links": np.where(counted, links[rows], 0), "pairs": np.where(counted, pairs[rows], 0), "root": pa.array(ids[root[rows]], mask=counted)})

    return compare


def core_links(placed: DataFrame, centres: dict[int, np.ndarray], least: float) -> DataFrame:
    """(id, links, pairs, root), as link_classes gives them, of every link with a member of a core; all are exact.

    The driver holds a few numbers for each band of each core, of which there are fewer than centroids. A band's members are
    sent once for every 8192 vectors that have to be compared with it, those once for every 2048 members.
    """
    spark = placed.sparkSession
    members = placed.where("core IS NOT NULL")
    held: dict[int, dict[int, tuple]] = {}
    for r in members.groupBy("core", "band").agg(F.min("away"), F.max("away"), F.sum("n"), F.count("*"), F.min("id")).collect():
        held.setdefault(r[0], {})[r[1]] = tuple(r[2:])
    met = materialize(_meetings(placed, centres, least, held), "meetings")
    gain = {(r[0], r[1]): r[2:] for r in met.where("core IS NOT NULL AND vec IS NULL").groupBy("core", "band").agg(F.sum("n"), F.sum("pairs")).collect()}
    rows = []
    for core, of in held.items():
        total, kinds, least_id = sum(v[2] for v in of.values()), sum(v[3] for v in of.values()), min(v[4] for v in of.values())
        rows += [(core, band, total + gain.get((core, band), (0, 0))[0], kinds - 1 + gain.get((core, band), (0, 0))[1], least_id) for band in of]
    totals = spark.createDataFrame(rows, "core long, band int, total long, kinds long, least_id long")
    inner = members.join(F.broadcast(totals), ["core", "band"])
    own = inner.select("id", (F.col("total") - F.col("n")).alias("links"), F.col("kinds").alias("pairs"), F.lit(None).cast("long").alias("root"))
    led = inner.where("id <> least_id").select("id", F.lit(0).cast("long").alias("links"), F.lit(0).cast("long").alias("pairs"), F.col("least_id").alias("root"))
    asked = met.where("vec IS NOT NULL")
    blocks = [(r[0], r[1], -(-held[r[0]][r[1]][3] // BLOCK), -(-r[2] // VISITORS)) for r in asked.groupBy("core", "band").count().collect()]
    sizes = F.broadcast(spark.createDataFrame(blocks, "core long, band int, own_blocks long, their_blocks long"))

    def dealt(df: DataFrame, member: bool) -> DataFrame:
        mine, other = ("own_blocks", "their_blocks") if member else ("their_blocks", "own_blocks")
        block, each = F.pmod(F.xxhash64("id"), F.col(mine)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        i, j = (block, each) if member else (each, block)
        return df.join(sizes, ["core", "band"]).select("core", "band", i.alias("i"), j.alias("j"), F.lit(member).alias("member"), "id", "n", "vec")

    compared = dealt(members, True).unionAll(dealt(asked, False)).groupBy("core", "band", "i", "j").applyInArrow(_compare(least), LINKS)
    out = materialize(own.unionAll(led).unionAll(met.where("links IS NOT NULL").select("id", "links", "pairs", "root")).unionAll(compared), "core-links")
    drop(met)
    return out
