"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement over the lattice.

A text's lattice has every way to cut it into vocabulary pieces; a character that is no piece falls back to its bytes. A
piece never has a space after another character, so the lattice is a chain of units (spaces and the word after them).
Each distinct unit's lattice is built once a slice, with the exact probability of every piece given where it starts, from
sums over all ways to go on.

Segmentations come in the order of their perturbed log-probabilities, by A-star search from the top: the largest Gumbel
of the whole space belongs to a plain sample; the rest parts into the sets that leave that sample at its first, second ..
piece; each set's largest Gumbel is one truncated at its parent's, so the set with the largest is next. The search
never enumerates, and no segmentation comes twice. Numbers come from hashes of row key, sample, unit and step.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumora.llm.arrays import BASE, Slice, column_bytes, mix, parts, release

SPACE_MARK = "▁"
SLICE = 3 << 19  # bytes of text whose distinct units are built together


class Vocabulary:
    """Pieces as bytes (the mark is a space), a trie over them, and log-weights.

    BPE models score pieces by merge rank, which is no log-probability; the weight of rank r is -log(r + 1) by Zipf's law,
    less `length_cost` a piece.
    """

    def __init__(self, path: str, length_cost: float = 4.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        if n > 65536:
            raise ValueError("ids must fit 16 bits")
        self.surface: list[bytes] = [b""] * n
        self.byte_id, pieces = np.zeros(256, np.int64), []
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[b], self.surface[i] = i, bytes([b])
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                text = sp.id_to_piece(i).replace(SPACE_MARK, " ")
                if " " in text.lstrip(" "):
                    raise ValueError("a piece crosses words")
                self.surface[i] = text.encode()
                pieces.append(i)
        ranks = {i: r for r, i in enumerate(sorted(pieces, key=lambda i: -sp.get_score(i)))}
        self.weight = np.full(n, -np.log(n + 1) - length_cost)
        for i, r in ranks.items():
            self.weight[i] = -np.log(r + 1) - length_cost
        self.byte_weight = float(-np.log(n + 1) - length_cost)
        children: dict[tuple[int, int], int] = {}
        ends = {}
        for i in pieces:
            node = 0
            for b in self.surface[i]:
                node = children.setdefault((node, b), len(children) + 1)
            ends.setdefault(node, i)
        self.piece_at = np.full(len(children) + 1, -1, np.int64)
        self.piece_at[list(ends)] = list(ends.values())
        keys = np.fromiter((p << 8 | b for p, b in children), np.int64, len(children))
        order = np.argsort(keys)
        self.child_key, self.child = keys[order], np.fromiter(children.values(), np.int64, len(children))[order]
        self.shift = np.uint64(64 - (4 * len(keys)).bit_length())  # a table of direct slots, and the few keys that found theirs taken
        slot = self._slot(self.child_key)
        self.slot_key = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.slot_child = np.full(len(self.slot_key), -1, np.int32)
        self.slot_key[slot], self.slot_child[slot] = self.child_key, self.child
        lost = self.slot_key[slot] != self.child_key
        self.lost_slot = np.zeros(len(self.slot_key), bool)
        self.lost_slot[slot[lost]] = True
        self.child_key, self.child = self.child_key[lost], self.child[lost]
        self.root = np.full(256, -1, np.int64)
        self.root[[b for p, b in children if p == 0]] = [c for (p, _), c in children.items() if p == 0]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(BASE)) >> self.shift).view(np.int64)

    def step(self, nodes: np.ndarray, octets: np.ndarray) -> np.ndarray:
        key = nodes << 8 | octets
        slot = self._slot(key)
        other = self.slot_key[slot] != key
        out = self.slot_child[slot].astype(np.int64)
        out[other] = -1
        if len(self.child_key):
            more = np.flatnonzero(other & self.lost_slot[slot])
            at = np.minimum(np.searchsorted(self.child_key, key[more]), len(self.child_key) - 1)
            out[more] = np.where(self.child_key[at] == key[more], self.child[at], -1)
        return out

    def decode(self, ids) -> bytes:
        """The text of ids: the pieces in a row, without the space that encoding puts in front."""
        return b"".join(map(self.surface.__getitem__, ids))[1:]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattices:
    """The lattices of distinct units: edges by node, likeliest first, with conditional log-probabilities."""

    def __init__(self, v: Vocabulary, units: list[bytes]):
        raw = b"".join(units)
        data = np.frombuffer(raw, np.uint8).astype(np.int64)
        self.data = data
        size = np.fromiter(map(len, units), np.int64, len(units))
        begin = np.cumsum(size) - size
        unit = np.repeat(np.arange(len(units)), size)
        ends = (begin + size)[unit]
        self.start = begin + np.arange(len(units))  # a unit has a node for each byte and one for its end
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        following = np.append(lead[1:], len(data))
        src, dst, piece = [], [], []
        at, node, depth = lead, v.root[data[lead]], 1
        single = np.zeros(len(data), bool)
        char_end = np.zeros(len(data), np.int64)
        char_end[lead] = following
        while True:
            live = node >= 0
            at, node = at[live], node[live]
            if not len(at):
                break
            found = v.piece_at[node]
            hit = np.flatnonzero(found >= 0)
            begins = at[hit]
            src.append(begins)
            dst.append(begins + depth)
            piece.append(found[hit])
            single[begins[begins + depth == char_end[begins]]] = True
            go = at + depth < ends[at]
            at, node = at[go], node[go]
            node = v.step(node, data[at + depth])
            depth += 1
        alone = lead[~single[lead]]
        src.append(alone)
        dst.append(char_end[alone])
        piece.append(np.full(len(alone), -1))

        # edges by node, the longest first, which is mostly the likeliest
        n_nodes = len(data) + len(units)
        counts = np.bincount(np.concatenate(src), minlength=len(data) + 1)[: len(data)]
        node_of = np.arange(len(data)) + unit
        self.first = np.zeros(n_nodes + 1, np.int64)
        self.first[node_of + 1] = counts
        np.cumsum(self.first, out=self.first)
        free = self.first[node_of].copy()
        total = int(self.first[-1])
        self.src, self.dst, self.piece = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total, np.int32)
        for x, y, i in zip(reversed(src), reversed(dst), reversed(piece)):
            to = free[x]
            free[x] += 1
            self.src[to], self.dst[to], self.piece[to] = x + unit[x], y + unit[x], i
        weight = np.where(self.piece >= 0, v.weight[self.piece], v.byte_weight * (self.dst - self.src))

        left = ends[lead] - lead
        by_left = np.argsort(left.astype(np.uint16), kind="stable") if left.max(initial=0) < 65536 else np.argsort(left, kind="stable")
        nodes, left = node_of[lead[by_left]], left[by_left]
        low, size_of = self.first[nodes], self.first[nodes + 1] - self.first[nodes]
        upto = np.cumsum(size_of)
        edge = np.repeat(low - (upto - size_of), size_of) + np.arange(total)
        beta = np.zeros(n_nodes)
        levels = np.concatenate((np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1]))), [len(left)])).tolist() if len(left) else [0]
        to, cost = self.dst[edge], weight[edge]
        for a, b in zip(levels[:-1], levels[1:]):  # nodes with as many bytes to go: all that follows is known
            begin_e, end_e = int(upto[a] - size_of[a]), int(upto[b - 1])
            x = cost[begin_e:end_e] + beta[to[begin_e:end_e]]
            first = upto[a:b] - size_of[a:b] - begin_e
            top = np.maximum.reduceat(x, first)
            beta[nodes[a:b]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, size_of[a:b])), first))
        self.logp = np.minimum(weight + beta[self.dst] - beta[self.src], 0.0)
        self.p = np.exp(self.logp)
        running = np.concatenate(([0.0], np.cumsum(self.p)))
        self.upto = running[1:] - running[self.first[self.src]]
        last = self.first[1:][self.first[1:] > self.first[:-1]] - 1
        self.upto[last] = 2.0  # rounding never runs past a node's edges
        self.final = np.zeros(n_nodes, bool)
        self.final[self.start + size] = True

    def draw(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sampled path from each node to its unit's end: (edges in a row, number of edges a node)."""
        who, at, steps, k = np.arange(len(nodes)), nodes, [], 0
        counts = np.zeros(len(nodes), np.int64)
        live = ~self.final[at]
        who, at = who[live], at[live]
        while len(who):
            u = uniform(seeds[who] + np.uint64(k * 0x9E3779B1))
            edge = self.first[at]
            more = np.flatnonzero(u >= self.upto[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] >= self.upto[edge[more]]]
            steps.append((who, edge))
            counts[who] += 1
            at = self.dst[edge]
            live = ~self.final[at]
            who, at, k = who[live], at[live], k + 1
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for k, (w, edge) in enumerate(steps):
            out[begin[w] + k] = edge
        return out, counts


def uniform(seeds: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each seed."""
    return ((mix(seeds * np.uint64(BASE)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _keys(name: str, *parts) -> np.ndarray:
    out = np.uint64(zlib.crc32(name.encode()))
    with np.errstate(over="ignore"):
        for p in parts:
            out = mix(np.atleast_1d(out ^ np.asarray(p).astype(np.uint64)) * np.uint64(BASE) + np.uint64(1))
    return out


def _limited(phi: np.ndarray, top, u: np.ndarray) -> np.ndarray:
    """The largest Gumbel of a set with log-probability phi, given that it is below top."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = phi - np.log(-np.log(u) + np.exp(phi - top))
    return np.where(np.isneginf(phi), -np.inf, out)


def _rest(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        rest = np.log1p(-np.minimum(p, 1.0))
    return np.where(p > 1 - 1e-12, -np.inf, rest)


class Sampler:
    """Top-k segmentations of the texts of one slice."""

    def __init__(self, v: Vocabulary, texts: list[bytes], row_seeds: np.ndarray):
        self.v, self.n, self.seeds = v, len(texts), row_seeds
        s = Slice([b" " + t if t else b"" for t in texts])
        space = s.bytes == 0x20
        part = np.zeros(len(space), bool)
        part[s.offsets[:-1]] = True  # a text's first byte; for an empty one that is the byte that parts texts
        opens = part | (space & ~np.concatenate(([True], space[:-1])))
        opens[s.offsets[1:] - 1] = False
        starts = np.flatnonzero(opens)
        self.doc_unit = np.searchsorted(starts, s.offsets)
        ends = np.append(starts[1:], len(space))
        of = np.repeat(np.arange(self.n), np.diff(self.doc_unit))
        ends = np.minimum(ends, s.offsets[of + 1] - 1)
        where, self.unit, _ = s.numbers(starts, ends)
        self.lattices = Lattices(v, [s.raw[starts[i] : ends[i]] for i in where.tolist()])
        self.units = self.lattices.start[self.unit]
        self.unit_doc = of

    def top(self, k: int) -> list[list[tuple[float, float, float, np.ndarray]]]:
        """For each text up to k of (log-probability, perturbed one, inclusion score, edges), the largest perturbed first."""
        lat, n = self.lattices, self.n
        order = np.arange(len(self.units)) - self.doc_unit[self.unit_doc]
        edges, counts = lat.draw(self.units, _keys("draw", self.seeds[self.unit_doc], order, 0))
        upto = np.concatenate(([0], np.cumsum(counts)))[self.doc_unit]
        top = -np.log(-np.log(uniform(_keys("top", self.seeds))))
        leaves = [[edges[a:b]] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
        logp = lat.logp[edges]
        total = np.concatenate(([0.0], np.cumsum(logp)))
        doc = np.repeat(np.arange(n), np.diff(upto))
        place = np.arange(len(edges)) - upto[doc]
        phi = total[:-1] - total[upto[doc]] + _rest(lat.p[edges])
        queue = [{"doc": doc, "leaf": np.zeros(len(doc), np.int64), "place": place, "value": _limited(phi, top[doc], uniform(_keys("set", self.seeds[doc], 0, place)))}]
        found = [[(float(total[b] - total[a]), float(t))] for a, b, t in zip(upto[:-1].tolist(), upto[1:].tolist(), top.tolist())]
        barred: dict[tuple[int, int], list[int]] = {}  # the place where a leaf left its parent: edges that are gone there
        for r in range(1, k):
            best = self._best(queue, remove=True)
            if not best:
                break
            docs = np.fromiter(best, np.int64, len(best))
            turn = uniform(_keys("turn", self.seeds[docs], r, np.array([x[2] for x in best.values()])))
            heads, chosen, masses, units = [], [], [], []
            for (d, (_, leaf, place)), u in zip(best.items(), turn.tolist()):
                path = leaves[d][leaf]
                gone = barred.get((d, leaf, place), []) + [int(path[place])]
                node = lat.src[path[place]]
                a, b = int(lat.first[node]), int(lat.first[node + 1])
                p = lat.p[a:b].copy()
                for g in gone:
                    p[g - a] = 0
                upto_p = np.cumsum(p)
                edge = a + min(int(np.searchsorted(upto_p, u * upto_p[-1], side="right")), int(np.flatnonzero(p)[-1]))
                barred[(d, len(leaves[d]), place)] = gone
                heads.append(path[:place])
                chosen.append(edge)
                masses.append(sum(lat.p[g] for g in gone))
                units.append(np.count_nonzero(lat.final[lat.dst[path[:place]]]))
            chosen = np.array(chosen)
            unit = self.doc_unit[docs] + np.array(units)
            rest = self.doc_unit[docs + 1] - unit  # the unit that is left half-way, and those after it
            ends = np.cumsum(rest)
            every = np.repeat(unit - (ends - rest), rest) + np.arange(ends[-1])
            nodes = self.units[every]
            nodes[ends - rest] = lat.dst[chosen]
            edges, counts = lat.draw(nodes, _keys("draw", self.seeds[np.repeat(docs, rest)], every - self.doc_unit[np.repeat(docs, rest)], r))
            at = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], ends))].tolist()
            paths = [np.concatenate((h, [c], edges[x:y])) for h, c, x, y in zip(heads, chosen.tolist(), at, at[1:])]
            size = np.array([len(p) for p in paths])
            flat, doc = np.concatenate(paths), np.repeat(docs, size)
            begin = np.cumsum(size) - size
            sums = np.concatenate(([0.0], np.cumsum(lat.logp[flat])))
            place = np.arange(len(flat)) - np.repeat(begin, size)
            left_at = np.array([len(h) for h in heads])
            p = lat.p[flat].copy()
            p[begin + left_at] += np.array(masses)
            phi = sums[:-1] - sums[np.repeat(begin, size)] + _rest(p)
            leaf = np.array([len(leaves[d]) for d in best])
            top = np.array([x[0] for x in best.values()])
            value = _limited(phi, np.repeat(top, size), uniform(_keys("set", self.seeds[doc], np.repeat(leaf, size), place)))
            for d, path, lp, g in zip(best, paths, (sums[begin + size] - sums[begin]).tolist(), top.tolist()):
                leaves[d].append(path)
                found[d].append((lp, g))
            mine = place >= np.repeat(left_at, size)
            queue.append({"doc": doc[mine], "leaf": np.repeat(leaf, size)[mine], "place": place[mine], "value": value[mine]})
        beyond = self._best(queue)
        out = []
        for d in range(n):
            bar = beyond[d][0] if d in beyond else -np.inf
            out.append([(lp, g, float(-np.expm1(-np.exp(min(lp - bar, 50.0)))), path) for (lp, g), path in zip(found[d], leaves[d])])
        return out

    def _best(self, queue, remove: bool = False) -> dict[int, tuple[float, int, int]]:
        """Each text's set with the largest Gumbel."""
        best: dict[int, tuple[float, int, int, int, int]] = {}
        for q, part in enumerate(queue):
            if not len(part["doc"]):
                continue
            first = np.flatnonzero(np.concatenate(([True], part["doc"][1:] != part["doc"][:-1])))
            top = np.maximum.reduceat(part["value"], first)
            hit = np.flatnonzero(part["value"] == np.repeat(top, np.diff(np.append(first, len(part["doc"])))))
            for i in hit[np.unique(part["doc"][hit], return_index=True)[1]].tolist():
                value, d = float(part["value"][i]), int(part["doc"][i])
                if value > -np.inf and (d not in best or value > best[d][0]):
                    best[d] = (value, int(part["leaf"][i]), int(part["place"][i]), q, i)
        if remove:
            for value, _, _, q, i in best.values():
                queue[q]["value"][i] = -np.inf
        return {d: x[:3] for d, x in best.items()}

    def ids(self, paths: list[np.ndarray]) -> list[bytes]:
        """The ids of each path, little-endian unsigned 16-bit; a character without a piece gives its bytes."""
        lat = self.lattices
        path = np.concatenate([*paths, np.zeros(0, np.int64)]).astype(np.int64)
        size = np.fromiter(map(len, paths), np.int64, len(paths))
        piece = lat.piece[path]
        lone = piece < 0
        count = np.where(lone, lat.dst[path] - lat.src[path], 1)
        out = np.repeat(piece, count)
        src = lat.src[path[lone]]
        at = np.repeat(src - np.searchsorted(lat.start, src, side="right") + 1, count[lone])  # nodes have one more a unit than bytes
        step = np.arange(len(at)) - np.repeat(np.cumsum(count[lone]) - count[lone], count[lone])
        out[np.repeat(lone, count)] = self.v.byte_id[lat.data[at + step]]
        ends = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], np.cumsum(size)))] * 2
        raw = out.astype("<u2").tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def sample_segmentations(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", samples: int = 2, seed: str = "segments", check: bool = True) -> DataFrame:
    """Up to `samples` distinct segmentations of each text: (id_col, sample, n_pieces, logp, gumbel, inclusion, ids, lossless).

    sample counts from 0 by falling perturbed log-probability (gumbel). inclusion is the chance that the segmentation's
    Gumbel passes the best one left out: 1 where nothing is left. ids are little-endian unsigned 16-bit integers; lossless
    says that decoding them gives the text (null without check). A null or empty text has one empty segmentation. A text
    with fewer segmentations than asked gives what it has. Rows that share an id are sampled alike where their texts are
    equal; a null id is a key like any other. Other columns are ignored. An empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def sample(batches):
        release()
        v = vocabulary(model_path)
        for whole in batches:
            for b in (whole.slice(*at) for at in parts(whole.column(text_col), SLICE)):
                ids_in, texts = b.column(id_col), column_bytes(b.column(text_col))
                keys = np.array([zlib.crc32(f"{seed}:{x}".encode()) | (zlib.crc32(f"{x}:{seed}".encode()) << 32) for x in ids_in.to_pylist()], np.uint64)
                sampler = Sampler(v, texts, keys)
                rows: dict[str, list] = {k: [] for k in ("row", "sample", "n", "logp", "gumbel", "inclusion", "ids", "lossless")}
                paths = []
                for d, found in enumerate(sampler.top(samples)):
                    for j, (lp, g, inclusion, path) in enumerate(found):
                        paths.append(path)
                        for k, x in zip(("row", "sample", "logp", "gumbel", "inclusion"), (d, j, lp, g, inclusion)):
                            rows[k].append(x)
                rows["ids"] = sampler.ids(paths)
                del sampler, paths
                rows["n"] = [len(x) // 2 for x in rows["ids"]]
                rows["lossless"] = [v.decode(np.frombuffer(x, "<u2").tolist()) == texts[i] for x, i in zip(rows["ids"], rows["row"])] if check else [None] * len(rows["ids"])
                columns = [ids_in.take(pa.array(rows["row"], pa.int64())), *(pa.array(rows[k], t) for k, t in (("sample", pa.int32()), ("n", pa.int64()), ("logp", pa.float64()), ("gumbel", pa.float64()), ("inclusion", pa.float64()), ("ids", pa.binary()), ("lossless", pa.bool_())))]
                table = pa.table(columns, [id_col, "sample", "n_pieces", "logp", "gumbel", "inclusion", "ids", "lossless"])
                yield from table.to_batches(max_chunksize=2000)

    return docs.select(id_col, text_col).mapInArrow(sample, f"`{id_col}` {kind}, sample int, n_pieces long, logp double, gumbel double, inclusion double, ids binary, lossless boolean")


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """encoded with the text of its ids in out_col; null ids give null."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != out_col)
    names = [f.name for f in encoded.schema.fields if f.name != out_col]

    def read(batches):
        v = vocabulary(model_path)
        for b in batches:
            t = pa.Table.from_batches([b]).select(names)
            texts = [None if x is None else v.decode(np.frombuffer(x, "<u2").tolist()) for x in t[ids_col].to_pylist()]
            yield from t.append_column(out_col, pa.array(texts, pa.binary()).cast(pa.string())).to_batches()

    return encoded.select(*names).mapInArrow(read, f"{kinds}, `{out_col}` string")
