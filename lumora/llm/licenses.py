"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then nearest-ancestor inheritance.

A candidate is a line or a paragraph with a licence word, anywhere in the text, or the whole text. Terms are weighted by
their document frequency over all documents; a term outside the templates weighs as one that no document has. A template
is a notice, a tag, or a licence's text as far as license_texts.py has it, and stands only for candidates that have the
terms that tell it from its kin: a version, `lesser`, a third clause. A licence file
(by name, or a text that is as a whole like a template) gives its licence to its directory. A file without a licence of
its own takes that of the nearest ancestor directory, found by equi-joins of its ancestor paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm.arrays import column_bytes
from lumora.llm.license_texts import TEMPLATES
from lumora.llm.plan import materialize

TRIGGER = re.compile(rb"(?i)licen[cs]|copyright|spdx|redistribut|hereby granted|public domain|free software|unencumbered|misrepresented|creative commons|cc0")
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"
_TERM = re.compile(rb"[a-z0-9]+(?:\.[0-9]+)*")
_TAG = re.compile(rb"(?i)spdx-license-identifier:[ \t]*(\(*[a-z0-9][a-z0-9 \t().+-]*)")
_PIECE = re.compile(rb"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
OPERATORS, TAG_LEAST = (b"OR", b"AND", b"WITH"), 0.6


def terms(text: bytes) -> Counter:
    """Single words and pairs, A-Z lower-cased."""
    words = _TERM.findall(text.lower())
    return Counter(words) + Counter(a + b" " + b for a, b in zip(words, words[1:]))


VOCABULARY = sorted({t for *_, text in TEMPLATES for t in terms(text.encode())})


def document_frequencies(files: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """How many documents have each template term, and the number of documents: one number a term reaches the driver."""
    known = set(VOCABULARY)
    singles = {t for t in known if b" " not in t}

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in column_bytes(b.column("t")):
                seen[b""] += 1
                words = _TERM.findall(text.lower())
                hit = singles.intersection(words)
                seen.update(hit)
                if len(hit) > 1:  # both words of a template's pair are template words
                    near = [w if w in hit else b"" for w in words]
                    seen.update(known.intersection(a + b" " + b for a, b in set(zip(near, near[1:]))))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    found = files.select(F.col(text_col).alias("t")).mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["term"]): r["n"] for r in found}
    return {t: counts.get(t, 0) for t in VOCABULARY}, counts.get(b"", 0)


class Matcher:
    """Cosine of a text to the templates whose terms it has and has not, as they ask."""

    def __init__(self, df: dict[bytes, int], n: int):
        self.unseen = math.log(n + 1) + 1
        self.idf = {t: math.log((n + 1) / (d + 1)) + 1 for t, d in df.items()}
        self.postings: dict[bytes, list[tuple[int, float]]] = {}
        self.must = [frozenset(x.encode() for x in must) for _, must, _, _ in TEMPLATES]
        self.bar = [frozenset(x.encode() for x in bar) for _, _, bar, _ in TEMPLATES]
        for i, (*_, text) in enumerate(TEMPLATES):
            weights = {t: c * self.idf.get(t, self.unseen) for t, c in terms(text.encode()).items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            for t, w in weights.items():
                self.postings.setdefault(t, []).append((i, w / norm))

    def best(self, text: bytes) -> tuple[float, str | None]:
        """(cosine, licence) of a candidate: that of its tag's expression, if it is a line with one, else of the nearest template."""
        return (self.expression(text) if b"\n" not in text else None) or self.nearest(text)

    def expression(self, text: bytes) -> tuple[float, str | None] | None:
        """A tag of several licences, each matched as a tag of its own: the expression in our names, and its lowest cosine.

        None for a tag of one licence, and where a licence isn't known. An exception after WITH stays as it is written.
        """
        tag = _TAG.search(text)
        out, scores, before = [], [], b"OR"
        for piece in _PIECE.findall(tag[1]) if tag else ():
            if piece not in b"()":
                if (piece.upper() in OPERATORS) == (before in OPERATORS):
                    break  # what follows is no part of it
                if piece.upper() in OPERATORS:
                    piece = piece.upper()
                elif before != b"WITH":
                    score, name = self.nearest(b"SPDX-License-Identifier: " + piece)
                    if name is None or score < TAG_LEAST:
                        return None
                    scores.append(score)
                    out.append(name)
                    before = piece
                    continue
                before = piece
            out.append(piece.decode())
        if len(scores) < 2 or before in OPERATORS or out.count("(") != out.count(")"):
            return None
        return min(scores), " ".join(out).replace("( ", "(").replace(" )", ")")

    def nearest(self, text: bytes) -> tuple[float, str | None]:
        held = terms(text)
        dots, norm = [0.0] * len(TEMPLATES), 0.0
        for t, c in held.items():
            w = c * self.idf.get(t, self.unseen)
            norm += w * w
            for i, x in self.postings.get(t, ()):
                dots[i] += w * x
        fits = [(dots[i], -i) for i in range(len(TEMPLATES)) if dots[i] and all(t in held for t in self.must[i]) and not any(t in held for t in self.bar[i])]
        if not fits:
            return 0.0, None
        dot, i = max(fits)
        return round(dot / math.sqrt(norm), 9), TEMPLATES[-i][0]


def candidates(text: bytes):
    """The whole text, and the lines and paragraphs with a licence word, each once; so all of them are three texts long at most."""
    line_end = part_end = -1
    for m in TRIGGER.finditer(text):
        if line_end < 0:
            yield text
        if m.start() < line_end:
            continue
        start, end = text.rfind(b"\n", 0, m.start()) + 1, text.find(b"\n", m.end())
        line_end = end = len(text) if end < 0 else end
        if end - start < len(text):
            yield text[start:end]
        if m.start() < part_end:  # a line of the paragraph before, which has been given
            continue
        first, last = text.rfind(b"\n\n", 0, m.start()) + 1, text.find(b"\n\n", m.end())
        part_end = len(text) if last < 0 else last
        if end - start < part_end - first < len(text):
            yield text[first:part_end]


BROADCAST_FOLDERS, SALTS = 100_000, 64


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", least: float = 0.6) -> DataFrame:
    """(id_col, path, license, score, origin, from_path) of every file.

    origin: 'header' for a notice in the text, 'file' for a licence file, 'inherited' with the licence file's path in
    from_path, or null with a null license. Of several candidates the highest cosine counts, of equal templates the first.
    A tag of several licences, as in `MIT OR Apache-2.0`, gives the expression in the names of the templates.
    In a directory with several licence files, the highest score counts, then the smallest path. A null or empty text has
    no candidate; a null path has no ancestor. Repeated rows are scored alike. Other columns are ignored. An empty table
    gives an empty one.
    """
    df, n = document_frequencies(files, text_col)
    kind = files.schema[id_col].dataType.simpleString()
    base = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    base = base.withColumn("named", F.coalesce(F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENSE_NAME), F.lit(False)))

    def match(batches):
        matcher, known = Matcher(df, n), {}
        for b in batches:
            out = []
            for text, named in zip(column_bytes(b.column("text")), b.column("named").to_pylist()):
                best, whole = (0.0, None), False
                for c in candidates(text):
                    score = known.get(c) or matcher.best(c)
                    if len(c) < 400 and len(known) < 100_000:
                        known[c] = score
                    if score[0] > best[0]:
                        best, whole = score, len(c) >= 0.8 * len(text.strip())
                ok = best[0] >= least
                out.append((best[1] if ok else None, best[0] if ok else None, ("file" if named or whole else "header") if ok else None))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("path"), *columns], ["id", "path", "license", "score", "origin"])

    # four parts of the plan read the matches; as a table each text is matched once
    found = materialize(base.mapInArrow(match, f"id {kind}, path string, license string, score double, origin string"), "licenses")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    files_of = Window.partitionBy("folder").orderBy(F.desc("score"), "from_path")
    given = found.where("origin = 'file' AND path IS NOT NULL").select(folder.alias("folder"), F.col("license").alias("given"), F.col("path").alias("from_path"), "score")
    given = given.withColumn("k", F.row_number().over(files_of)).where("k = 1").select("folder", "given", "from_path")
    # folders, not files, meet their ancestors: a third of all files in one folder is one row here
    folders = found.where("license IS NULL AND path IS NOT NULL").select(folder.alias("own")).distinct()
    parts = F.split("own", "/")
    up = folders.select("own", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("depth", "folder"))
    nearest = up.join(given, "folder").groupBy("own").agg(F.max_by(F.struct("given", "from_path"), "depth").alias("near"))
    nearest = materialize(nearest, "folders")
    if nearest.count() <= BROADCAST_FOLDERS:  # a path and a few words each
        out = found.join(F.broadcast(nearest), F.col("license").isNull() & (folder == F.col("own")), "left")
    else:  # files of one folder are dealt to SALTS keys, each of which has the folder's answer
        salt = F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int")
        spread = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = found.withColumn("__salt", salt).join(spread, F.col("license").isNull() & (folder == F.col("own")) & (F.col("__salt") == F.col("salt")), "left")
    taken = F.col("near").isNotNull()
    return out.select(
        F.col("id").alias(id_col), "path", F.coalesce("license", "near.given").alias("license"), "score",
        F.coalesce("origin", F.when(taken, F.lit("inherited"))).alias("origin"), F.col("near.from_path").alias("from_path"),
    )
