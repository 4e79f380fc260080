"""A Merkle manifest of a table: a root, and for each row the siblings that prove its place under it.

Levels are windows: rows partitioned by group and parent, in order, whose full-frame collect_list is the parent's preimage and
every child's siblings at once. A parent has one row before the next level, that of its leftmost child; the others keep a null
node, which collect_list passes over, so that they go on gathering siblings. After `levels` windows, which share one shuffle by
group and block, only the rows with a node go on to the next round. Each round has arity**levels times fewer rows than the one
before it. The way down is one join a round by group and block, each of which has few rows: no group meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm.plan import materialize

PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value's unambiguous form: its UTF-8 length, a colon and itself; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf has with the siblings of a path."""
    return F.aggregate(path, leaf, lambda below, s: digest(F.concat(s["left"], below, s["right"])))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with idx, their place within grp in the given order, from 0, and n, their number there.

    Ranges of (grp, order) are sorted apart and stored with each row's position; what comes before a range in its group is a
    running sum over one row for each range and group.
    """
    dealt = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    stored = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    stored = stored.select("*", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"))
    ranges = stored.groupBy("grp", "range").agg(F.min("pos").alias("least"), F.count("*").alias("here"))
    earlier = Window.partitionBy("grp").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("grp", "range", "least", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy("grp")).alias("n"))
    return stored.join(ranges, ["grp", "range"]).withColumn("idx", F.col("pos") - F.col("least") + F.col("before")).drop("at", "range", "pos", "least", "before")


def _levels(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """`levels` levels over (grp, idx, n, node, ...): adds block, path, top (the block's node); node is left at the leftmost row."""
    now = nodes.select("*", F.expr(f"idx div {arity**levels}").alias("block"), F.array().cast(PATH).alias("path")).repartition("grp", "block")
    for level in range(levels):
        below = arity**level
        family = Window.partitionBy("grp", "block", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        now = now.withColumn("parent", F.expr(f"idx div {below * arity}")).withColumn("run", F.collect_list("node").over(family))
        place, many = F.expr(f"cast(idx div {below} % {arity} as int)"), F.col("n") > below  # of the group, more than one node is left
        step = F.struct(F.array_join(F.slice("run", F.lit(1), place), "").alias("left"), F.array_join(F.slice("run", place + 2, F.lit(arity)), "").alias("right"))
        now = now.withColumns(
            {
                "path": F.when(many, F.concat("path", F.array(step))).otherwise(F.col("path")),
                "node": F.when(F.col("idx") % (below * arity) == 0, F.when(many, digest(F.array_join("run", ""))).otherwise(F.col("node"))),
            }
        )
    return now.withColumn("top", F.max("node").over(Window.partitionBy("grp", "block"))).drop("parent", "run")


def rounds(nodes: DataFrame, arity: int, levels: int, name: str) -> list[DataFrame]:
    """Tables of (grp, idx, n, block, path, node, top, ...), each of the blocks' nodes of the one before it."""
    width, out = arity**levels, []
    most = nodes.agg(F.max("n")).head()[0] or 0
    while True:
        out.append(materialize(_levels(nodes, arity, levels), name))
        if most <= width:
            return out
        most = -(-most // width)
        nodes = out[-1].where((F.col("n") > width) & F.col("node").isNotNull()).select("grp", F.col("block").alias("idx"), F.expr(f"(n + {width - 1}) div {width}").alias("n"), "node")


def tops(tables: list[DataFrame], arity: int, levels: int) -> DataFrame:
    """(grp, node): each group's last node."""
    ends = [t.where((F.col("n") <= arity**levels) & (F.col("idx") == 0)).select("grp", F.col("top").alias("node")) for t in tables]
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    return out


def with_paths(tables: list[DataFrame], ends: DataFrame, arity: int, levels: int) -> DataFrame:
    """The first table's rows with their whole path; ends has (grp, path, ...) from the group's last node on, and is handed down."""
    width, above = arity**levels, None
    handed = [c for c in ends.columns if c not in ("grp", "path")]
    for table in reversed(tables):
        finished = table.where((F.col("n") <= width) & (F.col("idx") == 0)).select("grp").join(ends, "grp")
        up = finished.select("grp", F.lit(0).cast("long").alias("block"), F.col("path").alias("rest"), *handed)
        if above is not None:
            up = up.union(above.select("grp", F.col("idx").alias("block"), F.col("path").alias("rest"), *handed))
        above = table.join(up, ["grp", "block"]).withColumn("path", F.concat("path", "rest")).drop("rest", "block", "node", "top", "n")
    return above


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", tampered: dict[str, Column] | None = None, arity: int = 2, levels: int = 8) -> DataFrame:
    """A row for each of docs: id, leaf, given_leaf, subroot, root, path, folded_root, verified.

    tampered: columns that replace others in given_leaf, which is what the path's siblings are folded with; without it
    given_leaf is leaf, and all rows are verified. Rows of a group are in order of id, nulls first, then of leaf; equal rows
    are leaves of their own. A null group comes before the empty one. Null and empty values differ. An empty table has no
    rows. Other columns are left out, whatever their names. A group of one row has its leaf as subroot.
    """
    given = {c: (tampered or {}).get(c, F.col(c)) for c in fields}
    leaf = digest(F.concat(*[field(F.col(c)) for c in fields]))
    grp = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    changed = F.lit(False)
    for c in tampered or {}:
        changed = changed | ~F.col(c).eqNullSafe(given[c])
    given_leaf = F.when(changed, digest(F.concat(*[field(given[c]) for c in fields])))
    leaves = docs.select(grp.alias("grp"), F.col(id_col).alias("id"), leaf.alias("node"), given_leaf.alias("given"), F.monotonically_increasing_id().alias("row"))
    leaves = materialize(leaves.withColumn("leaf", F.col("node")), "leaves")  # the texts are read once
    below = rounds(numbered(leaves, ["id", "leaf", "row"], "numbered"), arity, levels, "nodes")
    groups = tops(below, arity, levels)
    above = rounds(numbered(groups.select(F.lit("").alias("grp"), "node", F.col("grp").alias("of")), ["of"], "groups"), arity, levels, "tops")
    last = tops(above, arity, levels).select("grp", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    ends = with_paths(above, last, arity, levels).join(groups.select(F.col("grp").alias("of"), F.col("node").alias("subroot")), "of")
    whole = with_paths(below, materialize(ends.select(F.col("of").alias("grp"), "path", "subroot", "root"), "ends"), arity, levels)
    out = whole.select(F.col("id").alias(id_col), "leaf", F.coalesce("given", "leaf").alias("given_leaf"), "subroot", "root", "path")
    out = out.withColumn("folded_root", folded(F.col("given_leaf"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def sevenths(id_col: str = "doc_id", count_col: str = "n_chars") -> dict[str, Column]:
    """One more in count_col where 7 divides the crc32 of the decimal id."""
    hit = F.crc32(F.col(id_col).cast("string")) % 7 == 0
    return {count_col: F.when(hit, F.col(count_col) + 1).otherwise(F.col(count_col))}


ORACLE = r"""
WITH RECURSIVE d AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))) AS crc FROM documents),
f AS (SELECT doc_id, lang, n_chars, crc,
        coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS head,
        coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS tail FROM d),
l AS (SELECT doc_id, coalesce('=' || lang, '') AS grp,
        sha256(head || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
        sha256(head || coalesce(strlen(m::VARCHAR)::VARCHAR || ':' || m::VARCHAR, '-') || tail) AS given
      FROM (SELECT *, CASE WHEN xor(crc, 4294967295::BIGINT) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS m FROM f)),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l),
low AS (SELECT grp, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM p GROUP BY grp
  UNION ALL SELECT grp, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM low WHERE len(nodes) > 1),
subs AS (SELECT grp, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY grp) - 1 AS gidx FROM low WHERE len(nodes) = 1),
high AS (SELECT 0 AS level, list(subroot ORDER BY gidx) AS nodes FROM subs
  UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM high WHERE len(nodes) > 1),
top AS (SELECT nodes[1] AS root FROM high WHERE len(nodes) = 1),
steps AS (SELECT p.doc_id, p.leaf, w.level, (p.idx // (2 ** w.level)::BIGINT) AS pl, w.nodes FROM p JOIN low w ON w.grp = p.grp WHERE len(w.nodes) > 1
  UNION ALL SELECT p.doc_id, p.leaf, s.height + h.level, (s.gidx // (2 ** h.level)::BIGINT), h.nodes FROM p JOIN subs s ON s.grp = p.grp CROSS JOIN high h WHERE len(h.nodes) > 1),
sibs AS (SELECT doc_id, leaf, level, CASE WHEN pl % 2 = 1 THEN nodes[pl] ELSE '' END AS lft, CASE WHEN pl % 2 = 0 THEN coalesce(nodes[pl + 2], '') ELSE '' END AS rgt FROM steps),
ways AS (SELECT doc_id, leaf, string_agg(lft || rgt, '' ORDER BY level) AS proof, list({'lft': lft, 'rgt': rgt} ORDER BY level) AS way FROM sibs GROUP BY doc_id, leaf),
fold AS (SELECT p.doc_id, p.leaf, p.grp, p.given AS acc, 0 AS k, coalesce(y.way, []) AS way, coalesce(y.proof, '') AS proof FROM p LEFT JOIN ways y ON y.doc_id = p.doc_id AND y.leaf = p.leaf
  UNION ALL SELECT doc_id, leaf, grp, sha256(way[k + 1].lft || acc || way[k + 1].rgt), k + 1, way, proof FROM fold WHERE k < len(way))
SELECT f.doc_id, f.leaf, s.subroot, t.root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = t.root AS verified
FROM fold f JOIN subs s ON s.grp = f.grp CROSS JOIN top t WHERE f.k = len(f.way)
"""
