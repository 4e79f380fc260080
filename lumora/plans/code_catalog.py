"""Queries of program-text features and their SQL; importing this module adds them to the catalogue.

The test tables hold prose, so each document's whole text is set into program lines by one expression that both sides read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions import code as C
from lumora.functions import text as T
from lumora.plans.catalog import _scored, query, survey_sql, table

_N = "chr(10)"
CODE = f"""concat(
  CASE WHEN doc_id % 3 = 0 THEN concat('import os', {_N}, 'from sys import path', {_N}) ELSE concat('total_sum = 1', {_N}) END,
  CASE WHEN doc_id % 5 < 3 THEN concat('class Item', doc_id, ':', {_N}, '    \"\"\"', {_N}) ELSE concat('# head', {_N}) END,
  coalesce(text, ''), {_N}, CASE WHEN doc_id % 2 = 0 THEN concat('    \"\"\"', {_N}, {_N}, {_N}) ELSE '' END,
  '    def get_it(self, x):  # inline', {_N}, CASE WHEN doc_id % 7 = 0 THEN chr(9) ELSE '        ' END, 'if x == 1 and (x>2 or [ x ]):', {_N},
  '            Value = "a ', doc_id, '"', {_N}, '            return {{x}}', {_N},
  CASE WHEN doc_id % 4 = 1 THEN concat('    try:', {_N}, '        import re', {_N}, '    except ValueError:', {_N}, '        raise') ELSE ')) ((' END)"""
WITH_CODE = f"WITH c AS (SELECT doc_id, {CODE} AS code FROM documents), l AS (SELECT *, string_split(code, chr(10)) AS ls FROM c)"
LINES = WITH_CODE + r", u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l)"


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(CODE).alias("code")).withColumn("ls", T.lines(F.col("code")))


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(code, '{pattern}'))::BIGINT"


def _ratio(a: str, b: str, otherwise: str = "0.0") -> str:
    return f"CASE WHEN {b} > 0 THEN round({a} / {b}, 6) ELSE {otherwise} END"


@query(WITH_CODE + rf""", d AS (SELECT doc_id, list_filter(ls, lambda x: regexp_matches(x, '^[ \t].*\S')) AS f FROM l),
k AS (SELECT doc_id, f, len(list_filter(f, lambda x: x[1] = ' ')) AS s, len(list_filter(f, lambda x: x[1] = chr(9))) AS t FROM d)
SELECT doc_id, {_ratio('s', '(s + t)')} AS space_share, {_ratio('t', '(s + t)')} AS tab_share, CASE WHEN s > 0 AND t > 0 OR s + t = 0 THEN 0.0 ELSE 1.0 END AS consistency,
  coalesce(round(list_avg(list_transform(f, lambda x: length(x) - length(regexp_replace(x, '^\s+', '')))), 6), 0.0) AS avg_indent FROM k""")
def indentation(spark, sf_dir):
    df = _code(spark, sf_dir).withColumn("f", F.filter("ls", lambda x: x.rlike(r"^[ \t].*\S")))
    df = df.withColumns({"s": F.size(F.filter("f", lambda x: x.startswith(" "))), "t": F.size(F.filter("f", lambda x: x.startswith("\t")))})
    s, t = F.col("s"), F.col("t")
    total = F.aggregate("f", F.lit(0), lambda acc, x: acc + C.indent(x))
    return df.select("doc_id", C.ratio(s, s + t).alias("space_share"), C.ratio(t, s + t).alias("tab_share"), F.when((s > 0) == (t > 0), 0.0).otherwise(1.0).alias("consistency"), C.ratio(total, s + t).alias("avg_indent"))


@query(WITH_CODE + rf""", k AS (SELECT doc_id, len(ls) AS n, {_n(r'def\s+\w+')} AS functions, {_n(r'class\s+\w+')} AS classes, {_n(r'import\s+|from\s+\w+\s+import')} AS imports FROM l)
SELECT doc_id, functions, classes, imports, {_ratio('functions', 'classes', "'inf'::DOUBLE")} AS function_class_ratio, round(imports / n, 6) AS import_density FROM k""")
def structure(spark, sf_dir):
    code = F.col("code")
    df = _code(spark, sf_dir).withColumns({"functions": C.count(code, r"def\s+\w+"), "classes": C.count(code, r"class\s+\w+"), "imports": C.count(code, r"import\s+|from\s+\w+\s+import")})
    per_class = C.ratio(F.col("functions"), F.col("classes"), float("inf"))
    return df.select("doc_id", "functions", "classes", "imports", per_class.alias("function_class_ratio"), C.ratio(F.col("imports"), F.size("ls")).alias("import_density"))


_FLOW = ("if", "for", "while", "try", "except", "finally", "raise")


@query(WITH_CODE + ", k AS (SELECT doc_id, len(ls) AS n, " + ", ".join(_n(rf"\b{w}\b") + f" AS n_{w}" for w in _FLOW) + f""" FROM l)
SELECT doc_id, {", ".join(f"n_{w}" for w in _FLOW)}, round((n_if + n_for + n_while + n_try) / n, 6) AS flow_density, {_ratio('n_except', 'n_try')} AS error_handling_ratio FROM k""")
def control_flow(spark, sf_dir):
    df = _code(spark, sf_dir).withColumns({f"n_{w}": C.word_count(F.col("code"), w) for w in _FLOW})
    flow = F.col("n_if") + F.col("n_for") + F.col("n_while") + F.col("n_try")
    return df.select("doc_id", *[f"n_{w}" for w in _FLOW], C.ratio(flow, F.size("ls")).alias("flow_density"), C.ratio(F.col("n_except"), F.col("n_try")).alias("error_handling_ratio"))


@query(LINES + r""", k AS (SELECT doc_id, i, line, regexp_matches(line, '^\s*("{3}|''{3})') AS turns FROM u),
p AS (SELECT *, turns OR sum(turns::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS within FROM k)
SELECT doc_id, count(*) FILTER (NOT within AND regexp_matches(line, '^\s*#')) AS comment_lines, count(*) FILTER (within) AS docstring_lines,
  count(*) FILTER (NOT within AND contains(line, '#') AND NOT regexp_matches(line, '^\s*#')) AS inline_comments, round(count(*) FILTER (within) / count(*), 6) AS docstring_ratio FROM p GROUP BY doc_id""")
def comments(spark, sf_dir):
    df = _code(spark, sf_dir).withColumn("k", C.comment_counts(F.col("ls")))
    longs = [F.col(f"k.{a}").cast("long").alias(b) for a, b in (("comment", "comment_lines"), ("doc", "docstring_lines"), ("inline", "inline_comments"))]
    return df.select("doc_id", *longs, C.ratio(F.col("k.doc"), F.size("ls")).alias("docstring_ratio"))


@query(LINES + r""", b AS (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM u WHERE NOT regexp_matches(line, '\S')),
r AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id, g) GROUP BY doc_id)
SELECT doc_id, coalesce(longest, 0)::BIGINT AS longest_blank_run, len(regexp_extract_all(code, '\(\s+|\s+\)'))::BIGINT AS paren_spacing,
  len(regexp_extract_all(code, '\[\s+|\s+\]'))::BIGINT AS bracket_spacing, len(regexp_extract_all(code, '\{\s+|\s+\}'))::BIGINT AS brace_spacing FROM c LEFT JOIN r USING (doc_id)""")
def spacing(spark, sf_dir):
    code = F.col("code")
    pairs = (("paren", r"\(\s+|\s+\)"), ("bracket", r"\[\s+|\s+\]"), ("brace", r"\{\s+|\s+\}"))
    return _code(spark, sf_dir).select("doc_id", T.longest_blank_run(code).cast("long").alias("longest_blank_run"), *[C.count(code, p).alias(f"{k}_spacing") for k, p in pairs])


@query(WITH_CODE + r""", k AS (SELECT doc_id, list_transform(list_filter(ls, lambda x: regexp_matches(x, '\S')), lambda x: length(x) - length(regexp_replace(x, '^\s+', ''))) AS d FROM l)
SELECT doc_id, (list_max(d) // 4)::BIGINT AS max_nesting, round(list_avg(d) / 4, 6) AS avg_nesting, CASE WHEN len(list_filter(d, lambda x: x % 4 <> 0)) = 0 THEN 1.0 ELSE 0.0 END AS consistency FROM k""")
def nesting(spark, sf_dir):
    df = _code(spark, sf_dir).withColumn("d", F.transform(C.filled(F.col("ls")), C.indent))
    total = F.aggregate("d", F.lit(0), lambda acc, x: acc + x)
    even = F.forall("d", lambda x: x % 4 == 0)
    return df.select("doc_id", F.floor(F.array_max("d") / 4).cast("long").alias("max_nesting"), C.ratio(total, F.size("d") * 4).alias("avg_nesting"), F.when(even, 1.0).otherwise(0.0).alias("consistency"))


@query(WITH_CODE + r""", k AS (SELECT doc_id, string_split(regexp_replace(code, '[^(){}\[\]]+', '', 'g'), '') AS b FROM c),
u AS (SELECT doc_id, unnest(b) AS ch, generate_subscripts(b, 1) AS i FROM k),
s AS (SELECT doc_id, i, sum(CASE WHEN ch = '' THEN 0 WHEN ch IN ('(', '{', '[') THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM u),
f AS (SELECT doc_id, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY i)) AS depth FROM s)
SELECT doc_id, greatest(max(depth), 0)::BIGINT AS depth FROM f GROUP BY doc_id""")
def bracket_depth(spark, sf_dir):
    return _code(spark, sf_dir).select("doc_id", C.bracket_depth(F.col("code")).alias("depth"))


_NAME = "[a-zA-Z_][a-zA-Z0-9_]*"


@query(WITH_CODE + rf""", k AS (SELECT doc_id, regexp_extract_all(code, '\b({_NAME})\s*=', 1) AS v, regexp_extract_all(code, 'def\s+({_NAME})', 1) AS f, len(regexp_extract_all(code, 'class\s+[A-Z]')) AS c FROM c),
s AS (SELECT doc_id, len(v) AS nv, len(f) AS nf, c, len(list_filter(v, lambda x: contains(x, '_') AND lower(x) = x AND regexp_matches(x, '[a-z]'))) AS sv,
  len(list_filter(f, lambda x: contains(x, '_') AND lower(x) = x AND regexp_matches(x, '[a-z]'))) AS sf FROM k)
SELECT doc_id, {_ratio('sv', 'nv')} AS snake_variables, {_ratio('sf', 'nf')} AS snake_functions, {_ratio('(sv + sf + c)', '(nv + nf + c)')} AS naming_score FROM s""")
def naming(spark, sf_dir):
    code = F.col("code")
    df = _code(spark, sf_dir).withColumns({"v": F.regexp_extract_all(code, F.lit(rf"\b({_NAME})\s*="), F.lit(1)), "f": F.regexp_extract_all(code, F.lit(rf"def\s+({_NAME})"), F.lit(1)), "c": C.count(code, r"class\s+[A-Z]")})
    nv, nf, sv, sf, c = F.size("v"), F.size("f"), C.snake(F.col("v")), C.snake(F.col("f")), F.col("c")
    return df.select("doc_id", C.ratio(sv, nv).alias("snake_variables"), C.ratio(sf, nf).alias("snake_functions"), C.ratio(sv + sf + c, nv + nf + c).alias("naming_score"))


def _has(*pieces: str) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{p}')" for p in pieces) + ")"


@query(f"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'unknown' WHEN {_has('class ', 'struct ', 'interface ')} THEN 'class_definition' WHEN {_has('def ', 'function ', 'fn ', 'public ')} THEN 'function'
  WHEN {_has('import', '#include')} THEN 'import_statement' WHEN {_has('main', 'entry')} THEN 'main_function' WHEN {_has('#')} AND {_has('def')} THEN 'python_function'
  WHEN {_has('{')} AND {_has('function')} THEN 'javascript_function' ELSE 'other' END AS kind FROM documents""")
def code_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.code_type(F.col("text")).alias("kind"))


@query(WITH_CODE + " SELECT doc_id, len(ls)::BIGINT AS n_lines, length(code)::BIGINT AS n_chars, " + ", ".join(f"((length(code) - length(replace(code, '{m}', ''))) // {len(m)})::BIGINT AS m{i}" for i, m in enumerate(C.MARKS)) + " FROM l")
def struct_embedding(spark, sf_dir):
    code = F.col("code")
    return _code(spark, sf_dir).select("doc_id", F.size("ls").cast("long").alias("n_lines"), F.length(code).cast("long").alias("n_chars"), *[C.occurrences(code, m).alias(f"m{i}") for i, m in enumerate(C.MARKS)])


@query(survey_sql(near=True) + """, d AS (SELECT lang, risk_score AS p FROM scored JOIN documents USING (doc_id)),
by_lang AS (SELECT lang, sum(p) AS s, count(*) AS n, count(*) FILTER (p >= 0.2) AS m, count(*) FILTER (p >= 0.35) AS h FROM d GROUP BY lang)
SELECT sum(n)::BIGINT AS total, round(sum(m) / sum(n), 6) AS machine_share, round(sum(s) / sum(n), 6) AS mean_confidence, sum(h)::BIGINT AS high, round(avg(s / n), 6) AS language_mean FROM by_lang""")
def bi_measures(spark, sf_dir):
    scored = _scored(spark, sf_dir, near_id="doc_id", nearest=False).select("lang", F.col("risk_score").alias("p"))
    by_lang = scored.groupBy("lang").agg(F.sum("p").alias("s"), F.count("*").alias("n"), F.count_if(F.col("p") >= 0.2).alias("m"), F.count_if(F.col("p") >= 0.35).alias("h"))
    return by_lang.agg(F.sum("n").alias("total"), F.round(F.sum("m") / F.sum("n"), 6).alias("machine_share"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean_confidence"), F.sum("h").alias("high"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("language_mean"))
