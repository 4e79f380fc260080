"""Queries of syntax trees, token statistics and canonical features, and their SQL; importing this module adds them to the catalogue.

Trees need programs that parse, so each document becomes one: its text as comments, then functions and classes as often as its
size and id say. What the tree of such a program counts is a formula of the two numbers, which the SQL states.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.functions import languages as L
from lumora.functions import tokens
from lumora.operators import canonical, rules, trees
from lumora.plans.catalog import query, table
from lumora.plans.code_catalog import WITH_CODE, _code
from lumora.plans.language_catalog import WITH_WORDS

_N = "chr(10)"
_FUNCTION = 'def scan_row(x: int, y) -> int:\n    """Returns: x."""\n    if x > 1 and y:\n        return x\n    return y\n'
_CLASS = "class Item:\n    def get(self):\n        try:\n            for i in self.rows:\n                while i:\n                    i = i - 1\n        except ValueError:\n            pass\n        finally:\n            self.rows = []\n"
_A, _B = "CAST(coalesce(n_chars, 0) % 4 AS INT)", "CAST(doc_id % 3 AS INT)"
PROGRAM = f"concat('import os', {_N}, '# ', replace(coalesce(text, ''), {_N}, concat({_N}, '# ')), {_N}, repeat('{_FUNCTION}', {_A}), repeat('{_CLASS}', {_B}))"
#: a functions and b classes with a method each.
WITH_TREE = f"""WITH ab AS (SELECT doc_id, {_A}::BIGINT AS a, {_B}::BIGINT AS b FROM documents),
t AS (SELECT doc_id, a, b, 3 + 26 * a + 34 * b AS nodes, 1 + 2 * a + 3 * b AS cyclomatic, (CASE WHEN b > 0 THEN 5 WHEN a > 0 THEN 2 ELSE 0 END)::BIGINT AS nesting, 3 * a + 2 * b AS control_flow,
  3 * a + a * (a - 1) // 2 + 3 * b + b * (b - 1) + b + b * b + b * (b - 1) // 2 AS cognitive, a + b AS functions, b AS classes, b AS methods, 1::BIGINT AS imports, 2 * b AS stores, 6 * a + 5 * b AS loads,
  (CASE WHEN a > 0 THEN 3 ELSE 0 END + CASE WHEN b > 0 THEN 3 ELSE 0 END)::BIGINT AS variables, b AS tries, b AS handlers, b AS finals, a AS documented, a AS hinted, a AS hinted_arguments,
  CASE WHEN a + b > 0 THEN (3 * a + 4 * b) / (a + b) ELSE 0.0 END AS function_complexity_mean, (CASE WHEN b > 0 THEN 4.0 WHEN a > 0 THEN 3.0 ELSE 0.0 END)::DOUBLE AS function_complexity_max,
  CASE WHEN b > 0 THEN (a + b) / b WHEN a > 0 THEN 'inf'::DOUBLE ELSE 0.0 END AS function_class_ratio, CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0.0 END AS return_hints, CASE WHEN a + b > 0 THEN a / (2 * a + b) ELSE 0.0 END AS argument_hints,
  CASE WHEN b > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS handlers_a_try, CASE WHEN a + b > 0 THEN a / (a + 2 * b) ELSE 0.0 END AS docstring_ratio, CASE WHEN a + b > 0 THEN (a + 3 * b) / (a + 4 * b) ELSE 0.0 END AS naming_score,
  (CASE WHEN b > 0 THEN 0.75 WHEN a > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS organization_score FROM ab)"""
_COUNTS = "nodes cyclomatic nesting control_flow cognitive functions classes methods imports stores loads variables tries handlers finals documented hinted hinted_arguments".split()
_RATES = "function_complexity_mean function_complexity_max function_class_ratio return_hints argument_hints handlers_a_try docstring_ratio naming_score organization_score".split()


def _programs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(PROGRAM).alias("code"))


@query(WITH_TREE + f" SELECT doc_id, true AS parsed, {', '.join(_COUNTS)}, {', '.join(f'round({r}, 6) AS {r}' for r in _RATES)}, 5 * a + 2 * b AS arguments_seen, (b + 1)::BIGINT AS module_and_classes FROM (SELECT *, 0 AS z FROM t)")
def tree_features(spark, sf_dir):
    found = trees.tree_features(_programs(spark, sf_dir), "doc_id", "code")
    kind = lambda *names: sum((F.coalesce(F.element_at("node_types", n), F.lit(0)) for n in names), F.lit(0)).cast("long")
    return found.select("doc_id", "parsed", *_COUNTS, *[F.round(r, 6).alias(r) for r in _RATES], (kind("arg") + kind("Return") + kind("arguments")).alias("arguments_seen"), kind("Module", "ClassDef").alias("module_and_classes"))


@query(WITH_TREE + f""", f AS (SELECT doc_id, organization_score AS code_organization_score, return_hints AS type_hint_ratio, naming_score AS variable_naming_score, handlers_a_try AS exception_handling_ratio, docstring_ratio, cyclomatic AS cyclomatic_complexity, functions AS function_count, classes AS class_count FROM t),
s AS (SELECT doc_id, {rules.tree_score_sql(1)} AS m, {rules.tree_score_sql(2)} AS h FROM f)
SELECT doc_id, round(m, 6) AS machine, round(h, 6) AS human, CASE WHEN m + h = 0 THEN 0.5 ELSE round(greatest(0.5, least(0.95, greatest(m / (m + h), 1 - m / (m + h)))), 6) END AS confidence, CASE WHEN m + h > 0 AND m / (m + h) > 0.5 THEN 1 ELSE 0 END::INT AS prediction FROM s""")
def tree_confidence(spark, sf_dir):
    found = trees.tree_features(_programs(spark, sf_dir), "doc_id", "code")
    named = {"code_organization_score": "organization_score", "type_hint_ratio": "return_hints", "variable_naming_score": "naming_score", "exception_handling_ratio": "handlers_a_try", "docstring_ratio": "docstring_ratio", "cyclomatic_complexity": "cyclomatic", "function_count": "functions", "class_count": "classes"}
    return found.select("doc_id", *[F.col(v).alias(k) for k, v in named.items()]).select("doc_id", *[c.alias(n) for n, c in rules.tree_confidence().items()])


def _string_pattern(language: str) -> str:
    quotes = """["'']""" if language in tokens.BOTH_QUOTES else '"'
    return rf'(?s){quotes}(?:[^"\\]|\\.)*{quotes}'


def _arrays_sql(language: str) -> str:
    patterns = {"keywords": r"\b(?:" + L.KEYWORDS[language].replace(" ", "|") + r")\b", "identifiers": L.NAMES[language], "comments": L.COMMENTS[language], "strings": _string_pattern(language), **L.TOKENS}
    lists = ", ".join(f"regexp_extract_all({'code' if k in ('keywords', 'identifiers', 'numbers') else 'whole'}, '{patterns[k]}') AS {k}" for k in tokens.CLASSES)
    return WITH_WORDS + f", k0 AS (SELECT doc_id, code, whole, string_split(whole, chr(10)) AS ls, {lists} FROM w), k AS (SELECT *, {' || '.join(tokens.CLASSES)} AS every, len(regexp_extract_all(whole, '\\S+')) AS words FROM k0)"


_MEAN = "coalesce(round(list_avg(list_transform({a}, lambda x: length(x))), 6), 0.0)"
_INDENTS = r"list_transform(list_filter(ls, lambda x: regexp_matches(x, '\S')), lambda x: length(x) - length(regexp_replace(x, '^\s+', '')))"
_ONLY = {
    "python": {"avg_indent_level": f"coalesce(round(list_avg({_INDENTS}), 6), 0.0)", "max_indent_level": f"coalesce(list_max({_INDENTS}), 0)::BIGINT", "indent_consistency": f"CASE WHEN len({_INDENTS}) > 0 AND len(list_filter({_INDENTS}, lambda x: x % 4 <> 0)) = 0 THEN 1.0 ELSE 0.0 END",
               "string_count": "len(strings)::BIGINT", "avg_string_length": _MEAN.format(a="strings"), "comment_count": "len(comments)::BIGINT", "comment_ratio": "CASE WHEN len(identifiers) > 0 THEN round(len(comments) / len(identifiers), 6) ELSE 0.0 END"},
    "java": {"brace_count": "len(list_filter(delimiters, lambda x: x IN ('{', '}')))::BIGINT", "brace_balance": "CASE WHEN len(list_filter(delimiters, lambda x: x = '{')) = len(list_filter(delimiters, lambda x: x = '}')) THEN 1.0 ELSE 0.0 END",
             "semicolon_count": "len(list_filter(delimiters, lambda x: x = ';'))::BIGINT", "access_modifier_count": "len(list_filter(keywords, lambda x: x IN ('public', 'private', 'protected')))::BIGINT"},
    "javascript": {"arrow_function_count": "len(regexp_extract_all(whole, '=>'))::BIGINT", "template_literal_count": "len(regexp_extract_all(whole, '`[^`]*`'))::BIGINT", "destructuring_count": r"len(regexp_extract_all(whole, '\{[^}]*\}'))::BIGINT"},
}


def _metrics_sql(language: str) -> str:
    is_function = "(starts_with(x, 'def_') OR ends_with(x, '_func'))"
    among = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
    sizes = {
        "control_flow": f"len(list_filter(keywords, lambda x: x IN {among(L.CONTROL)}))", "data_types": f"len(list_filter(identifiers, lambda x: NOT {is_function} AND upper(x) = x AND lower(x) <> x))",
        "functions": f"(len(list_filter(keywords, lambda x: x IN {among(L.DEFINING)})) + len(list_filter(identifiers, lambda x: {is_function})))", "variables": f"len(list_filter(identifiers, lambda x: NOT {is_function} AND NOT (upper(x) = x AND lower(x) <> x)))",
        "operators": "len(operators)", "literals": "(len(strings) + len(numbers))", "comments": "len(comments)", "whitespace": "len(whitespace)",
    }
    parts = {"total_lines": "len(ls)::BIGINT", "non_empty_lines": r"len(list_filter(ls, lambda x: regexp_matches(x, '\S')))::BIGINT", "total_characters": "length(whole)::BIGINT", "total_words": "words::BIGINT"}
    for k in tokens.CLASSES:
        parts |= {f"{k}_count": f"len({k})::BIGINT", f"{k}_unique_count": f"len(list_distinct({k}))::BIGINT"}
    lengths = "list_transform(every, lambda x: length(x))"
    parts |= {"total_tokens": "len(every)::BIGINT", "unique_tokens": "len(list_distinct(every))::BIGINT", "token_diversity": "round(len(list_distinct(every)) / len(every), 6)", "avg_token_length": _MEAN.format(a="every"),
              "max_token_length": f"list_max({lengths})::BIGINT", "min_token_length": f"list_min({lengths})::BIGINT", "token_length_std": f"round(list_stddev_pop({lengths}), 6)"}
    parts |= _ONLY.get(language, {})
    parts |= {f"{g}_count": f"{sizes[g]}::BIGINT" for g in tokens.GROUPS} | {f"{g}_ratio": f"CASE WHEN words > 0 THEN round({sizes[g]} / words, 6) ELSE 0.0 END" for g in tokens.GROUPS}
    parts["cyclomatic_complexity"] = f"(1 + len(regexp_extract_all(code, '{tokens.DECISIONS[language]}')))::BIGINT" if language in tokens.DECISIONS else "1::BIGINT"
    return _arrays_sql(language) + " SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in parts.items()) + " FROM k"


def _metrics(spark, sf_dir, language):
    df = tokens.with_classes(_code(spark, sf_dir), "code", F.lit(language))
    found = tokens.metrics(F.col("tk"))
    found.pop("nesting_depth")  # bracket_depth has its own query
    other = {n for k, names in tokens.EXTRAS.items() if k != language for n in names}
    whole = lambda n: n.endswith("_count") or n.startswith(("total_", "unique_", "non_")) or n in ("max_token_length", "min_token_length", "max_indent_level", "cyclomatic_complexity")
    return df.select("doc_id", *[(c if whole(n) else F.round(c, 6)).alias(n) for n, c in found.items() if n not in other or n in tokens.EXTRAS.get(language, ())])


@query(_metrics_sql("python"))
def token_metrics_py(spark, sf_dir):
    return _metrics(spark, sf_dir, "python")


@query(_metrics_sql("java"))
def token_metrics_java(spark, sf_dir):
    return _metrics(spark, sf_dir, "java")


@query(_metrics_sql("javascript"))
def token_metrics_js(spark, sf_dir):
    return _metrics(spark, sf_dir, "javascript")


@query(_metrics_sql("cpp"))
def token_metrics_cpp(spark, sf_dir):
    return _metrics(spark, sf_dir, "cpp")


@query(_metrics_sql("csharp"))
def token_metrics_cs(spark, sf_dir):
    return _metrics(spark, sf_dir, "csharp")


#: Programs of even ids parse; those of odd ids, set into broken lines, don't.
_MIXED = f"CASE WHEN doc_id % 2 = 0 THEN {PROGRAM} ELSE concat({PROGRAM}, {_N}, 'def (') END"


def _mixed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_MIXED).alias("code"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 'java' ELSE 'python' END").alias("language"))


@query()
def canonical_features(spark, sf_dir):
    return canonical.flatten(_mixed(spark, sf_dir), "doc_id", "code", F.col("language"))


_COLLIDING = ("function_count", "class_count", "import_count", "try_blocks", "except_blocks", "finally_blocks", "max_nesting_depth", "cyclomatic_complexity", "function_class_ratio")


@query(WITH_TREE + rf""", m AS (SELECT doc_id, {_MIXED} AS code, CASE WHEN doc_id % 5 = 0 THEN 'java' ELSE 'python' END AS language FROM documents),
s AS (SELECT *, len(regexp_extract_all(code, 'def\s+\w+'))::DOUBLE AS f, len(regexp_extract_all(code, 'class\s+\w+'))::DOUBLE AS c, len(regexp_extract_all(code, 'import\s+|from\s+\w+\s+import'))::DOUBLE AS i,
  len(regexp_extract_all(x, '\btry\b'))::DOUBLE AS y, len(regexp_extract_all(x, '\bexcept\b'))::DOUBLE AS e, len(regexp_extract_all(x, '\bfinally\b'))::DOUBLE AS z,
  floor(list_max(list_transform(list_filter(string_split(code, chr(10)), lambda l: regexp_matches(l, '\S')), lambda l: length(l) - length(regexp_replace(l, '^\s+', '')))) / 4)::DOUBLE AS n,
  1 + len(regexp_extract_all(x, CASE language WHEN 'python' THEN '{tokens.DECISIONS["python"]}' ELSE '{tokens.DECISIONS["java"]}' END))::DOUBLE AS d
  FROM (SELECT *, regexp_replace(code, '[\p{{L}}\p{{M}}\p{{N}}_]*[^\P{{L}}\x00-\x7f][\p{{L}}\p{{M}}\p{{N}}_]*', 'é', 'g') AS x FROM m)),
q AS (SELECT *, doc_id % 2 = 0 AND language = 'python' AS has FROM s JOIN t USING (doc_id))
SELECT doc_id, f AS serve_function_count, CASE WHEN has THEN functions ELSE 0 END::DOUBLE AS ingest_function_count, c AS serve_class_count, CASE WHEN has THEN classes ELSE 0 END::DOUBLE AS ingest_class_count,
  i AS serve_import_count, CASE WHEN has THEN imports ELSE 0 END::DOUBLE AS ingest_import_count, y AS serve_try_blocks, CASE WHEN has THEN tries ELSE y END::DOUBLE AS ingest_try_blocks,
  e AS serve_except_blocks, CASE WHEN has THEN handlers ELSE e END::DOUBLE AS ingest_except_blocks, z AS serve_finally_blocks, CASE WHEN has THEN finals ELSE z END::DOUBLE AS ingest_finally_blocks,
  n AS serve_max_nesting_depth, CASE WHEN has THEN nesting ELSE 0 END::DOUBLE AS ingest_max_nesting_depth, d AS serve_cyclomatic_complexity, d AS ingest_cyclomatic_complexity,
  CASE WHEN c > 0 THEN round(f / c, 6) ELSE 'inf'::DOUBLE END AS serve_function_class_ratio, round(CASE WHEN has THEN function_class_ratio WHEN c > 0 THEN f / c ELSE 'inf'::DOUBLE END, 6) AS ingest_function_class_ratio FROM q""")
def canonical_collisions(spark, sf_dir):
    """What a shared name holds in either order of the extractors."""
    found = canonical.registry()
    rows = canonical.extracted(_mixed(spark, sf_dir), "doc_id", "code", F.col("language"))
    value = lambda n, order: F.round(canonical.resolve(found, n, order), 6) if "ratio" in n else canonical.resolve(found, n, order)
    return rows.select("doc_id", *[value(n, o).alias(f"{o}_{n}") for n in _COLLIDING for o in canonical.ORDERS])
