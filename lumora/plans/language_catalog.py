"""Queries of language scores, tokens and machine-style signals, and their SQL; importing this module adds them to the catalogue."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions import code as C
from lumora.functions import languages as L
from lumora.plans.catalog import query, table
from lumora.plans.code_catalog import WITH_CODE, _code

_LETTER = r"[\p{L}\p{M}\p{N}_]"
#: SQL's boundaries know ASCII alone, so words with other letters give way to one such letter.
WITH_WORDS = WITH_CODE + rf", w AS (SELECT doc_id, code AS whole, regexp_replace(code, '{_LETTER}*[^\P{{L}}\x00-\x7f]{_LETTER}*', 'é', 'g') AS code FROM c)"


def _score(language: str) -> str:
    keys = L.WORDS[language].split()
    found = " + ".join(rf"regexp_matches(code, '(?i)\b{k}\b')::INT" for k in keys)
    forms = " + ".join(f"regexp_matches(whole, '{p}')::INT" for p in L.IMPORTS[language])
    shape = f"len(regexp_extract_all(whole, '(?i){L.SHAPES[language]}'))"
    return f"round(({found})::DOUBLE / {len(keys)} * 0.5::DOUBLE + least({shape} / 10.0::DOUBLE, 1) * 0.3::DOUBLE + least(({forms}) / 5.0::DOUBLE, 1) * 0.2::DOUBLE, 9) AS {language}"


_SCORES = WITH_WORDS + ", s AS (SELECT doc_id, code, " + ", ".join(map(_score, L.WORDS)) + " FROM w)"
_TOP = "greatest(" + ", ".join(L.WORDS) + ")"
_BEST = "CASE " + " ".join(f"WHEN {n} = {_TOP} THEN '{n}'" for n in L.WORDS) + " END"


def _scored(spark, sf_dir):
    df = _code(spark, sf_dir).withColumn("words", L.distinct_words(F.col("code")))
    return df.select("doc_id", "code", *[c.alias(n) for n, c in L.scores(F.col("code"), F.col("words")).items()])


@query(_SCORES + " SELECT doc_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in L.WORDS) + " FROM s")
def language_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", *[F.round(n, 6).alias(n) for n in L.WORDS])


@query(_SCORES + f" SELECT doc_id, CASE WHEN {_TOP} < 0.2 THEN 'unknown' ELSE {_BEST} END AS language, CASE WHEN {_TOP} < 0.2 THEN 0.0 ELSE round({_TOP}, 6) END AS confidence FROM s")
def language_detect(spark, sf_dir):
    top = L.best({n: F.col(n) for n in L.WORDS})
    df = _scored(spark, sf_dir).select("doc_id", top.alias("top"))
    known = F.col("top.confidence") >= 0.2
    return df.select("doc_id", F.when(known, F.col("top.language")).otherwise("unknown").alias("language"), F.when(known, F.round("top.confidence", 6)).otherwise(F.lit(0.0)).alias("confidence"))


@query(_SCORES + f", k AS (SELECT doc_id, ['python', 'java', 'rust'][doc_id % 3 + 1] AS chosen, {_TOP} AS top, {_BEST} AS best FROM s) SELECT doc_id, CASE WHEN top > 0.1 AND best = chosen THEN 'valid' WHEN top > 0.1 THEN 'mismatch' ELSE 'unclear' END AS verdict FROM k")
def language_validate(spark, sf_dir):
    df = _scored(spark, sf_dir).select("doc_id", "code", L.best({n: F.col(n) for n in L.WORDS}).alias("top"))
    chosen = F.element_at(F.array(F.lit("py"), F.lit("Java"), F.lit("rust")), (F.col("doc_id") % 3 + 1).cast("int"))
    return df.select("doc_id", L.validate(F.col("code"), chosen, F.col("top")).alias("verdict"))


_CLASSES = ("keywords", "identifiers", "operators", "delimiters", "numbers", "comments", "whitespace")


def _token_sql(language: str) -> str:
    patterns = {"keywords": r"\b(?:" + L.KEYWORDS[language].replace(" ", "|") + r")\b", "identifiers": L.NAMES[language], "comments": L.COMMENTS[language], **L.TOKENS}
    lists = ", ".join(f"regexp_extract_all({'code' if k in ('keywords', 'identifiers', 'numbers') else 'whole'}, '{patterns[k]}') AS {k}" for k in _CLASSES)
    counts = ", ".join(f"len({k})::BIGINT AS {k}, len(list_distinct({k}))::BIGINT AS unique_{k}" for k in _CLASSES)
    every = " || ".join(_CLASSES)
    return WITH_WORDS + f", t AS (SELECT doc_id, {lists} FROM w) SELECT doc_id, {counts}, round(len(list_distinct({every})) / len({every}), 6) AS token_diversity, round(list_avg(list_transform({every}, lambda x: length(x))), 6) AS avg_token_length, list_max(list_transform({every}, lambda x: length(x)))::BIGINT AS max_token_length FROM t"


def _token_counts(spark, sf_dir, language):
    df = _code(spark, sf_dir).select("doc_id", *[L.tokens(F.col("code"), k, language).alias(k) for k in _CLASSES])
    df = df.withColumn("every", F.concat(*_CLASSES))
    n = F.size("every")
    letters = F.aggregate("every", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    counts = [c for k in _CLASSES for c in (F.size(k).cast("long").alias(k), F.size(F.array_distinct(k)).cast("long").alias(f"unique_{k}"))]
    longest = F.array_max(F.transform("every", F.length)).cast("long")
    return df.select("doc_id", *counts, C.ratio(F.size(F.array_distinct("every")), n).alias("token_diversity"), C.ratio(letters, n).alias("avg_token_length"), longest.alias("max_token_length"))


@query(_token_sql("python"))
def token_counts_py(spark, sf_dir):
    return _token_counts(spark, sf_dir, "python")


@query(_token_sql("java"))
def token_counts_java(spark, sf_dir):
    return _token_counts(spark, sf_dir, "java")


@query(_token_sql("javascript"))
def token_counts_js(spark, sf_dir):
    return _token_counts(spark, sf_dir, "javascript")


@query(_token_sql("cpp"))
def token_counts_cpp(spark, sf_dir):
    return _token_counts(spark, sf_dir, "cpp")


@query(_token_sql("csharp"))
def token_counts_cs(spark, sf_dir):
    return _token_counts(spark, sf_dir, "csharp")


def _among(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(WITH_WORDS + rf""", t AS (SELECT doc_id, regexp_extract_all(code, '\b(?:{L.KEYWORDS["python"].replace(" ", "|")})\b') AS k, regexp_extract_all(code, '{L.NAMES["python"]}') AS n FROM w),
g AS (SELECT doc_id, k, list_filter(n, lambda x: starts_with(x, 'def_') OR ends_with(x, '_func')) AS f, list_filter(n, lambda x: NOT (starts_with(x, 'def_') OR ends_with(x, '_func'))) AS v FROM t)
SELECT doc_id, len(list_filter(k, lambda x: x IN {_among(L.CONTROL)}))::BIGINT AS control_flow, (len(list_filter(k, lambda x: x IN {_among(L.DEFINING)})) + len(f))::BIGINT AS functions,
  len(list_filter(v, lambda x: upper(x) = x AND lower(x) <> x))::BIGINT AS data_types, len(list_filter(v, lambda x: NOT (upper(x) = x AND lower(x) <> x)))::BIGINT AS variables FROM g""")
def token_semantic(spark, sf_dir):
    df = _code(spark, sf_dir).select("doc_id", L.tokens(F.col("code"), "keywords", "python").alias("k"), L.tokens(F.col("code"), "identifiers", "python").alias("n"))
    return df.select("doc_id", *[c.alias(n) for n, c in L.semantic(F.col("k"), F.col("n")).items()])


def counted(values: DataFrame, name: str, size: int, piece: int = 16 << 20, rows: int = 1 << 20) -> DataFrame:
    """(name, n) of each distinct value of a string column that is made from about `size` bytes, for values that are nearly as many as the rows.

    A plain aggregate holds all values of an input split in a task, and then all of a shuffle partition. Here counts are combined
    within `rows` rows, and each partition holds what `piece` bytes give, so no task holds more on larger input.
    """

    def total(held: list[pa.RecordBatch]):
        sums = pa.Table.from_batches(held).group_by(name, use_threads=False).aggregate([([], "count_all")])
        return sums.select([name, "count_all"]).rename_columns([name, "n"]).combine_chunks().to_batches(1 << 16)

    def combine(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from total(held)
                held, n = [], 0
        if n:
            yield from total(held)

    parts = values.select(name).mapInArrow(combine, f"`{name}` string, n long").repartition(1 + size // piece, name)
    return parts.groupBy(name).agg(F.sum("n").alias("n"))


@query(WITH_WORDS + rf""", t AS (SELECT regexp_extract_all(code, '{L.NAMES["python"]}') AS n FROM w),
g AS (SELECT unnest(list_transform(generate_series(1, len(n) - 1), lambda i: n[i] || ' ' || n[i + 1])) AS gram FROM t WHERE len(n) > 1) SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def token_ngrams(spark, sf_dir):
    df = _code(spark, sf_dir).select(L.tokens(F.col("code"), "identifiers", "python").alias("n")).where("size(n) > 1")
    pairs = F.zip_with(F.slice("n", 1, F.size("n") - 1), F.slice("n", 2, F.size("n")), lambda a, b: F.concat(a, F.lit(" "), b))
    size = table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).head()[0]
    return counted(df.select(F.explode(pairs).alias("gram")), "gram", size or 0)


@query(rf"""WITH t AS (SELECT b.item_id, list_distinct(regexp_extract_all(lower(b.text), '{_LETTER}+')) AS a, list_distinct(regexp_extract_all(lower(d.text), '{_LETTER}+')) AS w FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
SELECT item_id, round(len(list_intersect(a, w)) / (len(a) + len(w) - len(list_intersect(a, w))), 6) AS jaccard FROM t WHERE len(a) + len(w) > 0""")
def token_jaccard(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", L.distinct_words(F.col("text")).alias("a"))
    d = table(spark, sf_dir, "documents").select("doc_id", L.distinct_words(F.col("text")).alias("w"))
    both = F.size(F.array_intersect("a", "w"))
    df = b.join(d, F.col("item_id") == F.col("doc_id")).where("size(a) + size(w) > 0")
    return df.select("item_id", F.round(both / (F.size("a") + F.size("w") - both), 6).alias("jaccard"))


def _shares(df, values, name):
    """(doc_id, name, share) of exploded values; counts are combined before the one shuffle."""
    counts = df.select("doc_id", F.explode(values).alias(name)).groupBy("doc_id", name).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("doc_id")), 12))


@query(WITH_CODE + rf""", t AS (SELECT doc_id, unnest(regexp_extract_all(code, '{_LETTER}+')) AS token FROM c)
SELECT doc_id, token, round(count(*) / sum(count(*)) OVER (PARTITION BY doc_id), 12) AS share FROM t WHERE token IN {_among(L.VECTOR.split())} GROUP BY doc_id, token""")
def token_embedding(spark, sf_dir):
    return _shares(_code(spark, sf_dir), L.vector_tokens(F.col("code")), "token").select("doc_id", "token", "share")


@query("""WITH u AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text IS NOT NULL AND text <> ''), k AS (SELECT doc_id, unicode(ch) AS code, count(*) AS n FROM u WHERE unicode(ch) < 256 GROUP BY ALL)
SELECT doc_id, code::BIGINT AS code, round(n / sum(n) OVER (PARTITION BY doc_id), 12) AS share FROM k""")
def char_embedding(spark, sf_dir):
    df = _shares(table(spark, sf_dir, "documents"), L.latin_chars(F.col("text")), "ch")
    return df.select("doc_id", F.ascii("ch").cast("long").alias("code"), "share")


_V = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*="
_over = "({})::DOUBLE / greatest({}, 1)"


def _len(pattern: str) -> str:
    return f"len(regexp_extract_all(code, '{pattern}'))"


_Q = "''"
_SIGNALS = {
    "verbose_variables": _over.format(_len(r"\b[a-z_]+_[a-z_]+_[a-z_]+\b"), "len(v)"),
    "type_hints": _over.format(_len(r":\s*(?:int|str|float|bool|List|Dict|Optional|Any|Union|Tuple)\s*[=)]"), _len(r"\bdef\s+\w+")),
    "docstrings": _over.format(_len(r'(?s)""".*?"""') + " + " + _len(f"(?s){_Q * 3}.*?{_Q * 3}"), _len(r"\bdef\s+\w+") + " + " + _len(r"\bfunction\s+\w+")),
    "formal_comments": _over.format("len(list_filter(f, lambda x: regexp_matches(lower(x), '" + "|".join(L.FORMAL) + "')))", "len(f)"),
    "name_length": "CASE WHEN len(v) > 0 THEN list_avg(list_transform(v, lambda x: length(x))) ELSE 0 END",
    "long_names": _over.format("len(list_filter(v, lambda x: length(x) > 12))", "len(v)"),
    "line_length_cv": "CASE WHEN len(z) > 0 THEN list_stddev_pop(z) / greatest(list_avg(z), 1) ELSE 0 END",
    "imports_on_top": "CASE WHEN len(h) > 0 AND list_max(h) < len(ls) * 0.1 THEN 1.0 ELSE 0.0 END",
}


@query(WITH_CODE + rf""", t AS (SELECT doc_id, code, ls, regexp_extract_all(code, '{_V}', 1) AS v, list_filter(ls, lambda x: regexp_matches(x, '^\s*#')) AS f,
  list_transform(list_filter(ls, lambda x: regexp_matches(x, '\S')), lambda x: length(x)) AS z, list_filter(list_transform(ls, lambda x, i: CASE WHEN regexp_matches(x, '^\s*(?:import|from) ') THEN i - 1 ELSE -1 END), lambda x: x >= 0) AS h FROM l)
SELECT doc_id, """ + ", ".join(f"round({e}, 6) AS {n}" for n, e in _SIGNALS.items()) + " FROM t")
def machine_signals(spark, sf_dir):
    df = _code(spark, sf_dir)
    return df.select("doc_id", *[F.round(c, 6).alias(n) for n, c in L.machine_signals(F.col("code"), F.col("ls")).items()])


_FLAGS = {
    "list_comprehension": (r"\[", "for", "in", r"\]"),
    "generator_expression": (r"\(", "for", "in", r"\)"),
    "lambda_function": (r"lambda\s+\w", ":"),
    "ternary_operator": (r"\sif\s", r"\selse\s"),
    "f_string": ("f[\"'']", "[\"'']"),
    "docstring": ("[\"'']{3}", "[\"'']{3}"),
}
_COUNTS = {"type_hint": r":\s*\w+", "assert_statement": r"assert\s+", "with_statement": r"with\s+", "try_except": r"try\s*:"}


@query(WITH_CODE + " SELECT doc_id, " + ", ".join(f"regexp_matches(code, '(?s){'.*'.join(a)}')::BIGINT AS {n}" for n, a in _FLAGS.items()) + ", " + ", ".join(f"{_len(p)}::BIGINT AS {n}" for n, p in _COUNTS.items()) + " FROM c")
def pattern_flags(spark, sf_dir):
    code = F.col("code")
    flags = [C.in_order(code, [x.replace("''", "'") for x in a]).cast("long").alias(n) for n, a in _FLAGS.items()]
    return _code(spark, sf_dir).select("doc_id", *flags, *[C.count(code, p).alias(n) for n, p in _COUNTS.items()])


_WORDS, _SENTENCES, _SYLLABLES = r"[A-Za-z]+", r"[.!?]+", r"[aeiouyAEIOUY]+"


@query(rf"""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '{_WORDS}')) AS w, greatest(len(regexp_extract_all(text, '{_SENTENCES}')), 1) AS s, len(regexp_extract_all(text, '{_SYLLABLES}')) AS y FROM documents)
SELECT doc_id, CASE WHEN w > 0 THEN round(206.835::DOUBLE - 1.015::DOUBLE * w / s - 84.6::DOUBLE * y / w, 6) ELSE 0.0 END AS reading_ease, CASE WHEN w > 0 THEN round(0.39::DOUBLE * w / s + 11.8::DOUBLE * y / w - 15.59::DOUBLE, 6) ELSE 0.0 END AS grade FROM t""")
def readability(spark, sf_dir):
    n = lambda p: F.regexp_count("text", F.lit(p))
    df = table(spark, sf_dir, "documents").select("doc_id", n(_WORDS).alias("w"), F.greatest(n(_SENTENCES), F.lit(1)).alias("s"), n(_SYLLABLES).alias("y"))
    ease, grade = C.readability(F.col("w"), F.col("s"), F.col("y"))
    return df.select("doc_id", F.round(ease, 6).alias("reading_ease"), F.round(grade, 6).alias("grade"))
