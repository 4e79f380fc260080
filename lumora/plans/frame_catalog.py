"""Queries of projections, cleaning, order, set operations, vectors, style, exports and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.functions import style as S
from lumora.functions.languages import KEYWORDS
from lumora.operators import bi, ensemble, frames, metrics, rules, sampling, store, vectors
from lumora.plans.catalog import AS_OF, LOW, _scored, _JUDGED, _judged, query, survey_sql, table
from lumora.plans.code_catalog import WITH_CODE, _code
from lumora.plans.language_catalog import WITH_WORDS

_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT doc_id, lang, n_chars FROM documents")
def column_subset(spark, sf_dir):
    return frames.subset(table(spark, sf_dir, "documents"), ["doc_id", "lang", "text", "n_chars", "absent"], leave=["text"])


@query(f"SELECT {', '.join(_NUMERIC)} FROM lineitem")
def numeric_projection(spark, sf_dir):
    return frames.numeric_only(table(spark, sf_dir, "lineitem"))


@query("SELECT doc_id, quality::DOUBLE AS quality, 0.0::DOUBLE AS absent, coalesce(toxic, 0)::DOUBLE AS toxic FROM labels")
def reindex_fill(spark, sf_dir):
    return frames.reindex(table(spark, sf_dir, "labels"), ["quality", "absent", "toxic"], key=["doc_id"])


@query("""WITH v AS (SELECT vec_id, embedding[:10]::DOUBLE[] AS cut, (embedding::DOUBLE[] || list_transform(range(6), lambda x: 0.0::DOUBLE)) AS padded FROM embeddings)
SELECT vec_id, len(cut)::BIGINT AS n_cut, len(padded)::BIGINT AS n_padded, round(list_sum(cut), 5) AS sum_cut, round(list_sum(padded), 4) AS sum_padded, padded[70] AS last FROM v""")
def width_align(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    df = table(spark, sf_dir, "embeddings").select("vec_id", frames.width_align(v, 10).alias("cut"), frames.width_align(v, 70).alias("padded"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return df.select("vec_id", F.size("cut").cast("long").alias("n_cut"), F.size("padded").cast("long").alias("n_padded"), F.round(total("cut"), 5).alias("sum_cut"), F.round(total("padded"), 4).alias("sum_padded"), F.element_at("padded", 70).alias("last"))


@query("SELECT o_orderkey, TRY_CAST(string_split(o_orderpriority, '-')[1] AS DOUBLE) AS level, TRY_CAST(o_orderpriority AS DOUBLE) AS text FROM orders")
def numeric_coerce(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", frames.to_number(F.split("o_orderpriority", "-")[0]).alias("level"), frames.to_number(F.col("o_orderpriority")).alias("text"))


_DIRTY = "CASE event_id % 5 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN NULL ELSE value END"


@query(f"SELECT event_id, CASE WHEN isnan(v) OR isinf(v) OR v IS NULL THEN 0.0 ELSE v END AS value FROM (SELECT event_id, {_DIRTY} AS v FROM events)")
def clean_numbers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", frames.finite(F.expr(_DIRTY)).alias("value"))


_WIDE = "CASE o_orderkey % 7 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('-Infinity' AS DOUBLE) ELSE (o_totalprice - 250000) * 10 END"


@query(f"SELECT o_orderkey, CASE WHEN isnan(v) THEN 0.0 ELSE greatest(least(v, 1e6::DOUBLE), -1e6::DOUBLE) END AS value FROM (SELECT o_orderkey, {_WIDE} AS v FROM orders)")
def clip_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", frames.clip(F.expr(_WIDE)).alias("value"))


_PATH = "concat('/data/', CASE WHEN doc_id % 3 = 0 THEN 'ai' ELSE 'people' END, '/', doc_id, '.txt')"


@query(f"SELECT d.doc_id, coalesce(quality, CASE WHEN contains({_PATH.replace('doc_id', 'd.doc_id')}, '/ai/') THEN 1 ELSE 0 END)::INT AS label FROM documents d LEFT JOIN labels USING (doc_id)")
def label_repair(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return df.select("doc_id", frames.repaired_label(F.col("quality"), F.expr(_PATH)).alias("label"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'AI Generated' ELSE 'Human Written' END AS prediction, round(quality * 12.345, 1) AS percent, coalesce(quality IN (1, 2), false) AS member FROM labels")
def recode_labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", frames.recode(F.col("toxic")).alias("prediction"), frames.percent(F.col("quality") * 0.12345).alias("percent"), F.coalesce(F.col("quality").isin(1, 2), F.lit(False)).alias("member"))


@query("SELECT event_id, event_type, value FROM events ORDER BY event_type, value DESC, event_id LIMIT 50")
def mixed_sort(spark, sf_dir):
    df = frames.ordered(table(spark, sf_dir, "events"), ("event_type", False), ("value", True), tie="event_id", most=50)
    return df.select("event_id", "event_type", "value")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 20")
def latest_first(spark, sf_dir):
    return frames.ordered(table(spark, sf_dir, "events"), ("ts", True), tie="event_id", most=20).select("event_id", "user_id")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 5")
def head_rows(spark, sf_dir):
    return frames.ordered(table(spark, sf_dir, "documents").select("doc_id", "lang"), tie="doc_id", most=5)


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id LIMIT 100")
def sample_rows(spark, sf_dir):
    return sampling.sample_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT doc_id::VARCHAR AS doc_id, text, lang, NULL::VARCHAR AS item_id FROM documents UNION ALL SELECT NULL, text, NULL, item_id::VARCHAR FROM benchmark")
def union_by_name(spark, sf_dir):
    both = frames.union_by_name(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "benchmark"))
    return both.withColumns({c: F.col(c).cast("string") for c in ("doc_id", "item_id")})


@query("SELECT 'l_quantity' AS feature, round(avg(abs(l_quantity - 25)), 6) AS mean_abs FROM lineitem UNION ALL SELECT 'l_tax', round(avg(abs(l_tax)), 6) FROM lineitem")
def mean_abs(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 25).alias("l_quantity"), "l_tax")
    return frames.mean_abs(df, ["l_quantity", "l_tax"]).select("feature", F.round("mean_abs", 6).alias("mean_abs"))


_CV = "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce({0}(value), 0.0), 6) AS spread, CASE WHEN avg(value) > 0 THEN round(coalesce({0}(value), 0.0) / avg(value), 6) ELSE 0.0 END AS cv FROM events GROUP BY event_type"


@query(_CV.format("stddev_pop"))
def strategy_variation(spark, sf_dir):
    return frames.variation(table(spark, sf_dir, "events"), "value", "event_type")


@query(_CV.format("stddev_samp"))
def fold_variation(spark, sf_dir):
    return frames.variation(table(spark, sf_dir, "events"), "value", "event_type", sample=True)


@query("SELECT event_type, round(avg(value), 6) AS mean FROM events WHERE user_id % 2 = 0 GROUP BY event_type")
def filtered_mean(spark, sf_dir):
    return table(spark, sf_dir, "events").where("user_id % 2 = 0").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT doc_id, lang, CASE WHEN lang IS NOT NULL THEN dense_rank() OVER (ORDER BY lang) - 1 END AS lang_code FROM documents")
def label_encode(spark, sf_dir):
    return frames.label_codes(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")


@query("SELECT doc_id, lang FROM documents")
def label_decode(spark, sf_dir):
    coded = frames.label_codes(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")
    return frames.label_values(coded.select("doc_id", "lang_code"), "lang_code", coded.select("lang", "lang_code"), "lang").select("doc_id", "lang")


_RANK = "row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n"


@query(f"""SELECT doc_id, CASE WHEN k <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, {_RANK} FROM labels)""")
def three_way_split(spark, sf_dir):
    return sampling.stratified_split(table(spark, sf_dir, "labels"), "doc_id", "quality", train=0.6, validation=0.2).select("doc_id", "split")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) <= floor(count(*) OVER () * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM labels")
def holdout_split(spark, sf_dir):
    return sampling.holdout(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "split")


@query("SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k FROM labels) WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))")
def undersample_head(spark, sf_dir):
    return sampling.undersample(table(spark, sf_dir, "labels"), "doc_id", "quality", head=True).select("doc_id", "quality")


@query(f"""WITH r AS (SELECT doc_id, quality, {_RANK} FROM labels), s AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
d AS (SELECT quality, n, unnest(range(1, (SELECT max(n) FROM s) - n + 1)) AS draw FROM s),
t AS (SELECT quality, draw, ('0x' || substr(md5('42:' || quality || ':' || draw), 1, 15))::BIGINT % n + 1 AS k FROM d)
SELECT doc_id, quality, 0::BIGINT AS draw FROM labels UNION ALL SELECT doc_id, quality, draw FROM t JOIN r USING (quality, k)""")
def oversample_bootstrap(spark, sf_dir):
    return sampling.bootstrap(table(spark, sf_dir, "labels"), "doc_id", "quality").select("doc_id", "quality", "draw")


_DOT = "list_sum([x::DOUBLE * y::DOUBLE FOR x, y IN list_zip(a.embedding, b.embedding)])"
_COSINES = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id)"""


@query(_COSINES + " SELECT a, b, round(s, 6) AS similarity FROM s WHERE a < b AND s >= 0.8 - 1e-12")
def cosine_pairs(spark, sf_dir):
    return vectors.cosine_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(_COSINES + " SELECT a AS id, arg_max(b, (round(s, 9), -b)) AS other, round(max(s), 6) AS similarity FROM s GROUP BY a")
def nearest_embedding(spark, sf_dir):
    return vectors.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("id", "other", F.round("similarity", 6).alias("similarity"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x09-\x0D\x1c-\x20\x{85}\p{Z}]') AS w FROM documents)
SELECT doc_id, len(list_distinct(w))::BIGINT AS unique_tokens, CASE WHEN len(w) > 0 THEN round(len(list_distinct(w)) / len(w), 6) ELSE 0.0 END AS token_diversity, coalesce(round(list_avg(list_transform(w, lambda x: length(x))), 6), 0.0) AS avg_token_length,
  coalesce(round(list_stddev_pop(map_values(list_histogram(w))), 6), 0.0) AS token_frequency_std FROM t""")
def lexical(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", S.lexical(F.col("text")).alias("s"))
    return df.select("doc_id", "s.unique_tokens", *[F.round(f"s.{c}", 6).alias(c) for c in ("token_diversity", "avg_token_length", "token_frequency_std")])


_KEYS = ", ".join(f"'{k}'" for k in KEYWORDS["python"].split())


@query(WITH_CODE + rf""", t AS (SELECT doc_id, regexp_extract_all(code, '[\p{{L}}\p{{N}}_]+') AS w FROM l), k AS (SELECT *, list_filter(w, lambda x: x IN ({_KEYS})) AS k FROM t)
SELECT doc_id, len(k)::BIGINT AS keyword_count, len(list_distinct(k))::BIGINT AS unique_keywords, CASE WHEN len(w) > 0 THEN round(len(k) / len(w), 6) ELSE 0.0 END AS keyword_density, round(len(list_distinct(k)) / {len(KEYWORDS["python"].split())}, 6) AS keyword_diversity FROM k""")
def keywords(spark, sf_dir):
    found = S.keywords(F.col("code"))
    return _code(spark, sf_dir).select("doc_id", *[(F.round(c, 6) if n.startswith("keyword_d") else c).alias(n) for n, c in found.items()])


@query(WITH_WORDS + r""", t AS (SELECT doc_id, regexp_extract_all(whole, '["'']([^"'']*)["'']', 1) AS s, regexp_extract_all(code, '\b[0-9]+\.?[0-9]*\b') AS n FROM w)
SELECT doc_id, len(s)::BIGINT AS string_literal_count, len(n)::BIGINT AS number_literal_count, coalesce(round(list_avg(list_transform(s, lambda x: length(x))), 6), 0.0) AS avg_string_length, round(ln(1 + coalesce(list_avg(list_transform(n, lambda x: x::DOUBLE)), 0.0)), 6) AS avg_number_value FROM t""")
def literals(spark, sf_dir):
    found = S.literals(F.col("code"))
    found |= {"avg_string_length": F.round(found["avg_string_length"], 6), "avg_number_value": F.round(F.log1p(found["avg_number_value"]), 6)}
    return _code(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in found.items()])


@query(WITH_CODE + r""", f AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '\S')) AS f FROM l), k AS (SELECT *, list_transform(f, lambda x: length(x)::DOUBLE) AS n, len(list_filter(f, lambda x: x[1] = chr(9))) AS t, len(list_filter(f, lambda x: x[1] = ' ')) AS s FROM f)
SELECT doc_id, len(ls)::BIGINT AS total_lines, len(f)::BIGINT AS non_empty_lines, length(code)::BIGINT AS total_characters, len(regexp_extract_all(code, '\S+'))::BIGINT AS total_words,
  CASE WHEN t + s = 0 THEN 'unknown' WHEN t > s THEN 'tabs' WHEN s > t THEN 'spaces' ELSE 'mixed' END AS indentation_style,
  coalesce(round(list_avg(n), 6), 0.0) AS line_mean, coalesce(round(list_stddev_pop(n), 6), 0.0) AS line_std, coalesce(list_max(n), 0.0) AS line_max, coalesce(list_min(n), 0.0) AS line_min FROM k""")
def text_metadata(spark, sf_dir):
    return _code(spark, sf_dir).select("doc_id", *[(F.round(c, 6) if n in ("line_mean", "line_std") else c).alias(n) for n, c in S.metadata(F.col("code")).items()])


@query(WITH_CODE + r""", f AS (SELECT doc_id, array_to_string(list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '\S') THEN '0' ELSE '1' END), '') AS f FROM l)
SELECT doc_id, length(replace(f, '0', ''))::BIGINT AS blank_lines, len(regexp_extract_all(f, '1+'))::BIGINT AS blank_runs, coalesce(list_max(list_transform(regexp_extract_all(f, '1+'), lambda x: length(x))), 0)::BIGINT AS longest_run FROM f""")
def blank_runs(spark, sf_dir):
    return _code(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in S.blank_runs(F.col("code")).items()])


_MARKED = "(length(line) - length(replace(replace(line, '\"\"\"', ''), '''''''''', ''))) // 3"


@query(WITH_CODE + f""", u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l), m AS (SELECT *, {_MARKED} AS m FROM u),
s AS (SELECT *, sum(m) OVER (PARTITION BY doc_id ORDER BY i) - m AS before FROM m) SELECT doc_id, sum(m)::BIGINT AS markers, count(*) FILTER (before % 2 = 1 OR m > 0) AS docstring_lines FROM s GROUP BY doc_id""")
def docstring_state(spark, sf_dir):
    """Lines within triple quotes: the parity of the markers before a line says whether it begins inside."""
    start = F.struct(F.lit(0).cast("long").alias("markers"), F.lit(0).cast("long").alias("docstring_lines"))
    size = lambda x: F.length(x) - F.length(F.replace(F.replace(x, F.lit('"""'), F.lit("")), F.lit("'''"), F.lit("")))
    step = lambda acc, m: F.struct((acc["markers"] + m).alias("markers"), (acc["docstring_lines"] + F.when((acc["markers"] % 2 == 1) | (m > 0), 1).otherwise(0)).alias("docstring_lines"))
    marks = F.transform("ls", lambda x: F.floor(size(x) / 3))
    return _code(spark, sf_dir).select("doc_id", F.aggregate(marks, start, step).alias("s")).select("doc_id", "s.*")


_PARTS_SQL = WITH_WORDS + rf""", f AS (SELECT *, list_filter(string_split(whole, chr(10)), lambda x: regexp_matches(x, '\S')) AS f, regexp_extract_all(whole, '[A-Za-z0-9_]+') AS tk FROM w),
parts AS (SELECT doc_id, length(regexp_replace(whole, '^\s+|\s+$', '', 'g'))::BIGINT AS size, len(regexp_extract_all(lower(code), '\b[a-z_]+_[a-z_]+_[a-z_]+\b'))::BIGINT AS long_names, regexp_matches(whole, '{S.FORMAL_SECTION}') AS formal,
  len(regexp_extract_all(whole, '{S.HINT}'))::BIGINT AS hints, len(regexp_extract_all(code, '\bdef\s+\w+'))::BIGINT AS functions, (len(regexp_extract_all(whole, '(?s)""\".*?""\"')) + len(regexp_extract_all(whole, '(?s)''''''.*?'''''''))) ::BIGINT AS docstrings,
  len(tk)::BIGINT AS tokens, CASE WHEN len(tk) > 0 THEN len(list_distinct(tk)) / len(tk) ELSE 0.0 END AS diversity, len(f)::BIGINT AS lines,
  coalesce(list_max(map_values(list_histogram(list_transform(f, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))))) / len(f), 0.0) AS top_line, len(regexp_extract_all(code, '\b[a-z]{{1,3}}\s*='))::BIGINT AS short_names,
  CASE WHEN len(f) > 0 THEN len(list_filter(f, lambda x: regexp_matches(x, '^\s*#'))) / len(f) ELSE 0.0 END AS notes, ({" + ".join(f"contains(whole, '{c}')::INT" for c in S.RICH)})::BIGINT AS rich,
  regexp_matches(whole, '(?m)^ {{1,3}}[^ ]') AND regexp_matches(whole, '(?m)^\t') AS mixed FROM f)"""


@query(_PARTS_SQL + f" SELECT doc_id, round({S.style_sql(S.MACHINE)}, 6) AS machine, round({S.style_sql(S.HUMAN)}, 6) AS human, round(diversity, 6) AS diversity, round(top_line, 6) AS top_line, rich FROM parts")
def style_heuristics(spark, sf_dir):
    parts = _code(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in S.style_parts(F.col("code")).items()])
    return parts.select("doc_id", F.round(F.expr(S.style_sql(S.MACHINE)), 6).alias("machine"), F.round(F.expr(S.style_sql(S.HUMAN)), 6).alias("human"), F.round("diversity", 6).alias("diversity"), F.round("top_line", 6).alias("top_line"), "rich")


_MEASURED = {"doc_length": "length(text)", "line_count": "length(text) - length(replace(text, chr(10), '')) + 1", "space_ratio": "length(text) - length(replace(text, ' ', ''))", "n_chars_seen": "n_chars"}
_CATEGORY = {"doc_length": "documentation", "line_count": "statistical", "space_ratio": "stylistic", "n_chars_seen": "other"}


@query(" UNION ALL ".join(f"SELECT doc_id, '{f}' AS feature, '{_CATEGORY[f]}' AS category, ({e})::DOUBLE AS value FROM documents" for f, e in _MEASURED.items()))
def feature_category(spark, sf_dir):
    """A row for each document and feature, with the feature's category."""
    wide = table(spark, sf_dir, "documents").select("doc_id", *[F.expr(e).cast("double").alias(f) for f, e in _MEASURED.items()])
    return wide.unpivot("doc_id", list(_MEASURED), "feature", "value").select("doc_id", "feature", bi.feature_category(F.col("feature")).alias("category"), "value")


@query("""WITH x AS (SELECT user_id, list_transform(list(value ORDER BY event_id)[:10], lambda v: least(v, 100.0::DOUBLE)) AS p FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN len(p) >= 2 AND list_avg(p) <> 0 THEN round(list_stddev_pop(p) / list_avg(p), 6) ELSE 0.0 END AS burstiness FROM x""")
def burstiness(spark, sf_dir):
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("p"))
    return lists.select("user_id", F.round(rules.burstiness(F.col("p")), 6).alias("burstiness"))


@query(_PARTS_SQL + f""", s AS (SELECT doc_id, size, lines, {S.style_sql(S.MACHINE)} - ({S.style_sql(S.HUMAN)}) AS bias FROM parts)
SELECT doc_id, size < 40 OR lines < 3 AS short, CASE WHEN bias > 0.3 THEN 1 ELSE 0 END::INT AS prediction, round(0.35 + least(0.2, abs(bias) * 0.3), 6) AS confidence FROM s""")
def short_input(spark, sf_dir):
    parts = _code(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in S.style_parts(F.col("code")).items()])
    found = rules.short_input(F.col("size"), F.col("lines"), F.expr(S.style_sql(S.MACHINE)), F.expr(S.style_sql(S.HUMAN)))
    return parts.select("doc_id", *[c.alias(n) for n, c in found.items()])


_KINDS = """CASE WHEN t = '' THEN 'unknown' WHEN regexp_matches(t, 'class |struct |interface ') THEN 'class_definition' WHEN regexp_matches(t, 'def |function |fn |public ') THEN 'function' WHEN regexp_matches(t, 'import|#include') THEN 'import_statement'
  WHEN regexp_matches(t, 'main|entry') THEN 'main_function' WHEN contains(t, '#') AND contains(t, 'def') THEN 'python_function' WHEN contains(t, '{') AND contains(t, 'function') THEN 'javascript_function' ELSE 'other' END"""


@query(survey_sql(near=True) + f"""SELECT doc_id AS prediction_id, md5(text) AS code_hash, lang AS "language", CASE WHEN risk_score >= 0.2 THEN 'AI Generated' ELSE 'Human Written' END AS prediction, risk_score AS confidence, 'survey' AS model_name,
  '2024-01-31' AS "timestamp", coalesce(length(text), 0)::BIGINT AS code_length, {_KINDS.replace("t, ", "lower(coalesce(text, '')), ").replace("WHEN t =", "WHEN coalesce(text, '') =")} AS "type" FROM scored JOIN documents USING (doc_id)""")
def bi_predictions(spark, sf_dir):
    df = _scored(spark, sf_dir, near_id="doc_id", nearest=False).select(F.col("doc_id").alias("id"), F.md5("text").alias("code_hash"), F.col("lang").alias("language"), (F.col("risk_score") >= 0.2).cast("int").alias("prediction"), F.col("risk_score").alias("confidence"), F.lit("survey").alias("model_name"), F.lit(AS_OF.date().isoformat()).alias("timestamp"), "text")
    return bi.predictions(df, "text")


@query(survey_sql(near=True) + f"""SELECT count(*) AS total, count(*) FILTER (risk_score >= 0.2) AS machine, count(*) FILTER (risk_score < 0.2) AS human, count(*) FILTER (risk_score >= {LOW}) AS confident,
  round(count(*) FILTER (risk_score >= 0.2) / count(*) * 100, 1) AS machine_percent, round(count(*) FILTER (risk_score < 0.2) / count(*) * 100, 1) AS human_percent, round(count(*) FILTER (risk_score >= {LOW}) / count(*) * 100, 1) AS confident_percent FROM scored""")
def batch_summary(spark, sf_dir):
    df = _scored(spark, sf_dir, near_id="doc_id", nearest=False).select((F.col("risk_score") >= 0.2).cast("int").alias("prediction"), F.col("risk_score").alias("confidence"))
    return bi.batch_summary(df, least=LOW)


@query("""SELECT 'lang' AS dimension, coalesce(lang, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM documents GROUP BY 2""")
def dataset_stats(spark, sf_dir):
    return bi.dataset(table(spark, sf_dir, "documents"), ("lang", "source"))


@query("""WITH s AS (SELECT event_type AS model, user_id % 5 AS k, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT model, 'metric_' || k AS metric, round(CASE WHEN k < 2 THEN v WHEN k < 4 THEN v / 2 ELSE 0 END, 6) AS value FROM s""")
def bi_performance(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 5).alias("k")).agg(F.avg("value").alias("v"))
    held = s.select("model", F.concat(F.lit("metric_"), F.col("k")).alias("metric"), F.when(F.col("k") < 2, F.col("v")).alias("value"), F.when(F.col("k") < 4, F.col("v") / 2).alias("weighted_value"))
    return bi.performance(held)


@query("""WITH s AS (SELECT unnest(['l_quantity', 'l_tax', 'l_discount']) AS feature, unnest([round(avg(l_quantity), 6), round(avg(l_tax), 6), round(avg(l_discount), 6)]) AS importance FROM lineitem)
SELECT feature, importance, CASE WHEN contains(feature, 'count') THEN 'statistical' ELSE 'other' END AS category, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM s""")
def bi_importance(spark, sf_dir):
    means = frames.mean_abs(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax", "l_discount"])
    return bi.importances(means.select("feature", F.round("mean_abs", 6).alias("importance")))


@query("SELECT least(floor(round((value - 0) / 100 * 20, 6)), 19)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1")
def confidence_histogram(spark, sf_dir):
    return bi.histogram(table(spark, sf_dir, "events"), "value", 20, 0.0, 100.0)


@query(_JUDGED + """, c AS (SELECT ceil(round(p * 10, 9))::BIGINT AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM j GROUP BY 1)
SELECT round(coalesce(sum(gap * n) FILTER (bin >= 1) / sum(n), 0.0), 6) AS ece, round(coalesce(max(gap) FILTER (bin >= 1), 0.0), 6) AS mce FROM c""")
def calibration_error(spark, sf_dir):
    return metrics.calibration_error(_judged(spark, sf_dir))


@query(_JUDGED + """, c AS (SELECT ceil(round(p * 10, 9))::BIGINT AS bin, count(*) AS n, avg(p) AS confidence, avg(y) AS positive_share FROM j GROUP BY 1)
SELECT r.bin::BIGINT AS bin, coalesce(n, 0)::BIGINT AS n, round(coalesce(confidence, 0.0), 6) AS confidence, round(coalesce(positive_share, 0.0), 6) AS positive_share FROM (SELECT unnest(range(1, 11)) AS bin) r LEFT JOIN c USING (bin)""")
def reliability(spark, sf_dir):
    return metrics.reliability(_judged(spark, sf_dir))


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id = 7 AND event_type = 'click'")
def store_lookup(spark, sf_dir):
    return store.lookup(table(spark, sf_dir, "events"), user_id=7, event_type="click").select("event_id", "user_id", "event_type")


@query("SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY) AS deleted, count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY) AS kept FROM events")
def store_deleted(spark, sf_dir):
    return store.deleted(table(spark, sf_dir, "events"), "ts", AS_OF, 10)


_SCORES = "SELECT event_type AS model, 'attack_' || (user_id % 4) AS attack, round(avg(value) / 100, 6) AS score FROM events GROUP BY 1, 2"


def _attack_scores(spark, sf_dir):
    df = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), F.concat(F.lit("attack_"), F.col("user_id") % 4).alias("attack"))
    return df.agg(F.round(F.avg("value") / 100, 6).alias("score"))


@query(f"WITH s AS ({_SCORES}) SELECT model, count(*) AS n, round(avg(score), 6) AS mean_score, (list(attack ORDER BY score DESC, attack))[1] AS best_attack, (list(attack ORDER BY score, attack))[1] AS worst_attack FROM s GROUP BY model")
def robustness_summary(spark, sf_dir):
    return ensemble.robustness_summary(_attack_scores(spark, sf_dir))


@query(f"""WITH s AS ({_SCORES}), m AS (SELECT model, round(avg(score), 6) AS v FROM s GROUP BY model), e AS (SELECT max(v) AS v FROM m WHERE model = 'click')
SELECT round((SELECT v FROM e) - max(v), 6) AS over_best, round((SELECT v FROM e) - avg(v), 6) AS over_mean, round((SELECT v FROM e) - min(v), 6) AS over_worst FROM m WHERE model <> 'click'""")
def ensemble_advantage(spark, sf_dir):
    return ensemble.ensemble_advantage(ensemble.robustness_summary(_attack_scores(spark, sf_dir)), ensemble="click")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, 64::BIGINT AS n, round(list_sum(e[:57]), 4) AS kept, 0.0::DOUBLE AS gone FROM v""")
def feature_perturb(spark, sf_dir):
    """The one change without a draw; those with draws keep the length and are tested."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", ensemble.perturbed_features(F.col("embedding").cast("array<double>"), F.col("vec_id"), "append").alias("e"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return df.select("vec_id", F.size("e").cast("long").alias("n"), F.round(total(F.slice("e", 1, 57)), 4).alias("kept"), total(F.slice("e", 58, 7)).alias("gone"))


@query("SELECT event_id, (value >= 50)::INT AS m0_prediction, round(1 - value / 100, 6) AS m0_p0, round(value / 100, 6) AS m0_p1, round(greatest(value / 100, 1 - value / 100), 6) AS m0_confidence FROM events")
def alternate_meta_features(spark, sf_dir):
    p = F.col("value") / 100
    found = ensemble.alternate_meta_features([(F.col("value") >= 50).cast("int")], [p])
    return table(spark, sf_dir, "events").select("event_id", *[(c if n.endswith("prediction") else F.round(c, 6)).alias(n) for n, c in found.items()])


#: Weights of the parts of a joined vector.
_PARTS = (("characters", 0.3), ("tokens", 0.3), ("structure", 0.1))


def _times(weight: float):
    return lambda x: x * weight


@query(r"""WITH v AS (SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS n, len(regexp_extract_all(coalesce(text, ''), '\S+'))::DOUBLE AS w, len(string_split(coalesce(text, ''), chr(10)))::DOUBLE AS l FROM documents)
SELECT doc_id, round(n * 0.3, 6) AS characters, round(w * 0.3, 6) AS tokens, round(l * 0.1, 6) AS structure FROM v""")
def weighted_embedding(spark, sf_dir):
    """Parts of a vector, each times its weight, one after the other; a missing part counts 0."""
    text = F.coalesce("text", F.lit(""))
    parts = {"characters": F.array(F.length(text).cast("double")), "tokens": F.array(F.regexp_count(text, F.lit(r"\S+")).cast("double")), "structure": F.array(F.size(F.split(text, "\n", -1)).cast("double"))}
    joined = F.flatten(F.array(*[F.transform(parts[n], _times(w)) for n, w in _PARTS]))
    df = table(spark, sf_dir, "documents").select("doc_id", joined.alias("v"))
    return df.select("doc_id", *[F.round(F.col("v")[i], 6).alias(n) for i, (n, _) in enumerate(_PARTS)])
