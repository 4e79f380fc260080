"""All queries of the library and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions import text as T
from lumora.operators import metrics, rules, sampling, store, survey
from lumora.session import small_batches
from lumora.sources import files

QUERIES: dict = {}
ORACLES: dict = {}
LOW = 0.35  # a threshold that the test tables reach
AS_OF = dt.datetime(2024, 1, 31)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(rules_) -> str:
    return " + ".join(f"CASE WHEN {cond} THEN {weight} ELSE 0 END" for _, weight, cond in rules_)


def _reasons(rules_) -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, _, cond in rules_)
    return f"array_to_string(list_sort(list_filter([{items}], lambda x: x IS NOT NULL)), ';')"


_LOW = "strip_accents(lower(t))"
#: CTEs that end in near_rows: each row's most similar other row among all, by brute force over the distinct texts.
NEAR = rf"""
ng AS (SELECT min(doc_id) AS rep, count(*) AS size, text AS t FROM documents WHERE text IS NOT NULL GROUP BY text),
nw AS (SELECT rep, size, regexp_extract_all({_LOW}, '[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}') AS w FROM ng),
ne AS (SELECT rep, size, unnest(w || CASE WHEN len(w) > 1 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS term FROM nw),
nf AS (SELECT rep, size, term, count(*) AS tf FROM ne GROUP BY ALL),
nv AS (SELECT term, sum(size) AS df FROM nf GROUP BY term HAVING sum(size) >= 2 ORDER BY sum(tf * size) DESC, term LIMIT 5000),
nr AS (SELECT rep, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS x FROM nf JOIN nv USING (term)),
nn AS (SELECT rep, term, x / sqrt(sum(x * x) OVER (PARTITION BY rep)) AS x FROM nr),
np AS (SELECT p.rep AS a, q.rep AS b, round(sum(p.x * q.x), 9) AS similarity FROM nn p JOIN nn q ON p.term = q.term AND p.rep <> q.rep GROUP BY 1, 2 HAVING sum(p.x * q.x) >= 0.92 - 1e-9),
nd AS (SELECT doc_id, rep FROM documents JOIN ng ON text = t WHERE rep IN (SELECT rep FROM nn)),
nc AS (SELECT d.doc_id, p.b AS other, p.similarity FROM nd d JOIN np p ON d.rep = p.a UNION ALL SELECT d.doc_id, e.doc_id, 1.0 FROM nd d JOIN nd e ON d.rep = e.rep AND d.doc_id <> e.doc_id),
near_rows AS (SELECT doc_id, arg_max(other, (similarity, -other)) AS near_duplicate_index, max(similarity) AS near_duplicate_similarity FROM nc GROUP BY doc_id)"""


def survey_sql(name: str = "documents", key: str = "doc_id", duplicates: bool = True, threshold: float = 0.65, near: bool = False) -> str:
    """CTEs that end in `scored`."""
    used = survey.RULES + (survey.DUPLICATE_RULES if duplicates else ()) + (survey.NEAR_RULES if near else ())
    close = NEAR + "," if near else ""
    joined = "SELECT g0.*, coalesce(near_duplicate_index, -1)::BIGINT AS near_duplicate_index, round(coalesce(near_duplicate_similarity, 0.0), 6) AS near_duplicate_similarity FROM g0 LEFT JOIN near_rows USING (doc_id)" if near else "SELECT * FROM g0"
    return rf"""
WITH n0 AS (SELECT {key}, trim(regexp_replace(coalesce(text, 'nan'), '\s+', ' ', 'g')) AS norm FROM {name}),
n1 AS (SELECT *, regexp_extract_all(lower(norm), '[a-z0-9'']+') AS w, length(norm)::BIGINT AS n_chars, md5(norm) AS norm_md5 FROM n0),
n2 AS (SELECT *, len(w)::BIGINT AS n_words, greatest(n_chars, 1) AS one,
  n_chars - length(regexp_replace(norm, '\p{{Nd}}+', '', 'g')) AS d, n_chars - length(regexp_replace(norm, '\p{{L}}+', '', 'g')) AS a, n_chars - length(replace(norm, ' ', '')) AS s,
  list_filter(regexp_split_to_array(trim(norm), '[.!?]+\s+'), lambda x: trim(x) <> '') AS sents,
  [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w)::BIGINT)] AS bi, [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w)::BIGINT - 1)] AS tri,
  string_split(norm, '') AS chars FROM n1),
n3 AS (SELECT *, list_transform(sents, lambda x: len(regexp_extract_all(lower(x), '[a-z0-9'']+'))::DOUBLE) AS lens FROM n2),
m AS (SELECT {key}, norm_md5, n_chars, n_words, len(list_distinct(w)) / greatest(len(w), 1) AS unique_ratio, d / one AS digit_ratio, a / one AS alpha_ratio, greatest(n_chars - d - a - s, 0) / one AS special_ratio,
  CASE WHEN n_chars = 0 THEN 0.0 ELSE list_aggregate(chars, 'entropy') END AS entropy,
  len(list_filter(list_distinct(chars), lambda c: c <> '' AND contains(norm, repeat(c, 7)))) > 0 AS repeated_run,
  regexp_matches(norm, '!!!|\?\?\?|;;;|\.\.\.|,,,') AS many_marks,
  CASE WHEN len(lens) >= 2 AND list_avg(lens) > 0 THEN list_stddev_pop(lens) / (list_avg(lens) + 1e-9) ELSE 0.0 END AS sentence_cv,
  CASE WHEN len(bi) > 0 THEN list_max(map_values(list_histogram(bi))) / len(bi) ELSE 0.0 END AS max_bigram,
  CASE WHEN len(tri) > 0 THEN list_max(map_values(list_histogram(tri))) / len(tri) ELSE 0.0 END AS max_trigram FROM n3),
g0 AS (SELECT *, count(*) OVER (PARTITION BY norm_md5) AS duplicate_group_size FROM m), {close}
g AS ({joined}),
r AS (SELECT *, round(least(greatest(({_case(used)})::DOUBLE, 0.0), 1.0), 6) AS risk_score, {_reasons(used)} AS reasons FROM g),
scored AS (SELECT *, risk_score >= {threshold} AS flagged, CASE WHEN risk_score >= {threshold} THEN 'Flagged' ELSE 'OK' END AS label FROM r)
"""


_METRICS = ("unique_ratio", "digit_ratio", "alpha_ratio", "special_ratio", "entropy", "sentence_cv", "max_bigram", "max_trigram")
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS)


def _scored(spark, sf_dir, name="documents", **kw) -> DataFrame:
    return survey.score(table(spark, sf_dir, name), **kw)


_KEPT = ("repeated_run", "many_marks", "duplicate_group_size", "near_duplicate_index", "near_duplicate_similarity", "risk_score", "flagged", "label", "reasons")


@query(survey_sql(near=True) + f"SELECT doc_id, n_chars, n_words, {_ROUNDED}, {', '.join(_KEPT)} FROM scored")
def survey_score(spark, sf_dir):
    out = _scored(spark, sf_dir, near_id="doc_id")
    return out.select("doc_id", "n_chars", "n_words", *[F.round(m, 6).alias(m) for m in _METRICS], *_KEPT)


@query(survey_sql("conversations", "conv_id, turn", duplicates=False) + "SELECT conv_id, turn, risk_score, label, reasons FROM scored")
def survey_single(spark, sf_dir):
    return _scored(spark, sf_dir, "conversations", duplicates=False).select("conv_id", "turn", "risk_score", "label", "reasons")


_TOP = "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ';')) AS reason FROM scored) WHERE reason <> '' GROUP BY reason ORDER BY n DESC, reason LIMIT 15"


@query(survey_sql(threshold=LOW, near=True) + f"""SELECT count(*) AS total, count(*) FILTER (flagged) AS flagged, count(*) FILTER (duplicate_group_size >= 2) AS exact_duplicate_rows, round(count(*) FILTER (flagged) / count(*), 6) AS flag_rate,
  {LOW}::DOUBLE AS risk_threshold, (SELECT string_agg(reason || ':' || n, ';' ORDER BY n DESC, reason) FROM ({_TOP})) AS top_reasons FROM scored""")
def survey_report(spark, sf_dir):
    scored = _scored(spark, sf_dir, threshold=LOW, near_id="doc_id", nearest=False).select("flagged", "duplicate_group_size", "reasons")
    return survey.report(scored, LOW)


@query(survey_sql(near=True) + _TOP)
def survey_reasons_top(spark, sf_dir):
    return survey.top_reasons(_scored(spark, sf_dir, near_id="doc_id", nearest=False))


@query(survey_sql(threshold=LOW, near=True) + "SELECT doc_id, risk_score FROM scored WHERE NOT flagged")
def survey_cleaned(spark, sf_dir):
    return survey.cleaned(_scored(spark, sf_dir, threshold=LOW, near_id="doc_id", nearest=False)).select("doc_id", "risk_score")


@query(r"SELECT md5(trim(regexp_replace(coalesce(text, 'nan'), '\s+', ' ', 'g'))) AS norm_md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) >= 2")
def exact_duplicates(spark, sf_dir):
    return survey.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id")


@query(r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
k AS (SELECT *, list_transform(ls, lambda x: length(x)::DOUBLE) AS lens, len(list_filter(ls, lambda x: trim(x) <> '')) AS nb, len(regexp_extract_all(text, '\S+')) AS words FROM l)
SELECT doc_id, len(ls)::BIGINT AS total_lines, nb::BIGINT AS non_empty_lines, length(text)::BIGINT AS total_characters, words::BIGINT AS total_words,
  round(list_avg(lens), 6) AS avg_line, list_max(lens)::BIGINT AS max_line, list_min(lens)::BIGINT AS min_line, round(list_stddev_pop(lens), 6) AS std_line,
  round((len(ls) - nb) / len(ls), 6) AS blank_ratio, round(words / len(ls), 6) AS words_per_line FROM k""")
def basic_stats(spark, sf_dir):
    df = table(spark, sf_dir, "documents").withColumn("ls", T.lines(F.col("text")))
    df = df.withColumns({"lens": F.transform("ls", lambda x: F.length(x).cast("double")), "nb": F.size(F.filter("ls", lambda x: F.trim(x) != "")), "words": F.regexp_count("text", F.lit(r"\S+"))})
    n = F.size("ls")
    return df.select(
        "doc_id", n.cast("long").alias("total_lines"), F.col("nb").cast("long").alias("non_empty_lines"), F.length("text").cast("long").alias("total_characters"), F.col("words").cast("long").alias("total_words"),
        F.round(T.moments(F.col("lens"), lambda n, s, m, d: m), 6).alias("avg_line"), F.array_max("lens").cast("long").alias("max_line"), F.array_min("lens").cast("long").alias("min_line"), F.round(T.moments(F.col("lens"), lambda n, s, m, d: d), 6).alias("std_line"),
        F.round((n - F.col("nb")) / n, 6).alias("blank_ratio"), F.round(F.col("words") / n, 6).alias("words_per_line"),
    )


@query(r"""
SELECT doc_id, round(len(list_distinct(list_filter(string_split(text, ''), lambda c: c <> ''))) / greatest(length(text), 1), 6) AS unique_share,
  round((length(text) - length(regexp_replace(text, '\p{Nd}+', '', 'g'))) / greatest(length(text), 1), 6) AS digit_share,
  round((length(text) - length(regexp_replace(text, '\p{L}+', '', 'g'))) / greatest(length(text), 1), 6) AS alpha_share,
  round((length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g'))) / greatest(length(text), 1), 6) AS upper_share,
  round((length(text) - length(regexp_replace(text, '\p{Ll}+', '', 'g'))) / greatest(length(text), 1), 6) AS lower_share FROM documents""")
def chars(spark, sf_dir):
    """Shares of characters; 0 in an empty text, null in a null one."""
    text, n = F.col("text"), F.greatest(F.length("text"), F.lit(1))
    share = {"digit": r"\p{Nd}+", "alpha": r"\p{L}+", "upper": r"\p{Lu}+", "lower": r"\p{Ll}+"}
    distinct = F.size(F.array_remove(F.array_distinct(F.split(text, "")), ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(distinct / n, 6).alias("unique_share"), *[F.round(T.removed_length(text, p) / n, 6).alias(f"{k}_share") for k, p in share.items()])


@query("SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0 ELSE list_aggregate(string_split(text, ''), 'entropy') END, 6) AS entropy FROM documents")
def entropy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.entropy(F.col("text")), 6).alias("entropy"))


@query(r"SELECT page_id, 1 + len(regexp_extract_all(html, '\b(if|elif|else|for|while|try|except|and|or)\b'))::BIGINT AS complexity FROM pages")
def cyclomatic(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", (1 + T.branch_count(F.col("html"))).cast("long").alias("complexity"))


@query("SELECT doc_id, md5(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))


@query(r"SELECT doc_id, md5(trim(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '\n\n\n', chr(10) || chr(10), 'g'), '\r\n?', chr(10), 'g'), chr(10)), lambda x: rtrim(x)), chr(10)), ' ' || chr(10))) AS cleaned_md5 FROM documents")
def clean_text(spark, sf_dir):
    once = F.regexp_replace(F.regexp_replace("text", "\n\n\n", "\n\n"), "\r\n?", "\n")
    joined = F.array_join(F.transform(F.split(once, "\n", -1), lambda x: F.rtrim(x)), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.trim(joined, F.lit(" \n"))).alias("cleaned_md5"))


@query("SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS lines, (len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '')))::BIGINT AS blank FROM documents")
def blank_lines(spark, sf_dir):
    ls = T.lines(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ls).cast("long").alias("lines"), F.size(F.filter(ls, lambda x: F.trim(x) == "")).cast("long").alias("blank"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'unknown' WHEN contains(lower(text), 'generated') OR contains(lower(text), 'assistant') OR contains(lower(text), 'gpt') THEN 'ai' ELSE 'human' END AS label FROM documents")
def keyword_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.keyword_label(F.col("text")).alias("label"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' END, CASE WHEN length(text) < 10 THEN 'too_short' END, CASE WHEN length(text) > 50000 THEN 'too_long' END], lambda x: x IS NOT NULL), ';') AS issues FROM documents")
def validate_samples(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.sample_issues(F.col("text")).alias("issues"))


@query(survey_sql(near=True) + "SELECT doc_id, CASE WHEN risk_score >= 0.85 THEN 'Very High' WHEN risk_score >= 0.7 THEN 'High' WHEN risk_score >= 0.6 THEN 'Medium' WHEN risk_score >= 0.5 THEN 'Low' ELSE 'Very Low' END AS certainty FROM scored")
def certainty_band(spark, sf_dir):
    return _scored(spark, sf_dir, near_id="doc_id", nearest=False).select("doc_id", rules.certainty(F.col("risk_score")).alias("certainty"))


_LANGS = " ".join(f"WHEN '{s}' THEN '{lang}'" for s, lang in rules.SUFFIXES.items())


@query(rf"SELECT page_id, CASE lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) {_LANGS} ELSE 'unknown' END AS language FROM pages")
def suffix_language(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", rules.suffix_language(F.col("url")).alias("language"))


_SHUFFLED = "row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id)"


@query(f"SELECT doc_id, quality, CASE WHEN {_SHUFFLED} <= floor(count(*) OVER (PARTITION BY quality) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM labels")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(table(spark, sf_dir, "labels"), "doc_id", "quality").select("doc_id", "quality", "split")


@query(f"SELECT doc_id, quality, (({_SHUFFLED} - 1) % 5)::BIGINT AS fold FROM labels")
def kfold(spark, sf_dir):
    return sampling.stratified_folds(table(spark, sf_dir, "labels"), "doc_id", "quality").select("doc_id", "quality", "fold")


@query("""
WITH RECURSIVE s AS (SELECT o_custkey, count(*)::BIGINT AS size, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS k FROM orders GROUP BY o_custkey),
r(k, loads, fold) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], 0::BIGINT UNION ALL
  SELECT s.k, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + s.size ELSE x END), list_position(loads, list_min(loads))::BIGINT - 1 FROM r JOIN s ON s.k = r.k + 1)
SELECT o_orderkey, o_custkey, fold FROM orders JOIN s USING (o_custkey) JOIN r USING (k)""")
def group_kfold(spark, sf_dir):
    return sampling.group_folds(table(spark, sf_dir, "orders"), "o_custkey").select("o_orderkey", "o_custkey", "fold")


@query("""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS n FROM events)
SELECT event_id, (CASE WHEN r < n - (n // 6) * 5 THEN 0 ELSE (r - (n - (n // 6) * 5)) // (n // 6) + 1 END)::BIGINT AS fold FROM r""")
def time_series_folds(spark, sf_dir):
    return sampling.time_folds(table(spark, sf_dir, "events"), "event_id", "ts").select("event_id", "fold")


@query(f"SELECT doc_id, quality FROM (SELECT *, {_SHUFFLED} AS k FROM labels) WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))")
def undersample(spark, sf_dir):
    return sampling.undersample(table(spark, sf_dir, "labels"), "doc_id", "quality").select("doc_id", "quality")


@query("""
WITH k AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels),
m AS (SELECT *, max(n) OVER () AS most FROM k)
SELECT doc_id, quality, unnest(range(1, most // n + CASE WHEN k <= most % n THEN 1 ELSE 0 END + 1))::BIGINT AS copy FROM m""")
def oversample(spark, sf_dir):
    return sampling.oversample(table(spark, sf_dir, "labels"), "doc_id", "quality").select("doc_id", "quality", "copy")


@query("""
SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 4) AS quantity_z FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)""")
def standardize(spark, sf_dir):
    return sampling.standardize(table(spark, sf_dir, "lineitem"), ["l_quantity"]).select("l_orderkey", "l_linenumber", F.round("l_quantity_z", 4).alias("quantity_z"))


def _judged(spark, sf_dir) -> DataFrame:
    risk = _scored(spark, sf_dir, near_id="doc_id", nearest=False).select("doc_id", F.col("risk_score").alias("p"))
    return table(spark, sf_dir, "labels").where("toxic IS NOT NULL").join(risk, "doc_id").select("doc_id", F.col("toxic").alias("y"), "p", (F.col("p") >= 0.2).cast("int").alias("yhat"))


_JUDGED = survey_sql(near=True) + ", j AS (SELECT labels.doc_id, toxic AS y, risk_score AS p, (risk_score >= 0.2)::INT AS yhat FROM labels JOIN scored USING (doc_id) WHERE toxic IS NOT NULL)"
_BY_SCORE = _JUDGED + """,
s AS (SELECT p AS score, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM j GROUP BY p),
b AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM s)"""


@query(_JUDGED + """, c AS (SELECT count(*) FILTER (y = 0 AND yhat = 0) AS tn, count(*) FILTER (y = 0 AND yhat = 1) AS fp, count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) FILTER (y = 1 AND yhat = 1) AS tp FROM j)
SELECT *, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS "precision", CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall,
  CASE WHEN tn + fp > 0 THEN round(tn / (tn + fp), 6) ELSE 0 END AS specificity, CASE WHEN tn + fp > 0 THEN round(fp / (tn + fp), 6) ELSE 0 END AS false_alarm_rate, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1 FROM c""")
def confusion(spark, sf_dir):
    return metrics.confusion(_judged(spark, sf_dir))


@query(_BY_SCORE + "SELECT round(sum(pos * ((an - fp) + neg / 2)) / (any_value(ap) * any_value(an)), 6) AS roc_auc FROM b")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_judged(spark, sf_dir))


@query(_BY_SCORE + "SELECT round(sum(pos / ap * tp / (tp + fp)), 6) AS average_precision FROM b")
def average_precision(spark, sf_dir):
    return metrics.average_precision(_judged(spark, sf_dir))


@query(_BY_SCORE + 'SELECT score, round(fp / an, 6) AS fpr, round(tp / ap, 6) AS tpr, round(tp / (tp + fp), 6) AS "precision" FROM b')
def score_curve(spark, sf_dir):
    return metrics.curve(_judged(spark, sf_dir))


@query(_JUDGED + """, c AS (SELECT ceil(round(p * 10, 9))::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS positive_share FROM j GROUP BY 1),
d AS (SELECT *, round(abs(confidence - positive_share), 6) AS gap, sum(n) OVER () AS total FROM c)
SELECT bin, n, confidence, positive_share, gap, round(gap * n / total, 6) AS weighted_gap FROM d WHERE bin >= 1""")
def calibration(spark, sf_dir):
    return metrics.calibration(_judged(spark, sf_dir))


@query("SELECT toxic AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY toxic")
def class_balance(spark, sf_dir):
    return metrics.class_balance(table(spark, sf_dir, "labels"), "toxic")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def store_upsert_latest(spark, sf_dir):
    return store.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def store_stats(spark, sf_dir):
    return store.stats(table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def store_retention(spark, sf_dir):
    return store.retained(table(spark, sf_dir, "events"), "ts", AS_OF, 10).select("event_id")


@query("SELECT doc_id, 'quality' AS metric, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def metric_unpivot(spark, sf_dir):
    return store.unpivot_metrics(table(spark, sf_dir, "labels"), ["doc_id"], ["quality", "toxic"])


@query("SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def bi_time_series(spark, sf_dir):
    return store.by_day(table(spark, sf_dir, "events"), "ts", "event_type")


@query(survey_sql(near=True) + "SELECT least(floor(round(risk_score * 25, 6)), 24)::BIGINT AS bin, count(*) AS n FROM scored GROUP BY 1")
def risk_histogram(spark, sf_dir):
    bin_ = F.least(F.floor(F.round(F.col("risk_score") * 25, 6)), F.lit(24)).cast("long")
    return _scored(spark, sf_dir, near_id="doc_id", nearest=False).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query(survey_sql(near=True) + ", v AS (SELECT doc_id, CASE WHEN (risk_score >= 0.2)::INT + contains(lower(norm_text.text), 'generated')::INT + (n_words < 50)::INT >= 2 THEN 1 ELSE 0 END AS vote FROM scored JOIN documents AS norm_text USING (doc_id)) SELECT doc_id, vote FROM v")
def majority_vote(spark, sf_dir):
    said = table(spark, sf_dir, "documents").withColumn("said", F.lower("text").contains("generated").cast("int"))  # so that the score's joins move no texts
    votes = [(F.col("risk_score") >= 0.2).cast("int"), F.col("said"), (F.col("n_words") < 50).cast("int")]
    return survey.score(said, near_id="doc_id", nearest=False).select("doc_id", rules.majority(votes).cast("int").alias("vote"))


@query(r"""SELECT page_id, url, length(html[:2000])::BIGINT AS n FROM pages WHERE starts_with(url, 'https://') AND NOT regexp_matches(url, '(^|/)(vendor|node_modules|dist|build|venv|\.venv|__pycache__|\.git)/') AND regexp_matches(url, '(?i)\.(html|com|org|php)([?#].*)?$') ORDER BY url, page_id LIMIT 40""")
def repo_scan(spark, sf_dir):
    files_ = files.scan_tree(table(spark, sf_dir, "pages"), "https://", ("html", "com", "org", "php"), None, 2000, "url", "html")
    return files_.orderBy("url", "page_id").limit(40).select("page_id", "url", F.length("html").cast("long").alias("n"))
