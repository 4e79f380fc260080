"""Queries of scanned trees, statistics of languages and sample checks, and their SQL; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.functions import code as C
from lumora.functions import languages as L
from lumora.functions import text as T
from lumora.functions import tokens as K
from lumora.operators import rules
from lumora.plans.catalog import query, table
from lumora.plans.code_catalog import WITH_CODE, _code
from lumora.plans.language_catalog import _BEST, _LETTER, _SCORES, _TOP, WITH_WORDS, _score, _scored
from lumora.sources import files

_FOUND = {n: " + ".join(rf"regexp_matches(code, '(?i)\b{k}\b')::INT" for k in words.split()) for n, words in L.WORDS.items()}
_STATISTICS = WITH_WORDS + ", s AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS \"language\", {_score(n).removesuffix(f' AS {n}')} AS confidence, ({_FOUND[n]})::BIGINT AS keywords_found, len(regexp_extract_all(whole, '{L.SHAPES[n]}'))::BIGINT AS pattern_matches FROM w" for n in L.WORDS
) + ")"


@query(_STATISTICS + ' SELECT doc_id, "language", round(confidence, 6) AS confidence, keywords_found, pattern_matches FROM s')
def language_statistics(spark, sf_dir):
    df = _code(spark, sf_dir).withColumn("words", L.distinct_words(F.col("code"))).select("doc_id", F.explode(L.statistics(F.col("code"), F.col("words"))).alias("s"))
    return df.select("doc_id", "s.language", F.round("s.confidence", 6).alias("confidence"), "s.keywords_found", "s.pattern_matches")


_ORDER = "CASE l " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(L.WORDS)) + " END"


@query(_SCORES + ", u AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS l, {n} AS x FROM s" for n in L.WORDS) + f"""),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x DESC, {_ORDER}) AS place FROM u) SELECT doc_id, place, l AS "language", round(x, 6) AS confidence FROM k WHERE place <= 3""")
def language_top(spark, sf_dir):
    df = _scored(spark, sf_dir).select("doc_id", F.posexplode(L.top({n: F.col(n) for n in L.WORDS}, 3)).alias("place", "t"))
    return df.select("doc_id", (F.col("place") + 1).cast("long").alias("place"), "t.language", F.round("t.confidence", 6).alias("confidence"))


_HINTS = "CASE " + " ".join(f"WHEN suffix IN ({', '.join(repr(x) for x in of)}) THEN '{n}'" for n, of in L.EXTENSIONS.items()) + " END"
_HINTED = "CASE hint " + " ".join(f"WHEN '{n}' THEN {n}" for n in L.WORDS) + " END"


@query(WITH_CODE + rf""", w AS (SELECT doc_id, code AS whole, regexp_replace(code, '{_LETTER}*[^\P{{L}}\x00-\x7f]{_LETTER}*', 'é', 'g') AS code, lower(regexp_extract(url, '\.([^.]*)$', 1)) AS suffix FROM c LEFT JOIN pages ON page_id = doc_id),
s AS (SELECT doc_id, {_HINTS} AS hint, {", ".join(map(_score, L.WORDS))} FROM w)
SELECT doc_id, CASE WHEN {_HINTED} > 0.3 THEN hint WHEN {_TOP} < 0.2 THEN 'unknown' ELSE {_BEST} END AS "language", round(CASE WHEN {_HINTED} > 0.3 THEN {_HINTED} WHEN {_TOP} < 0.2 THEN 0.0 ELSE {_TOP} END, 6) AS confidence FROM s""")
def language_hinted(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    df = _scored(spark, sf_dir).join(pages, "doc_id", "left")
    top = L.hinted(F.col("code"), F.col("url"), {n: F.col(n) for n in L.WORDS})
    return df.select("doc_id", top.alias("top")).select("doc_id", "top.language", F.round("top.confidence", 6).alias("confidence"))


def _flag_sql(language: str) -> str:
    flags = [(" OR ".join(f"contains(text, '{p}')" for p in parts) if parts else "FALSE") + f" AS {name}" for name, parts in ((n, rules.FLAGS[language].get(n, ())) for n in rules.FLAG_NAMES)]
    return f"SELECT doc_id, '{language}' AS \"language\", {', '.join(flags)} FROM d"


@query("WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) " + " UNION ALL ".join(map(_flag_sql, rules.FLAGS)))
def sample_flags(spark, sf_dir):
    each = table(spark, sf_dir, "documents").withColumn("language", F.explode(F.array(*map(F.lit, rules.FLAGS))))
    return each.select("doc_id", "language", *[c.alias(n) for n, c in rules.sample_flags(F.col("text"), F.col("language")).items()])


@query()
def sample_syntax(spark, sf_dir):
    checked = rules.validated(_code(spark, sf_dir).withColumn("language", F.lit("python")), "code", "language")
    return checked.select("doc_id", "is_valid", "issues")


_SIDES = ("keywords", "identifiers", "operators", "delimiters", "numbers", "comments", "whitespace")


def _jaccard_sql() -> str:
    patterns = {"keywords": r"\b(?:" + L.KEYWORDS["python"].replace(" ", "|") + r")\b", "identifiers": L.NAMES["python"], "comments": L.COMMENTS["python"], **L.TOKENS}
    masked = lambda x: rf"regexp_replace({x}, '{_LETTER}*[^\P{{L}}\x00-\x7f]{_LETTER}*', 'é', 'g')"
    one = " UNION ALL ".join(
        f"SELECT item_id, '{k}' AS class, list_distinct(regexp_extract_all({'am' if k in ('keywords', 'identifiers', 'numbers') else 'a'}, '{patterns[k]}')) AS x, list_distinct(regexp_extract_all({'bm' if k in ('keywords', 'identifiers', 'numbers') else 'b'}, '{patterns[k]}')) AS y FROM p"
        for k in _SIDES
    )
    return f"""WITH p AS (SELECT item_id, b.text AS a, d.text AS b, {masked('b.text')} AS am, {masked('d.text')} AS bm FROM benchmark b JOIN documents d ON d.doc_id = b.item_id), t AS ({one})
SELECT item_id, class, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS similarity FROM t WHERE len(x) + len(y) > 0"""


@query(_jaccard_sql())
def token_similarity(spark, sf_dir):
    pairs = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("a")).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("b")), "item_id")
    return K.similarities(pairs, "item_id", "a", "b", "python", _SIDES).withColumn("similarity", F.round("similarity", 6))


@query(rf"""WITH f AS (SELECT page_id, url, html, CASE WHEN html IS NULL OR trim(html) = '' THEN NULL ELSE list_distinct(regexp_extract_all(lower(html), '{_LETTER}+')) END AS w, lower(html) AS low FROM pages
  WHERE url IS NOT NULL AND NOT regexp_matches(url, '(^|/)({files.VENDOR_PATTERN})/'))
SELECT page_id, url AS path, CASE WHEN low IS NULL OR trim(low) = '' THEN 'Error' WHEN contains(low, 'generated') OR contains(low, 'assistant') OR contains(low, 'gpt') THEN 'AI' ELSE 'Human' END AS prediction,
  round(CASE WHEN low IS NULL OR trim(low) = '' OR len(regexp_extract_all(low, '{_LETTER}+')) = 0 THEN 0.0 ELSE len(w) / len(regexp_extract_all(low, '{_LETTER}+')) END, 6) AS confidence FROM f""")
def tree_scores(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumnsRenamed({"url": "path", "html": "text"})
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    label = F.when(rules.keyword_label(F.col("text")) == "ai", 1).otherwise(0)
    scored = files.scored_tree(files.scan_tree(pages), label, C.ratio(F.size(F.array_distinct(words)), F.size(words)))
    return scored.select("page_id", "path", "prediction", F.round("confidence", 6).alias("confidence"))
