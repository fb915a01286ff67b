"""Queries over articles as they come in: normalising, judging, counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.functions import urls
from newsloom.operators import delivery, lateness
from newsloom.session import table

#: Characters of a summary that are kept, age at which an article is refused, and share of addresses in the sample.
SUMMARY_LIMIT, MAX_AGE_MS, SAMPLE = 600, 72 * 3_600_000, 0.25
LANGS = ("de", "en", "es", "fr", "it", "ja", "nl", "pt", "ru")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles_raw")


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    u = _raw(spark, d).select("raw_offset", urls.canonical(F.concat(F.regexp_replace("url", r"\?.*$", ""), F.lit("/?utm_source=x&b=2&a=1&ref=y#top"))).alias("url"))
    return u.select("raw_offset", "url", urls.article_id(F.col("url")).alias("id"), urls.host(F.col("url")).alias("host"))


def html_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("raw_offset", tx.clean_html(F.col("summary")).alias("summary"))


def truncated_summaries(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("raw_offset", tx.truncate(tx.squeeze(F.col("summary")), SUMMARY_LIMIT).alias("summary"))


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    """All articles with cleaned texts, corrected event time, language and the reason for a rejection."""
    r = _raw(spark, d)
    sources = table(spark, d, "feed_sources").select(F.col("source_id").alias("sid"), F.col("lang").alias("configured"))
    t = r.withColumn("url", urls.canonical(F.col("url"))).withColumn("title", tx.clean_html(F.col("title"))).withColumn("summary", tx.truncate(tx.clean_html(F.coalesce("summary", F.lit(""))), SUMMARY_LIMIT))
    t = t.withColumn("summary", F.when(F.col("summary") == F.col("title"), "").otherwise(F.col("summary"))).withColumn("event_ms", lateness.event_time())
    t = t.join(sources, F.split_part("source_id", F.lit(":"), F.lit(1)) == F.col("sid"), "left")
    hint = tx.language_code(F.col("lang"))
    t = t.withColumn("lang", tx.resolve_language(tx.language_code(F.col("configured")), hint, F.lit(None).cast("string"), F.col("configured").isNull()))
    why = F.when(F.col("url").isNull(), "invalid_url").when(F.coalesce("title", F.lit("")) == "", "missing_title").when(F.col("fetched_at_ms") - F.col("event_ms") > MAX_AGE_MS, "too_old").otherwise("accepted")
    return t.withColumn("outcome", why)


def articles_normalized(spark: SparkSession, d: str) -> DataFrame:
    t = _normalized(spark, d).where("outcome = 'accepted'")
    corrected = ~F.col("event_ms").eqNullSafe(F.col("published_at_ms"))
    return t.select("raw_offset", urls.article_id(F.col("url")).alias("id"), "source_id", "url", "title", "summary", F.col("event_ms").alias("published_at_ms"), "fetched_at_ms", "lang", corrected.alias("event_time_corrected"))


def reject_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d).groupBy("source_kind", "outcome").agg(F.count("*").alias("n"))


def lang_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"))


def url_sampling(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).where(urls.sampled(F.col("url"), SAMPLE)).select("raw_offset", "url")


def domain_allowlist(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).where(urls.allowed(F.col("url"), ["meridian.wire.example", "culture.example"])).select("raw_offset")


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of enabled sources with what came from each."""
    n = _raw(spark, d).groupBy(F.split_part("source_id", F.lit(":"), F.lit(1)).alias("source_id")).agg(F.count("*").alias("articles"), F.max("fetched_at_ms").alias("last_fetched_ms"))
    c = table(spark, d, "feed_sources").where("enabled").select("source_id", "category", "poll_interval_s")
    return c.join(n, "source_id", "left").select("source_id", "category", "poll_interval_s", F.coalesce("articles", F.lit(0)).alias("articles"), "last_fetched_ms")


def ingest_check(spark: SparkSession, d: str) -> DataFrame:
    """Per source: rows, old ones, ones without a title or with a corrected time, and the newest age."""
    e = _raw(spark, d).withColumn("event_ms", lateness.event_time())
    return e.groupBy("source_id").agg(
        F.count("*").alias("items"), F.count_if(F.col("fetched_at_ms") - F.col("event_ms") > MAX_AGE_MS).alias("old"), F.count_if(F.coalesce("title", F.lit("")) == "").alias("bad"),
        F.count_if(~F.col("event_ms").eqNullSafe(F.col("published_at_ms"))).alias("fixed"), F.min(F.col("fetched_at_ms") - F.col("event_ms")).alias("newest_age_ms"),
    )


def top_langs(spark: SparkSession, d: str) -> DataFrame:
    """The three most frequent languages of each source."""
    n = _raw(spark, d).groupBy("source_id", tx.language_code(F.col("lang")).alias("lang")).agg(F.count("*").alias("n")).where("lang IS NOT NULL")
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("n"), "lang"))).where("rank <= 3")


def fixture_stats(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles_embedded").select("article.*", F.size("vector").alias("dim"), "model_version")
    return a.agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("published_at_ms").alias("first_ms"), F.max("published_at_ms").alias("last_ms"),
        F.countDistinct("lang").alias("langs"), F.countDistinct("source_id").alias("sources"), F.countDistinct("model_version").alias("models"),
        F.round(100.0 * F.count_if(F.coalesce("summary", F.lit("")) == "") / F.count("*"), 6).alias("no_summary_pct"),
        F.round(100.0 * F.count_if("event_time_corrected") / F.count("*"), 6).alias("corrected_pct"), F.max("dim").alias("dim"),
    )


def backfill_order(spark: SparkSession, d: str) -> DataFrame:
    """Each id once, the first delivery, in the order of a recorded fixture."""
    first = Window.partitionBy("id").orderBy("raw_offset")
    r = _raw(spark, d).where("id IS NOT NULL").withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    return r.orderBy("fetched_at_ms", "id").select("raw_offset", "id", "fetched_at_ms")


def seen_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Messages of later batches whose id no earlier batch brought."""
    r = _raw(spark, d).where("id IS NOT NULL").withColumn("k", delivery.message_key("id"))
    seen = r.where("delivery_batch < 3").select("k").distinct()
    return r.where("delivery_batch >= 3").join(seen, "k", "left_anti").select("raw_offset")


def log_range(spark: SparkSession, d: str) -> DataFrame:
    """A stretch of the embedded log by offset: the filter reaches the files."""
    return table(spark, d, "articles_embedded").where("input_offset >= 100 AND input_offset < 300").select("input_offset", "article.id", "model_version")


def coverage_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = _raw(spark, d).groupBy("source_kind").agg(F.countDistinct("source_id").alias("sources"), F.countDistinct(tx.language_code(F.col("lang"))).alias("langs"))
    return s.select("source_kind", tx.coverage_sentence(F.col("sources"), F.col("langs")).alias("sentence"))


def speakable_sources(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("source_id").distinct().select("source_id", tx.speakable_source(F.col("source_id"), LANGS).alias("name"))


def redundant_summaries(spark: SparkSession, d: str) -> DataFrame:
    """How alike title and summary are, by their words."""
    j = tx.jaccard(tx.long_words(F.coalesce("title", F.lit(""))), tx.long_words(F.coalesce("summary", F.lit(""))))
    return _raw(spark, d).select("raw_offset", F.round(j, 6).alias("similarity")).where("similarity > 0.25")


QUERIES = {
    f.__name__: f
    for f in (
        canonical_urls, html_clean_text, truncated_summaries, articles_normalized, reject_outcomes, lang_resolution, url_sampling, domain_allowlist, source_counts,
        ingest_check, top_langs, fixture_stats, backfill_order, seen_anti_join, log_range, coverage_sentences, speakable_sources, redundant_summaries,
    )
}

_SQUEEZE = lambda x: rf"trim(regexp_replace({x}, '[\s]+', ' ', 'g'))"


def _clean(x: str) -> str:
    x = rf"regexp_replace({x}, '(?is)<(script|style)[^a-z0-9>][^>]*>.*?(</(script|style)[^>]*>|$)|<(script|style)>.*?(</(script|style)[^>]*>|$)', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?i)</?({'|'.join(tx.BLOCK_TAGS)})(\s[^>]*|/[^>]*)?>', ' ', 'g')"
    x = f"regexp_replace({x}, '<[A-Za-z/!?][^>]*>', '', 'g')"
    for name, char in tx.ENTITIES.items():
        x = "replace({}, '{}', '{}')".format(x, name, char.replace("'", "''"))
    return _SQUEEZE(x)


def _truncate(x: str, most: int) -> str:
    cut = f"substr({x}, 1, {most - 1})"
    last = f"list_last(string_split({cut}, ' '))"
    head = f"substr({cut}, 1, length({cut}) - length({last}) - 1)"
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE rtrim(CASE WHEN length({last}) < length({cut}) AND strlen({head}) > strlen({cut}) // 2 THEN {head} ELSE {cut} END) || '…' END"


_CODE = lambda x: "CASE WHEN b ~ '^[a-z]{2}$' AND b <> 'xx' THEN b WHEN b ~ '^[a-z]{3}$' THEN MAP {%s}[b] END".replace("b ", f"lower(regexp_split_to_array(trim({x}), '[-_]')[1]) ").replace("[b]", f"[lower(regexp_split_to_array(trim({x}), '[-_]')[1])]").replace("THEN b", f"THEN lower(regexp_split_to_array(trim({x}), '[-_]')[1])") % ", ".join(f"'{k}': '{v}'" for k, v in tx.THREE_LETTER.items())
_EVENT = "CASE WHEN published_at_ms IS NULL OR published_at_ms <= 0 OR published_at_ms > fetched_at_ms + 300000 THEN fetched_at_ms ELSE published_at_ms END"
_HOST = lambda u: rf"regexp_replace(lower(regexp_extract({u}, '(?i)^https?://([^/?#:]+)', 1)), '^www\.', '')"
_NORM = f"""n0 AS (
  SELECT raw_offset, source_id, source_kind, {_clean('title')} title, {_clean("coalesce(summary, '')")} s0, fetched_at_ms, published_at_ms, {_EVENT} event_ms,
    {_CODE('a.lang')} hint, (SELECT lang FROM feed_sources f WHERE f.source_id = split_part(a.source_id, ':', 1)) conf, 'https://' || {_HOST('url')} || regexp_extract(url, '^https?://[^/]+(/.*)$', 1) url
  FROM articles_raw a),
n AS (
  SELECT * EXCLUDE (s0), CASE WHEN {_truncate('s0', SUMMARY_LIMIT)} = title THEN '' ELSE {_truncate('s0', SUMMARY_LIMIT)} END summary,
    CASE WHEN conf IS NULL THEN coalesce(hint, 'und') ELSE conf END lang,
    CASE WHEN coalesce(title, '') = '' THEN 'missing_title' WHEN fetched_at_ms - event_ms > {MAX_AGE_MS} THEN 'too_old' ELSE 'accepted' END outcome FROM n0)"""

SQL = {
    "canonical_urls": rf"""WITH u AS (SELECT raw_offset, 'https://' || {_HOST('url')} || regexp_extract(url, '^https?://[^/]+(/[^?]*)', 1) || '?a=1&b=2' url FROM articles_raw)
SELECT raw_offset, url, substr(sha256(url), 1, 32) id, {_HOST('url')} host FROM u""",
    "html_clean_text": f"SELECT raw_offset, {_clean('summary')} summary FROM articles_raw",
    "truncated_summaries": f"WITH s AS (SELECT raw_offset, {_SQUEEZE('summary')} x FROM articles_raw) SELECT raw_offset, {_truncate('x', SUMMARY_LIMIT)} summary FROM s",
    "articles_normalized": f"""WITH {_NORM} SELECT raw_offset, substr(sha256(url), 1, 32) id, source_id, url, title, summary, event_ms published_at_ms, fetched_at_ms, lang,
  event_ms IS DISTINCT FROM published_at_ms event_time_corrected FROM n WHERE outcome = 'accepted'""",
    "reject_outcomes": f"WITH {_NORM} SELECT source_kind, outcome, count(*) n FROM n GROUP BY 1, 2",
    "lang_resolution": f"WITH {_NORM} SELECT lang, count(*) n, count(DISTINCT source_id) sources FROM n GROUP BY 1",
    "url_sampling": f"SELECT raw_offset, url FROM articles_raw WHERE ('0x' || substr(sha256(url), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615.0 < {SAMPLE}",
    "domain_allowlist": f"SELECT raw_offset FROM articles_raw WHERE {_HOST('url')} IN ('meridian.wire.example', 'culture.example') OR {_HOST('url')} LIKE '%.meridian.wire.example' OR {_HOST('url')} LIKE '%.culture.example'",
    "source_counts": """WITH n AS (SELECT split_part(source_id, ':', 1) source_id, count(*) articles, max(fetched_at_ms) last_fetched_ms FROM articles_raw GROUP BY 1)
SELECT source_id, category, poll_interval_s, coalesce(articles, 0) articles, last_fetched_ms FROM feed_sources LEFT JOIN n USING (source_id) WHERE enabled""",
    "ingest_check": f"""WITH e AS (SELECT *, {_EVENT} event_ms FROM articles_raw)
SELECT source_id, count(*) items, count(*) FILTER (WHERE fetched_at_ms - event_ms > {MAX_AGE_MS}) old, count(*) FILTER (WHERE coalesce(title, '') = '') bad,
  count(*) FILTER (WHERE event_ms IS DISTINCT FROM published_at_ms) fixed, min(fetched_at_ms - event_ms) newest_age_ms FROM e GROUP BY 1""",
    "top_langs": f"""WITH n AS (SELECT source_id, {_CODE('lang')} l, count(*) n FROM articles_raw GROUP BY 1, 2)
SELECT source_id, l lang, n, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, l) rank FROM n WHERE l IS NOT NULL QUALIFY rank <= 3""",
    "fixture_stats": """SELECT count(*) n, count(DISTINCT article.id) ids, min(article.published_at_ms) first_ms, max(article.published_at_ms) last_ms, count(DISTINCT article.lang) langs,
  count(DISTINCT article.source_id) sources, count(DISTINCT model_version) models, round(100.0 * count(*) FILTER (WHERE coalesce(article.summary, '') = '') / count(*), 6) no_summary_pct,
  round(100.0 * count(*) FILTER (WHERE article.event_time_corrected) / count(*), 6) corrected_pct, max(len(vector))::INT dim FROM articles_embedded""",
    "backfill_order": "SELECT raw_offset, id, fetched_at_ms FROM articles_raw WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY raw_offset) = 1 ORDER BY fetched_at_ms, id",
    "seen_anti_join": r"""WITH r AS (SELECT *, lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) k FROM articles_raw WHERE id IS NOT NULL)
SELECT raw_offset FROM r WHERE delivery_batch >= 3 AND k NOT IN (SELECT k FROM r WHERE delivery_batch < 3)""",
    "log_range": "SELECT input_offset, article.id id, model_version FROM articles_embedded WHERE input_offset >= 100 AND input_offset < 300",
    "coverage_sentences": f"""WITH c AS (SELECT source_kind, source_id, {_CODE('lang')} l FROM articles_raw), s AS (SELECT source_kind, count(DISTINCT source_id) s, count(DISTINCT l) l FROM c GROUP BY 1)
SELECT source_kind, CASE WHEN s = 1 THEN '1 source is' ELSE CASE WHEN s > 10 THEN 'More than ' || (s // 10 * 10)::VARCHAR ELSE s::VARCHAR END || ' sources' || CASE WHEN l > 1 THEN ' in ' || l::VARCHAR || ' languages are' ELSE ' are' END END || ' covering this story.' sentence FROM s""",
    "speakable_sources": f"""WITH s AS (SELECT DISTINCT source_id, string_split(source_id, '-') w FROM articles_raw),
k AS (SELECT source_id, CASE WHEN len(w) > 1 AND list_last(w) IN {LANGS} THEN w[:-2] ELSE w END w FROM s)
SELECT source_id, CASE WHEN source_id LIKE '%:%' THEN regexp_extract(source_id, '^[^:]*:(.*)$', 1) ELSE array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), ' ') END AS name FROM k""",
    "redundant_summaries": r"""WITH w AS (SELECT raw_offset, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^\p{L}\p{N}]+'), lambda x: length(x) > 2)) a,
  list_distinct(list_filter(regexp_split_to_array(lower(coalesce(summary, '')), '[^\p{L}\p{N}]+'), lambda x: length(x) > 2)) b FROM articles_raw),
j AS (SELECT raw_offset, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) END, 6) similarity FROM w)
SELECT * FROM j WHERE similarity > 0.25""",
}
