"""Queries of a reader of the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators import detect, lateness, serving
from newsloom.operators import readmodel as rm
from newsloom.plans.stories import _ART, _J, _LOG, _MEM, _ST, REF_MS, _arrivals, _log
from newsloom.session import table

HITS, RANGE, WIDTH_MS = 60, (300, 900), 1_200_000


def _text() -> Column:
    return F.concat_ws(" ", "title", "summary")


def _detected(spark: SparkSession, d: str) -> DataFrame:
    return detect.detect(table(spark, d, "articles_raw"), table(spark, d, "lang_samples"), "raw_offset", _text())


def lang_detected(spark: SparkSession, d: str) -> DataFrame:
    """The language of each article as far as its words tell."""
    return _detected(spark, d)


def lang_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Configured, hinted or detected: sources without a language of their own are looked at first."""
    raw, sources = table(spark, d, "articles_raw"), table(spark, d, "feed_sources").select(F.col("source_id").alias("sid"), F.col("lang").alias("configured"))
    r = raw.select("raw_offset", tx.language_code(F.col("lang")).alias("hint"), F.substring_index("source_id", ":", 1).alias("sid")).join(sources, "sid", "left").join(_detected(spark, d), "raw_offset")
    return r.select("raw_offset", tx.resolve_language(F.col("configured"), F.col("hint"), F.col("detected"), F.col("configured").isNull()).alias("lang"))


def event_json(spark: SparkSession, d: str) -> DataFrame:
    return serving.event_json(_log(spark, d))


def event_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions written and read again, packed and unpacked."""
    e = _log(spark, d).select(F.concat_ws(":", "input_offset", "seq").alias("written"), "pos")
    p = e.select("written", serving.parse_position(F.col("written")).alias("p"), serving.unpack(F.col("pos")).alias("u"), "pos")
    return p.select("written", "pos", "p.offset", "p.seq", (F.col("p") == F.col("u")).alias("same"))


def language_bases(spark: SparkSession, d: str) -> DataFrame:
    """How labels read once region and old codes are taken off, and whether they name Spanish."""
    r = table(spark, d, "articles_raw").where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"))
    return r.select("lang", "n", serving.base_language(F.col("lang")).alias("base"), serving.same_language(F.col("lang"), F.lit("es-MX")).alias("spanish"))


def merged_stories(spark: SparkSession, d: str) -> DataFrame:
    return serving.merged_from(rm.lineage(_log(spark, d)))


def story_family(spark: SparkSession, d: str) -> DataFrame:
    return serving.family(_log(spark, d))


def positions(spark: SparkSession, d: str) -> DataFrame:
    """The latest position, one beyond the end, one of the log, and that of a time."""
    a = _arrivals(spark, d)
    asked = [("latest", serving.position(a)), ("beyond", serving.position(a, at=10**12)), ("at", serving.position(a, at=600)), ("as_of", serving.position(a, as_of_ms=REF_MS))]
    out = None
    for name, one in asked:
        one = one.select(F.lit(name).alias("asked"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def totals_all(spark: SparkSession, d: str) -> DataFrame:
    """All figures of the head line, one row."""
    e, a = _log(spark, d), table(spark, d, "articles_embedded").select("input_offset", "article.id", "article.lang", "article.source_id", "article.fetched_at_ms").where("id IS NOT NULL")
    one = a.groupBy("id").agg(F.min_by(F.struct("lang", "source_id", "fetched_at_ms", "input_offset"), "input_offset").alias("a")).select("id", "a.*")
    art = one.agg(
        F.count("*").alias("articles"), F.countDistinct("lang").alias("languages"), F.countDistinct("source_id").alias("sources"),
        F.min("fetched_at_ms").alias("first_ms"), F.max("fetched_at_ms").alias("last_ms"), F.coalesce(F.max("input_offset"), F.lit(-1)).alias("latest_offset"),
    )
    st = rm.stories(e).agg(F.count("*").alias("stories"), F.count_if(F.col("closed_offset").isNull()).alias("open_stories"))
    ev = e.agg(F.count_if(F.col("kind") == "split").alias("splits"), F.count_if(F.col("kind") == "merged").alias("merges"))
    mem = rm.memberships(e).where("to_offset IS NULL").agg(F.count_if("late").alias("late"), F.count_if("is_duplicate").alias("duplicates"))
    return art.join(st).join(ev).join(mem)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles_embedded").where("size(vector) = 64 AND article.id IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e30) AND exists(vector, x -> x <> 0)")
    a = rows.groupBy(F.col("article.id").alias("id")).agg(F.min_by("vector", "input_offset").alias("vector"), F.min("input_offset").alias("o"))
    asked = a.orderBy("o", "id").limit(1)
    return serving.search(a, asked, rm.memberships(_log(spark, d)).where("to_offset IS NULL"), "vector", HITS)


def article_search(spark: SparkSession, d: str) -> DataFrame:
    """The articles most like the log's first one, with their stories."""
    return _hits(spark, d)


def article_search_stories(spark: SparkSession, d: str) -> DataFrame:
    return serving.search_stories(_hits(spark, d), rm.stories(_log(spark, d)).where("closed_offset IS NULL"))


def late_replay_diff(spark: SparkSession, d: str) -> DataFrame:
    """Late articles of a range of the log, judged over all of it and judged again from the range alone."""
    a = table(spark, d, "articles_embedded").select("input_offset", "article.id", "article.published_at_ms", "article.fetched_at_ms").where("id IS NOT NULL")
    inside = a.where((F.col("input_offset") >= RANGE[0]) & (F.col("input_offset") < RANGE[1]))
    late = lambda df: lateness.judge(df, order="input_offset").where("late").select("id", "input_offset")
    return serving.late_diff(late(a.where(F.col("input_offset") < RANGE[1])).where(F.col("input_offset") >= RANGE[0]), late(inside), inside, "input_offset")


def rerun_windows(spark: SparkSession, d: str) -> DataFrame:
    """The hour of inputs that ends with each bucket of the timeline, were its buckets 20 minutes long."""
    return serving.windows_before(rm.timeline(_arrivals(spark, d), _log(spark, d), serving.clamped("buckets", 96)), WIDTH_MS)


def usage_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Texts read in each month, by its first day."""
    t = table(spark, d, "articles_raw").where("fetched_at_ms IS NOT NULL")
    month = F.date_format(F.trunc(F.to_date(F.timestamp_millis("fetched_at_ms")), "MM"), "yyyy-MM-dd")
    return t.groupBy(month.alias("month"), "source_kind").agg(F.sum(F.coalesce(F.length("title"), F.lit(0)) + F.coalesce(F.length("summary"), F.lit(0))).alias("characters"), F.count("*").alias("n"))


def source_order(spark: SparkSession, d: str) -> DataFrame:
    return serving.preferred(table(spark, d, "feed_sources").select("source_id", "category"), "source_id", "category", "meridian-wire", "general")


def newest_events(spark: SparkSession, d: str) -> DataFrame:
    """The newest 200 events, and of splits and merges the newest 30."""
    e = _log(spark, d).select("input_offset", "seq", "kind", "story_id")
    newest = lambda df, n: df.orderBy(F.desc("input_offset"), F.desc("seq")).limit(n)
    return newest(e, 200).withColumn("list", F.lit("all")).unionByName(newest(e.where("kind IN ('split', 'merged')"), 30).withColumn("list", F.lit("lineage")))


def title_words(spark: SparkSession, d: str) -> DataFrame:
    """When and where each word of a title begins, at 60 ms a character."""
    return serving.word_starts(table(spark, d, "articles_raw").select("raw_offset", "title"), "raw_offset", "title", 60)


def word_at_time(spark: SparkSession, d: str) -> DataFrame:
    """The word that is spoken two seconds into each title."""
    return serving.word_at(title_words(spark, d), "raw_offset", 2_000)


def evaluation_ranking(spark: SparkSession, d: str) -> DataFrame:
    from newsloom.plans.stories import _articles

    e = _log(spark, d)
    return serving.ranking(rm.memberships(e), _articles(spark, d), e)


QUERIES = {
    f.__name__: f
    for f in (
        lang_detected, lang_resolved, event_json, event_positions, language_bases, merged_stories, story_family, positions, totals_all, article_search, article_search_stories,
        late_replay_diff, rerun_windows, usage_by_month, source_order, newest_events, title_words, word_at_time, evaluation_ranking,
    )
}

_DET = f"""tok AS (SELECT raw_offset, unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', title, summary)), '{detect.WORDS}'))) word FROM articles_raw),
prof AS (SELECT word, min(lang) lang FROM (SELECT lang, unnest(list_distinct(regexp_extract_all(lower(text), '{detect.WORDS}'))) word FROM lang_samples WHERE lang IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT lang) = 1),
pts AS (SELECT raw_offset, lang, count(*) n FROM tok JOIN prof USING (word) GROUP BY 1, 2),
sure AS (SELECT raw_offset, lang detected, n, coalesce(lead(n) OVER w, 0) n2, row_number() OVER w r FROM pts WINDOW w AS (PARTITION BY raw_offset ORDER BY n DESC, lang DESC)),
det AS (SELECT a.raw_offset, s.detected FROM articles_raw a LEFT JOIN sure s ON s.raw_offset = a.raw_offset AND r = 1 AND n >= {detect.LEAST} AND n >= {detect.LEAD} * n2 AND n > n2)"""
_CODE = "CASE WHEN regexp_matches(b, '^[a-z]{2}$') AND b <> 'xx' THEN b WHEN regexp_matches(b, '^[a-z]{3}$') THEN map_extract(MAP " + str(tx.THREE_LETTER).replace("'", "'") + ", b)[1] END"
_ARRS = "arr AS (SELECT input_offset, article.fetched_at_ms fetched_at_ms FROM articles_embedded)"
_STRINGS = lambda f: f"coalesce(from_json(json_extract(payload, '$.{f}'), '[\"VARCHAR\"]'), [])"
_HEAD = "'offset': input_offset, 'seq': seq, 'event_time': event_time_ms, 'watermark': CASE WHEN watermark_ms > 0 THEN watermark_ms END, 'kind': kind"
_PARENT, _TARGET = f"coalesce({_J('parent_story_id')}, story_id)", f"coalesce({_J('target_story_id')}, story_id)"
_KIDS = "from_json(json_extract(payload, '$.children'), '[{\"story_id\": \"VARCHAR\", \"article_ids\": [\"VARCHAR\"]}]')"
_HITS = f"""a AS (SELECT article.id id, list_transform(vector, lambda x: x::DOUBLE) v, input_offset o FROM articles_embedded
  WHERE len(vector) = 64 AND article.id IS NOT NULL AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0
  QUALIFY row_number() OVER (PARTITION BY article.id ORDER BY input_offset) = 1),
q AS (SELECT v qv FROM a ORDER BY o, id LIMIT 1),
near AS (SELECT id, round(list_cosine_similarity(v, qv), 6) similarity FROM a, q ORDER BY 2 DESC, 1 LIMIT {HITS}),
cur AS (SELECT article_id, min(story_id) story_id FROM mem WHERE to_offset IS NULL GROUP BY 1),
found AS (SELECT row_number() OVER (ORDER BY similarity DESC, id) place, id, similarity, story_id FROM near LEFT JOIN cur ON article_id = id)"""
_LATE = lambda src: f"""SELECT * FROM (SELECT id, input_offset, ms < max(ms) OVER (ORDER BY input_offset ROWS UNBOUNDED PRECEDING) - 86400000 late FROM (
  SELECT input_offset, article.id id, CASE WHEN article.published_at_ms IS NULL OR article.published_at_ms <= 0 OR article.published_at_ms > article.fetched_at_ms + 300000
    THEN article.fetched_at_ms ELSE article.published_at_ms END ms FROM articles_embedded WHERE article.id IS NOT NULL AND {src})) WHERE late"""  # noqa: E731

_WORDS = r"""t AS (SELECT raw_offset, unnest(string_split_regex(title, '\s')) word, generate_subscripts(string_split_regex(title, '\s'), 1) k FROM articles_raw WHERE title IS NOT NULL),
u AS (SELECT *, coalesce(sum(length(word) + 1 + length(regexp_replace(word, '[^\x{10000}-\x{10FFFF}]', '', 'g'))) OVER w, 0)::BIGINT utf16, (coalesce(sum(length(word) + 1) OVER w, 0) * 60)::BIGINT start_ms FROM t
  WINDOW w AS (PARTITION BY raw_offset ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT raw_offset, row_number() OVER (PARTITION BY raw_offset ORDER BY k) - 1 place, word, utf16, start_ms FROM u WHERE word <> '')"""

SQL = {
    "title_words": f"WITH {_WORDS} SELECT * FROM x",
    "word_at_time": f"WITH {_WORDS} SELECT raw_offset, place, word FROM x WHERE start_ms <= 2000 QUALIFY row_number() OVER (PARTITION BY raw_offset ORDER BY place DESC) = 1",
    "evaluation_ranking": f"""WITH {_LOG}, {_MEM}, {_ART},
g AS (SELECT story_id id, count(DISTINCT source_id) sources, count(*) members FROM mem JOIN art ON art.id = article_id WHERE to_offset IS NULL GROUP BY 1),
j AS (SELECT {_J('article_id')} id, {_J('score')}::DOUBLE score, pos FROM ev WHERE kind = 'article_added')
SELECT 'stories' list, row_number() OVER (ORDER BY sources DESC, members DESC, id) place, id, sources, members, NULL::DOUBLE score FROM g QUALIFY place <= 20
UNION ALL SELECT 'joins', row_number() OVER (ORDER BY score, pos) place, id, NULL, NULL, score FROM j WHERE score IS NOT NULL AND id IS NOT NULL QUALIFY place <= 20""",
    "lang_detected": f"WITH {_DET} SELECT * FROM det",
    "lang_resolved": f"""WITH {_DET}, x AS (SELECT raw_offset, f.lang configured, lower(split_part(replace(trim(a.lang), '_', '-'), '-', 1)) b FROM articles_raw a LEFT JOIN feed_sources f ON f.source_id = split_part(a.source_id, ':', 1)),
h AS (SELECT raw_offset, configured, {_CODE} hint FROM x)
SELECT raw_offset, CASE WHEN configured IS NULL THEN coalesce(detected, hint, 'und') ELSE configured END lang FROM h JOIN det USING (raw_offset)""",
    "event_json": f"""WITH {_LOG.replace('story_id, payload FROM', 'story_id, payload, event_time_ms, watermark_ms FROM')}
SELECT input_offset, seq, kind, CASE kind WHEN 'split' THEN {_PARENT} WHEN 'merged' THEN {_TARGET} ELSE story_id END story_id, (CASE kind
  WHEN 'created' THEN to_json({{{_HEAD}, 'story_id': story_id, 'seed_article_id': {_J('seed_article_id')}, 'headline': {_J('headline')}, 'lang': {_J('lang')}, 'parent_ids': {_STRINGS('parent_story_ids')}}})
  WHEN 'article_added' THEN to_json({{{_HEAD}, 'story_id': story_id, 'article_id': {_J('article_id')}, 'score': {_J('score')}::DOUBLE, 'is_duplicate': {_J('is_duplicate')}::BOOLEAN, 'duplicate_of': {_J('duplicate_of')}, 'late': {_J('late')}::BOOLEAN}})
  WHEN 'updated' THEN to_json({{{_HEAD}, 'story_id': story_id, 'headline': {_J('headline')}, 'headline_article_id': {_J('headline_article_id')}, 'article_count': {_J('article_count')}::BIGINT, 'source_count': {_J('source_count')}::BIGINT, 'langs': {_STRINGS('langs')}}})
  WHEN 'split' THEN to_json({{{_HEAD}, 'story_id': {_PARENT}, 'children': list_transform(coalesce({_KIDS}, []), lambda c: {{'story_id': c.story_id, 'article_count': len(c.article_ids)}})}})
  WHEN 'merged' THEN to_json({{{_HEAD}, 'story_id': {_TARGET}, 'source_ids': {_STRINGS('source_story_ids')}}})
  WHEN 'closed' THEN to_json({{{_HEAD}, 'story_id': story_id, 'reason': CASE WHEN {_J('reason')} IN ('idle', 'merged', 'split') THEN {_J('reason')} ELSE 'unspecified' END}}) END)::VARCHAR payload
FROM ev WHERE kind IN ('created', 'article_added', 'updated', 'split', 'merged', 'closed')""",
    "event_positions": f"WITH {_LOG} SELECT input_offset || ':' || seq written, pos, input_offset \"offset\", seq, true same FROM ev",
    "language_bases": r"""WITH l AS (SELECT lang, count(*) n, regexp_replace(lang, '[-_].*$', '') b FROM articles_raw WHERE lang IS NOT NULL GROUP BY 1),
m AS (SELECT lang, n, CASE WHEN lower(b) IN ('nb', 'nn') THEN 'no' WHEN lower(b) = 'fil' THEN 'tl' ELSE b END base FROM l) SELECT *, lower(base) = 'es' spanish FROM m""",
    "merged_stories": f"""WITH {_LOG}, m AS (SELECT unnest(json_extract_string(payload, '$.source_story_ids[*]')) parent, {_J('target_story_id')} child, input_offset o FROM ev WHERE kind = 'merged'),
i AS (SELECT child story_id, string_agg(DISTINCT parent, ',' ORDER BY parent) merged_from FROM m GROUP BY 1), g AS (SELECT parent story_id, max_by(child, o) merged_into FROM m GROUP BY 1)
SELECT coalesce(i.story_id, g.story_id) story_id, coalesce(merged_from, '') merged_from, merged_into FROM i FULL JOIN g ON i.story_id = g.story_id""",
    "story_family": f"""WITH {_LOG}, c AS (SELECT unnest(json_extract_string(payload, '$.parent_story_ids[*]')) parent, story_id child, input_offset o FROM ev WHERE kind = 'created')
SELECT parent, child, min(o) child_offset FROM c GROUP BY 1, 2""",
    "positions": f"""WITH {_ARRS}, t AS (SELECT coalesce(max(input_offset), -1) latest FROM arr),
p AS (SELECT 'latest' asked, latest AS "at", latest FROM t UNION ALL SELECT 'beyond', latest, latest FROM t UNION ALL SELECT 'at', least(600, latest), latest FROM t
  UNION ALL SELECT 'as_of', coalesce((SELECT max(input_offset) FROM arr WHERE fetched_at_ms <= {REF_MS}), -1), latest FROM t)
SELECT asked, "at", (SELECT max(fetched_at_ms) FROM arr WHERE input_offset <= p."at") time_ms, latest, "at" >= latest live FROM p""",
    "totals_all": f"""WITH {_LOG}, {_ST}, {_MEM}, art AS (SELECT article.id id, article.lang lang, article.source_id source_id, article.fetched_at_ms f, input_offset o FROM articles_embedded
  WHERE article.id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY article.id ORDER BY input_offset) = 1)
SELECT (SELECT count(*) FROM art) articles, (SELECT count(DISTINCT lang) FROM art) languages, (SELECT count(DISTINCT source_id) FROM art) sources, (SELECT min(f) FROM art) first_ms, (SELECT max(f) FROM art) last_ms,
  (SELECT coalesce(max(o), -1) FROM art) latest_offset, (SELECT count(*) FROM st) stories, (SELECT count(*) FROM st WHERE closed_offset IS NULL) open_stories,
  (SELECT count(*) FROM ev WHERE kind = 'split') splits, (SELECT count(*) FROM ev WHERE kind = 'merged') merges,
  (SELECT count(*) FROM mem WHERE to_offset IS NULL AND late) late, (SELECT count(*) FROM mem WHERE to_offset IS NULL AND is_duplicate) duplicates""",
    "article_search": f"WITH {_LOG}, {_MEM}, {_HITS} SELECT * FROM found",
    "article_search_stories": f"""WITH {_LOG}, {_ST}, {_MEM}, {_HITS}, g AS (SELECT story_id, min(place) f, max(similarity) best, count(*) hits FROM found
  WHERE story_id IN (SELECT story_id FROM st WHERE closed_offset IS NULL) GROUP BY 1)
SELECT row_number() OVER (ORDER BY f)::INT place, story_id, best, hits, best >= {serving.STRONG} strong FROM g""",
    "late_replay_diff": f"""WITH o AS (SELECT id, row_number() OVER (ORDER BY input_offset) p FROM ({_LATE(f'input_offset < {RANGE[1]}')}) WHERE input_offset >= {RANGE[0]}),
r AS (SELECT id, row_number() OVER (ORDER BY input_offset) p FROM ({_LATE(f'input_offset >= {RANGE[0]} AND input_offset < {RANGE[1]}')}))
SELECT count(o.id) original, count(r.id) replayed, coalesce(bool_and(o.id IS NOT NULL AND r.id IS NOT NULL AND o.id = r.id), true) identical FROM o FULL JOIN r ON o.p = r.p""",
    "rerun_windows": f"""WITH {_ARRS}, b AS (SELECT min(fetched_at_ms) lo, max(fetched_at_ms) hi FROM arr WHERE fetched_at_ms IS NOT NULL),
per AS (SELECT (least((fetched_at_ms - lo) * 96 // greatest(hi - lo, 1), 95))::INT k, max(input_offset) top FROM arr, b WHERE fetched_at_ms IS NOT NULL GROUP BY 1),
t AS (SELECT g::INT bucket, max(top) OVER (ORDER BY g) u FROM range(96) t(g) LEFT JOIN per ON k = g)
SELECT bucket, coalesce((SELECT x.u + 1 FROM t x WHERE x.bucket = greatest(t.bucket + 1 - 3, 0) - 1), 0) from_offset, coalesce(u, -1) + 1 to_offset FROM t""",
    "usage_by_month": """SELECT strftime(date_trunc('month', make_timestamp(fetched_at_ms * 1000)), '%Y-%m-%d') AS month, source_kind, sum(coalesce(length(title), 0) + coalesce(length(summary), 0))::BIGINT characters, count(*) n
FROM articles_raw WHERE fetched_at_ms IS NOT NULL GROUP BY 1, 2""",
    "source_order": "SELECT source_id, category, row_number() OVER (ORDER BY source_id <> 'meridian-wire', coalesce(category <> 'general', true), source_id) place FROM feed_sources",
    "newest_events": f"""WITH {_LOG}, n AS (SELECT input_offset, seq, kind, story_id, row_number() OVER (ORDER BY input_offset DESC, seq DESC) r FROM ev),
l AS (SELECT input_offset, seq, kind, story_id, row_number() OVER (ORDER BY input_offset DESC, seq DESC) r FROM ev WHERE kind IN ('split', 'merged'))
SELECT input_offset, seq, kind, story_id, 'all' list FROM n WHERE r <= 200 UNION ALL SELECT input_offset, seq, kind, story_id, 'lineage' FROM l WHERE r <= 30""",
}
