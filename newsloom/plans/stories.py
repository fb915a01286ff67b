"""Queries over the read model folded from story_events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import briefing
from newsloom.operators import readmodel as rm
from newsloom.session import table

#: The position the as-of queries look at, and the time of the activity's end.
AT, REF_MS, BUCKETS = 600, 1772600000000, 96


def _log(spark: SparkSession, d: str) -> DataFrame:
    return rm.log(table(spark, d, "story_events"))


def _articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles of the embedded log, each id once, at its first offset."""
    a = table(spark, d, "articles_embedded").select("input_offset", "article.*").where("id IS NOT NULL")
    return a.groupBy("id").agg(F.min_by(F.struct("source_id", "lang", "published_at_ms", "fetched_at_ms", "title"), "input_offset").alias("a"), F.min("input_offset").alias("input_offset")).select("id", "input_offset", "a.*")


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles_embedded").select("input_offset", F.col("article.fetched_at_ms").alias("fetched_at_ms"))


def story_table(spark: SparkSession, d: str) -> DataFrame:
    return rm.stories(_log(spark, d))


def membership_intervals(spark: SparkSession, d: str) -> DataFrame:
    return rm.memberships(_log(spark, d)).select("article_id", "story_id", "from_offset", "to_offset", "late", "is_duplicate")


def _cards(spark: SparkSession, d: str, **options) -> DataFrame:
    e = _log(spark, d)
    return rm.story_cards(e, rm.memberships(e), _articles(spark, d), AT, **options)


def stories_as_of(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d)


def stories_recent(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d, sort="recent", min_sources=2)


def stories_by_size(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d, sort="size", langs=["es", "pt"])


def top_sources(spark: SparkSession, d: str) -> DataFrame:
    return rm.top_sources(rm.memberships(_log(spark, d)), _articles(spark, d), AT)


def activity_24h(spark: SparkSession, d: str) -> DataFrame:
    return rm.activity(rm.memberships(_log(spark, d)), _articles(spark, d), AT, REF_MS)


def timeline_buckets(spark: SparkSession, d: str) -> DataFrame:
    return rm.timeline(_arrivals(spark, d), _log(spark, d), BUCKETS)


def story_lineage(spark: SparkSession, d: str) -> DataFrame:
    return rm.lineage(_log(spark, d))


def story_events_page(spark: SparkSession, d: str) -> DataFrame:
    return rm.events_after(_log(spark, d), AT, 0, 100).select("input_offset", "seq", "kind", "story_id")


def offset_at_time(spark: SparkSession, d: str) -> DataFrame:
    return rm.offset_at(_arrivals(spark, d), REF_MS)


def event_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Events by kind and close reason."""
    return _log(spark, d).groupBy("kind", rm.field("reason").alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("story_id").alias("stories"))


def totals(spark: SparkSession, d: str) -> DataFrame:
    """Counts over everything, late and duplicate ones over current memberships."""
    e = _log(spark, d)
    m, s = rm.memberships(e).where("to_offset IS NULL"), rm.stories(e)
    a = m.agg(F.count("*").alias("memberships"), F.count_if("late").alias("late"), F.count_if("is_duplicate").alias("duplicates"))
    b = s.agg(F.count("*").alias("stories"), F.count_if(F.col("closed_offset").isNull()).alias("open_stories"))
    c = e.agg(F.count("*").alias("events"), F.max("input_offset").alias("last_offset"))
    return a.join(b).join(c)


def sink_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Next offset of each source kind: merged by the highest."""
    return table(spark, d, "articles_raw").groupBy("source_kind").agg((F.max("raw_offset") + 1).alias("next_offset"), F.count("*").alias("n"))


def topic_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows, different event ids, and ids that occur more than once, of the feed."""
    f = table(spark, d, "story_events").where("event_id IS NOT NULL AND event_id <> ''")
    g = f.groupBy("event_id").agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("events"), F.count("*").alias("ids"), F.count_if(F.col("n") > 1).alias("repeated"))


def replay_diff(spark: SparkSession, d: str) -> DataFrame:
    """The log against a replay in which the events of every 500th offset are lost."""
    e = _log(spark, d).select("input_offset", "seq", "kind", "story_id")
    return rm.diff(e, e.where("input_offset % 500 <> 499"), ["input_offset", "seq"], ["input_offset", "seq", "kind", "story_id"])


def briefings(spark: SparkSession, d: str) -> DataFrame:
    """A spoken briefing in English of every story that the log ever had open memberships in."""
    m = rm.memberships(_log(spark, d)).where("to_offset IS NULL").select("article_id", "story_id", F.coalesce("score", F.lit(1.0)).alias("score"))
    a = table(spark, d, "articles_embedded").select("input_offset", "article.*").where("title IS NOT NULL").groupBy("id").agg(F.min_by(F.struct("source_id", "lang", "title", "summary"), "input_offset").alias("a")).select("id", "a.*")
    return briefing.compose(m.join(a, m.article_id == a.id).select("story_id", "source_id", "lang", "title", "summary", "score"), "en")


QUERIES = {
    f.__name__: f
    for f in (
        story_table, membership_intervals, stories_as_of, stories_recent, stories_by_size, top_sources, activity_24h, timeline_buckets,
        story_lineage, story_events_page, offset_at_time, event_kinds, totals, sink_offsets, topic_check, replay_diff, briefings,
    )
}

_LOG = """RECURSIVE ev AS (
  SELECT input_offset, seq, input_offset * 1048576 + seq pos, kind, story_id, payload FROM story_events
  WHERE input_offset IS NOT NULL AND seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY input_offset, seq ORDER BY feed_pos) = 1)"""
_J = lambda f: f"nullif(json_extract_string(payload, '$.{f}'), '')"
_ST = f"""st AS (
  SELECT story_id, min(input_offset) FILTER (WHERE kind = 'created') created_offset,
    min_by({_J('lang')}, pos) FILTER (WHERE kind = 'created') seed_lang, min_by({_J('seed_article_id')}, pos) FILTER (WHERE kind = 'created') seed_article_id,
    max_by({_J('headline')}, pos) FILTER (WHERE kind IN ('created', 'updated')) headline,
    max_by({_J('article_count')}::BIGINT, pos) FILTER (WHERE kind = 'updated') article_count,
    max_by({_J('source_count')}::BIGINT, pos) FILTER (WHERE kind = 'updated') source_count,
    max(input_offset) FILTER (WHERE kind IN ('created', 'updated')) updated_offset,
    min(input_offset) FILTER (WHERE kind = 'closed') closed_offset, min_by({_J('reason')}, pos) FILTER (WHERE kind = 'closed') closed_reason
  FROM ev WHERE kind IN ('created', 'updated', 'closed') AND story_id IS NOT NULL GROUP BY 1 HAVING created_offset IS NOT NULL)"""
_MEM = f"""ends AS (
  SELECT * FROM (
    SELECT unnest(json_extract_string(payload, '$.source_story_ids[*]')) s, {_J('target_story_id')} target, pos end_pos, input_offset end_offset FROM ev WHERE kind = 'merged'
    UNION ALL SELECT coalesce({_J('parent_story_id')}, story_id), NULL, pos, input_offset FROM ev WHERE kind = 'split')
  QUALIFY row_number() OVER (PARTITION BY s ORDER BY end_pos) = 1),
opened AS (
  SELECT CASE kind WHEN 'created' THEN {_J('seed_article_id')} ELSE {_J('article_id')} END article_id, story_id, input_offset from_offset, pos from_pos,
    coalesce({_J('late')}::BOOLEAN, false) late, coalesce({_J('is_duplicate')}::BOOLEAN, false) is_duplicate
  FROM ev WHERE kind IN ('created', 'article_added') AND story_id IS NOT NULL),
given AS (
  SELECT s, end_pos, child.story_id child, unnest(child.article_ids) given_id FROM (
    SELECT coalesce({_J('parent_story_id')}, story_id) s, pos end_pos,
      unnest(from_json(json_extract(payload, '$.children'), '[{{"story_id": "VARCHAR", "article_ids": ["VARCHAR"]}}]')) child FROM ev WHERE kind = 'split')),
walk AS (
  SELECT o.*, e.end_offset to_offset, coalesce(e.target, g.child) target, e.end_pos FROM opened o LEFT JOIN ends e ON e.s = o.story_id AND e.end_pos > o.from_pos
  LEFT JOIN given g ON g.s = e.s AND g.end_pos = e.end_pos AND g.given_id = o.article_id WHERE o.article_id IS NOT NULL
  UNION ALL SELECT w.article_id, w.target, w.to_offset, w.end_pos, w.late, w.is_duplicate, e.end_offset, coalesce(e.target, g.child), e.end_pos
  FROM walk w LEFT JOIN ends e ON e.s = w.target AND e.end_pos > w.end_pos LEFT JOIN given g ON g.s = e.s AND g.end_pos = e.end_pos AND g.given_id = w.article_id WHERE w.target IS NOT NULL),
mem AS (
  SELECT article_id, story_id, from_offset, to_offset, late, is_duplicate FROM walk
  QUALIFY row_number() OVER (PARTITION BY article_id, story_id, from_offset ORDER BY from_pos) = 1)"""
_ART = """art AS (
  SELECT article.id id, article.source_id source_id, article.lang lang, article.published_at_ms published_at_ms FROM articles_embedded WHERE article.id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY article.id ORDER BY input_offset) = 1)"""
_BASE = f"WITH {_LOG}, {_ST}, {_MEM}, {_ART}"
_VALID = f"(from_offset <= {AT} AND (to_offset IS NULL OR to_offset > {AT}))"
_CARDS = f"""{_BASE}, past AS (SELECT * FROM ev WHERE input_offset <= {AT}),
alive AS (SELECT story_id, created_offset FROM st WHERE created_offset <= {AT} AND (closed_offset IS NULL OR closed_offset > {AT})),
c AS (
  SELECT story_id, count(*) articles, count(DISTINCT source_id) sources, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang), '') langs, max(published_at_ms) last_ms
  FROM mem JOIN art ON art.id = article_id WHERE {_VALID} AND story_id IN (SELECT story_id FROM alive) GROUP BY 1),
cards AS (
  SELECT alive.*, articles, sources, langs, last_ms, (SELECT max(input_offset) FROM past e WHERE e.story_id = alive.story_id) updated_offset,
    (SELECT max_by({_J('headline')}, pos) FROM past e WHERE e.story_id = alive.story_id AND kind IN ('created', 'updated')) headline FROM alive JOIN c USING (story_id))
SELECT * FROM cards"""
_WIDTH = "least((fetched_at_ms - lo) * {n} // greatest(hi - lo, 1), {n} - 1)".format(n=BUCKETS)

SQL = {
    "story_table": f"WITH {_LOG}, {_ST} SELECT * FROM st",
    "membership_intervals": f"WITH {_LOG}, {_MEM} SELECT * FROM mem",
    "stories_as_of": f"{_CARDS} WHERE sources >= 1 ORDER BY sources DESC, articles DESC, updated_offset DESC, story_id LIMIT 50",
    "stories_recent": f"{_CARDS} WHERE sources >= 2 ORDER BY updated_offset DESC, story_id LIMIT 50",
    "stories_by_size": f"{_CARDS} WHERE sources >= 1 AND list_has_any(string_split(langs, ','), ['es', 'pt']) ORDER BY articles DESC, sources DESC, updated_offset DESC, story_id LIMIT 50",
    "top_sources": f"""{_BASE}, n AS (SELECT story_id, source_id, count(*) n FROM mem JOIN art ON art.id = article_id WHERE {_VALID} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, source_id) rank FROM n) SELECT * FROM r WHERE rank <= 3""",
    "activity_24h": f"""{_BASE}, n AS (
  SELECT story_id, floor(({REF_MS} - published_at_ms) / 3600000) ago, count(*) n FROM mem JOIN art ON art.id = article_id
  WHERE {_VALID} AND published_at_ms IS NOT NULL GROUP BY 1, 2),
k AS (SELECT * FROM n WHERE ago BETWEEN 0 AND 23),
f AS (SELECT s.story_id, t.h, coalesce(k.n, 0) n FROM (SELECT DISTINCT story_id FROM mem JOIN art ON art.id = article_id WHERE {_VALID}) s CROSS JOIN range(24) t(h) LEFT JOIN k ON k.story_id = s.story_id AND k.ago = t.h)
SELECT story_id, string_agg(n::VARCHAR, ',' ORDER BY h DESC) activity FROM f GROUP BY 1""",
    "timeline_buckets": f"""WITH {_LOG}, arr AS (SELECT input_offset, article.fetched_at_ms fetched_at_ms FROM articles_embedded WHERE article.fetched_at_ms IS NOT NULL),
b AS (SELECT min(fetched_at_ms) lo, max(fetched_at_ms) hi FROM arr),
a AS (SELECT input_offset, ({_WIDTH})::INT bucket FROM arr, b),
per AS (SELECT bucket, max(input_offset) top, count(*) articles FROM a GROUP BY 1),
k AS (SELECT bucket, count(*) FILTER (WHERE kind = 'created') created, count(*) FILTER (WHERE kind = 'merged') merged,
  count(*) FILTER (WHERE kind = 'split') split, count(*) FILTER (WHERE kind = 'closed') closed FROM ev JOIN a USING (input_offset) GROUP BY 1)
SELECT g::INT bucket, max(top) OVER (ORDER BY g) upto_offset, coalesce(articles, 0) articles, coalesce(created, 0) created, coalesce(merged, 0) merged,
  coalesce(split, 0) split, coalesce(closed, 0) closed FROM range({BUCKETS}) t(g) LEFT JOIN per ON per.bucket = g LEFT JOIN k ON k.bucket = g""",
    "story_lineage": f"""WITH {_LOG}
SELECT coalesce({_J('parent_story_id')}, story_id) parent, unnest(json_extract_string(payload, '$.children[*].story_id')) child, kind, input_offset FROM ev WHERE kind = 'split'
UNION ALL SELECT unnest(json_extract_string(payload, '$.source_story_ids[*]')), {_J('target_story_id')}, kind, input_offset FROM ev WHERE kind = 'merged'""",
    "story_events_page": f"WITH {_LOG} SELECT input_offset, seq, kind, story_id FROM ev WHERE (input_offset, seq) > ({AT}, 0) ORDER BY input_offset, seq LIMIT 100",
    "offset_at_time": f"""SELECT coalesce(max(input_offset) FILTER (WHERE article.fetched_at_ms <= {REF_MS}), -1) upto,
  coalesce(min(input_offset) FILTER (WHERE article.fetched_at_ms >= {REF_MS}), max(input_offset) + 1) since FROM articles_embedded""",
    "event_kinds": f"WITH {_LOG} SELECT kind, {_J('reason')} reason, count(*) n, count(DISTINCT story_id) stories FROM ev GROUP BY 1, 2",
    "totals": f"""WITH {_LOG}, {_ST}, {_MEM}, cur AS (SELECT * FROM mem WHERE to_offset IS NULL)
SELECT (SELECT count(*) FROM cur) memberships, (SELECT count(*) FROM cur WHERE late) late, (SELECT count(*) FROM cur WHERE is_duplicate) duplicates,
  (SELECT count(*) FROM st) stories, (SELECT count(*) FROM st WHERE closed_offset IS NULL) open_stories, (SELECT count(*) FROM ev) events, (SELECT max(input_offset) FROM ev) last_offset""",
    "sink_offsets": "SELECT source_kind, max(raw_offset) + 1 next_offset, count(*) n FROM articles_raw GROUP BY 1",
    "topic_check": """WITH g AS (SELECT event_id, count(*) n FROM story_events WHERE event_id <> '' GROUP BY 1)
SELECT sum(n)::BIGINT events, count(*) ids, count(*) FILTER (WHERE n > 1) repeated FROM g""",
    "replay_diff": f"""WITH {_LOG}, a AS (SELECT row_number() OVER (ORDER BY input_offset, seq) - 1 place, (input_offset, seq, kind, story_id) v FROM ev),
b AS (SELECT row_number() OVER (ORDER BY input_offset, seq) - 1 place, (input_offset, seq, kind, story_id) v FROM ev WHERE input_offset % 500 <> 499),
j AS (SELECT coalesce(a.place, b.place) place, a.v av, b.v bv FROM a FULL JOIN b ON a.place = b.place)
SELECT coalesce(bool_and(av IS NOT NULL AND bv IS NOT NULL AND av = bv), true) identical, count(*) FILTER (WHERE av = bv) matched,
  min(place) FILTER (WHERE NOT coalesce(av = bv, false)) first_divergence, count(av) n_original, count(bv) n_replayed FROM j""",
}
