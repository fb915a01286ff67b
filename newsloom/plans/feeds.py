"""Queries over the logs: change feed, lateness, repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import changefeed, delivery, lateness
from newsloom.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.replay(table(spark, d, "story_events"))


def p3_committed(spark: SparkSession, d: str) -> DataFrame:
    """The table as exposed while the feed is still open."""
    return changefeed.replay(table(spark, d, "story_events"), flush=False)


def p3_transactions(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.transactions(changefeed.distinct_events(table(spark, d, "story_events")))


def p3_watermark(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.committed_watermark(p3_transactions(spark, d))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return lateness.judge(table(spark, d, "articles_raw").select("raw_offset", "delivery_batch", "published_at_ms", "fetched_at_ms"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("late").select("raw_offset", "hour_ms")


def p4_partials(spark: SparkSession, d: str) -> DataFrame:
    return lateness.partials(_judged(spark, d))


def p4_hourly(spark: SparkSession, d: str) -> DataFrame:
    return lateness.combine(p4_partials(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery.redundant(table(spark, d, "articles_raw")).select("raw_offset")


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    return delivery.keep_one(table(spark, d, "articles_raw").select("id", "fetched_at_ms", "raw_offset", "delivery_batch", "source_id", "title"))


def p5_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each batch stay and how many repeat a message."""
    singles, ranked = delivery.rank_copies(table(spark, d, "articles_raw").select("id", "fetched_at_ms", "raw_offset", "delivery_batch"), "id", ["fetched_at_ms", "raw_offset"])
    both = singles.withColumn("__kept", F.lit(True)).unionByName(ranked)
    return both.groupBy("delivery_batch").agg(F.count_if("__kept").alias("kept"), F.count_if(~F.col("__kept")).alias("dropped"))


QUERIES = {f.__name__: f for f in (p3_found, p3_committed, p3_transactions, p3_watermark, p4_found, p4_partials, p4_hourly, p5_found, p5_kept, p5_by_batch)}

_EVENTS = """ev AS (
  SELECT input_offset, seq, min_by(kind, feed_pos) kind, min_by(story_id, feed_pos) story_id
  FROM story_events WHERE input_offset IS NOT NULL AND seq IS NOT NULL GROUP BY 1, 2)"""
_TXNS = """tx AS (
  SELECT input_offset, count(*) n_events, max(seq)::BIGINT last_seq, min(seq) = 0 AND count(*) = max(seq) + 1 complete FROM ev GROUP BY 1)"""
_MARK = """mk AS (
  SELECT (SELECT min(input_offset) FROM tx WHERE NOT complete) first_gap,
    (SELECT max(input_offset) FROM tx WHERE input_offset < coalesce((SELECT min(input_offset) FROM tx WHERE NOT complete), 9223372036854775807)) watermark)"""


def _standing(source: str) -> str:
    """Which stories stand, told event by event: windows number each story's creations and closings in order."""
    return f"""o AS (
  SELECT *, max(CASE WHEN kind = 'closed' THEN (input_offset, seq) END) OVER w closed_at FROM {source} WHERE kind IN ('created', 'updated', 'closed') AND story_id IS NOT NULL
  WINDOW w AS (PARTITION BY story_id)),
life AS (
  SELECT * FROM o WHERE kind <> 'closed' AND (closed_at IS NULL OR (input_offset, seq) > closed_at)),
born AS (SELECT story_id, min((input_offset, seq)) b FROM life WHERE kind = 'created' GROUP BY 1),
last AS (
  SELECT l.story_id, l.input_offset, l.seq::BIGINT seq, row_number() OVER (PARTITION BY l.story_id ORDER BY l.input_offset DESC, l.seq DESC) r
  FROM life l JOIN born USING (story_id) WHERE (l.input_offset, l.seq) >= b)
SELECT story_id, input_offset, seq FROM last WHERE r = 1"""


_JUDGED = """t AS (
  SELECT raw_offset, delivery_batch, CASE WHEN published_at_ms IS NULL OR published_at_ms <= 0 OR published_at_ms > fetched_at_ms + 300000
    THEN fetched_at_ms ELSE published_at_ms END event_ms FROM articles_raw WHERE raw_offset IS NOT NULL),
j AS (
  SELECT *, (event_ms // 3600000) * 3600000 hour_ms,
    coalesce(event_ms < max(event_ms) OVER (ORDER BY raw_offset ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 86400000, false) late FROM t)"""
_PARTS = """parts AS (
  SELECT hour_ms, delivery_batch batch, count(*) n, min(event_ms) first_ms, max(event_ms) last_ms FROM j WHERE NOT late AND hour_ms IS NOT NULL GROUP BY 1, 2)"""
_RANKED = r"""r AS (
  SELECT *, CASE WHEN id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) ORDER BY fetched_at_ms NULLS LAST, raw_offset) END rk
  FROM articles_raw)"""

SQL = {
    "p3_found": f"WITH {_EVENTS}, {_standing('ev')}",
    "p3_committed": f"WITH {_EVENTS}, {_TXNS}, {_MARK}, e2 AS (SELECT * FROM ev WHERE input_offset <= (SELECT watermark FROM mk)), {_standing('e2')}",
    "p3_transactions": f"WITH {_EVENTS}, {_TXNS} SELECT * FROM tx",
    "p3_watermark": f"WITH {_EVENTS}, {_TXNS}, {_MARK} SELECT * FROM mk",
    "p4_found": f"WITH {_JUDGED} SELECT raw_offset, hour_ms FROM j WHERE late",
    "p4_partials": f"WITH {_JUDGED}, {_PARTS} SELECT * FROM parts",
    "p4_hourly": f"WITH {_JUDGED}, {_PARTS} SELECT hour_ms, sum(n)::BIGINT n, min(first_ms) first_ms, max(last_ms) last_ms, count(*) batches FROM parts GROUP BY 1",
    "p5_found": f"WITH {_RANKED} SELECT raw_offset FROM r WHERE rk > 1",
    "p5_kept": f"WITH {_RANKED} SELECT id, fetched_at_ms, raw_offset, delivery_batch, source_id, title FROM r WHERE rk = 1",
    "p5_by_batch": f"WITH {_RANKED} SELECT delivery_batch, count(*) FILTER (WHERE rk = 1) kept, count(*) FILTER (WHERE rk > 1) dropped FROM r GROUP BY 1",
}
