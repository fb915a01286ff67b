"""Event-time queries: windows, watermarks, runs, usage, lag; and the story engine over the embedded log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators import lateness
from newsloom.session import table
from newsloom.streaming import stories


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _ms(c: str) -> Column:
    return F.unix_millis(c)


def tumbling_10m(spark: SparkSession, d: str) -> DataFrame:
    g = _events(spark, d).groupBy(F.window("ts", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n", "total")


def sliding_30m(spark: SparkSession, d: str) -> DataFrame:
    g = _events(spark, d).groupBy(F.window("ts", "30 minutes", "10 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.unix_millis("w.start").alias("start_ms"), "n")


def session_6h(spark: SparkSession, d: str) -> DataFrame:
    g = _events(spark, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n")


def watermark_late(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each source come out of order, and how many behind the watermark."""
    j = lateness.judge(table(spark, d, "articles_raw").select("raw_offset", "source_id", "published_at_ms", "fetched_at_ms"))
    return j.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_ms") < F.col("watermark_ms") + lateness.LATENESS_MS).alias("out_of_order"), F.count_if("late").alias("late"))


def idle_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of three or more hours in a row without any event of a user."""
    n = _events(spark, d).groupBy("user_id", F.floor(_ms("ts") / 3_600_000).alias("h")).agg(F.count("*").alias("n"))
    gap = n.withColumn("next", F.lead("h").over(Window.partitionBy("user_id").orderBy("h")))
    return gap.where("next - h > 3").select("user_id", (F.col("h") + 1).alias("from_hour"), (F.col("next") - F.col("h") - 1).alias("hours"))


def hysteresis_confirm(spark: SparkSession, d: str) -> DataFrame:
    """Hours from which on a user's activity has been high twice in a row: gaps and islands."""
    h = _events(spark, d).groupBy("user_id", F.floor(_ms("ts") / 86_400_000).alias("day")).agg(F.sum("value").alias("v")).where("v >= 20")
    w = Window.partitionBy("user_id").orderBy("day")
    i = h.withColumn("island", F.col("day") - F.row_number().over(w))
    n = i.withColumn("nth", F.row_number().over(Window.partitionBy("user_id", "island").orderBy("day")))
    return n.where("nth = 2").select("user_id", "day")


def usage_by_day(spark: SparkSession, d: str) -> DataFrame:
    g = _events(spark, d).groupBy(F.unix_date(F.to_date("ts")).alias("day"), "event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n"))
    return g


def offset_lag(spark: SparkSession, d: str) -> DataFrame:
    """How far the consumers of each source kind are behind: end of the log less the next offset, marker taken off, never below 0."""
    end = table(spark, d, "articles_raw").agg((F.max("raw_offset") + 1).alias("end"))
    done = table(spark, d, "articles_raw").where("delivery_batch < 10").groupBy("source_kind").agg((F.max("raw_offset") + 1).alias("next"))
    return done.join(F.broadcast(end)).select("source_kind", F.greatest(F.col("end") - F.col("next") - 1, F.lit(0)).alias("lag"))


def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Highest event time so far at each delivery batch's end."""
    j = lateness.judge(table(spark, d, "articles_raw").select("raw_offset", "delivery_batch", "published_at_ms", "fetched_at_ms"))
    return j.groupBy("delivery_batch").agg(F.max("watermark_ms").alias("watermark_ms"))


def story_engine_events(spark: SparkSession, d: str) -> DataFrame:
    """What the sequential engine makes of the embedded log."""
    return stories.events_of(stories.run_batch(stories.inputs(table(spark, d, "articles_embedded"))))


def story_engine_outcomes(spark: SparkSession, d: str) -> DataFrame:
    r = stories.run_batch(stories.inputs(table(spark, d, "articles_embedded")), tell=False)
    return stories.outcomes_of(r).groupBy("outcome", "late").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        tumbling_10m, sliding_30m, session_6h, watermark_late, idle_runs, hysteresis_confirm, usage_by_day, offset_lag, running_offsets,
        story_engine_events, story_engine_outcomes,
    )
}

_E = "e AS (SELECT *, epoch_ms(ts) ms, epoch_us(ts) us FROM events)"
_T = """t AS (SELECT raw_offset, source_id, delivery_batch, CASE WHEN published_at_ms IS NULL OR published_at_ms <= 0 OR published_at_ms > fetched_at_ms + 300000 THEN fetched_at_ms ELSE published_at_ms END ev FROM articles_raw),
j AS (SELECT *, max(ev) OVER (ORDER BY raw_offset ROWS UNBOUNDED PRECEDING) top FROM t)"""

SQL = {
    "tumbling_10m": f"WITH {_E} SELECT ms // 600000 * 600000 start_ms, event_type, count(*) n, round(sum(value), 6) total FROM e GROUP BY 1, 2",
    "sliding_30m": f"WITH {_E} SELECT (ms // 600000 - k) * 600000 start_ms, count(*) n FROM e, range(3) r(k) GROUP BY 1",
    "session_6h": f"""WITH {_E}, g AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > 21600000000, true)::INT f FROM e),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) s FROM g)
SELECT user_id, min(us) // 1000 start_ms, (max(us) + 21600000000) // 1000 end_ms, count(*) n FROM s GROUP BY user_id, s""",
    "watermark_late": f"WITH {_T} SELECT source_id, count(*) n, count(*) FILTER (WHERE ev < top) out_of_order, count(*) FILTER (WHERE ev < top - 86400000) late FROM j GROUP BY 1",
    "idle_runs": f"""WITH {_E}, h AS (SELECT DISTINCT user_id, ms // 3600000 h FROM e), g AS (SELECT *, lead(h) OVER (PARTITION BY user_id ORDER BY h) nx FROM h)
SELECT user_id, h + 1 from_hour, nx - h - 1 AS hours FROM g WHERE nx - h > 3""",
    "hysteresis_confirm": f"""WITH {_E}, h AS (SELECT user_id, ms // 86400000 AS day FROM e GROUP BY 1, 2 HAVING sum(value) >= 20), p AS (SELECT *, lag(day) OVER w p1, lag(day, 2) OVER w p2 FROM h WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day FROM p WHERE p1 = day - 1 AND p2 IS DISTINCT FROM day - 2""",
    "usage_by_day": f"WITH {_E} SELECT (ms // 86400000)::INT AS day, event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT k, count(*) n FROM e GROUP BY 1, 2",
    "offset_lag": """SELECT source_kind, greatest((SELECT max(raw_offset) + 1 FROM articles_raw) - max(raw_offset) - 1 - 1, 0) lag FROM articles_raw WHERE delivery_batch < 10 GROUP BY 1""",
    "running_offsets": f"WITH {_T} SELECT delivery_batch, max(top) - 86400000 watermark_ms FROM j GROUP BY 1",
}
