"""Tables folded from the event log, and the questions asked of them at a log position.

A position is ``offset << 20 | seq``. Every table is derived by aggregates and
windows from the log; nothing is updated in place. Memberships are half-open
intervals ``[from_offset, to_offset)``.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import Stages

HOUR_MS = 3_600_000


def pack(offset: str = "input_offset", seq: str = "seq") -> Column:
    return F.shiftleft(F.col(offset).cast("long"), 20).bitwiseOR(F.col(seq).cast("long"))


def log(feed: DataFrame) -> DataFrame:
    """The feed as a log: one row per (input_offset, seq), the first that arrived; rows without a place are left out."""
    cols = ["kind", "story_id", "payload", "event_time_ms", "watermark_ms"]
    e = feed.where("input_offset IS NOT NULL AND seq IS NOT NULL").groupBy("input_offset", "seq").agg(F.min_by(F.struct(*cols), "feed_pos").alias("e"))
    return e.select("input_offset", "seq", pack().alias("pos"), "e.*")


def field(name: str) -> Column:
    """A field of the payload as text; null where it is missing or empty."""
    return F.nullif(F.get_json_object("payload", f"$.{name}"), F.lit(""))


def stories(events: DataFrame) -> DataFrame:
    """One row per story ever created: its creation, its latest state and its first closing."""
    at = lambda kind, value, pick=F.max_by: pick(F.when(F.col("kind") == kind, value), F.when(F.col("kind") == kind, F.col("pos")))
    s = events.where(F.col("kind").isin("created", "updated", "closed") & F.col("story_id").isNotNull()).groupBy("story_id")
    s = s.agg(
        at("created", F.col("input_offset"), F.min_by).alias("created_offset"),
        at("created", field("lang"), F.min_by).alias("seed_lang"),
        at("created", field("seed_article_id"), F.min_by).alias("seed_article_id"),
        F.max_by(F.when(F.col("kind") != "closed", field("headline")), F.when(F.col("kind") != "closed", F.col("pos"))).alias("headline"),
        at("updated", field("article_count").cast("long")).alias("article_count"),
        at("updated", field("source_count").cast("long")).alias("source_count"),
        F.max(F.when(F.col("kind") != "closed", F.col("input_offset"))).alias("updated_offset"),
        at("closed", F.col("input_offset"), F.min_by).alias("closed_offset"),
        at("closed", field("reason"), F.min_by).alias("closed_reason"),
    )
    return s.where("created_offset IS NOT NULL")


def alive(at: int | Column) -> Column:
    return (F.col("created_offset") <= at) & (F.col("closed_offset").isNull() | (F.col("closed_offset") > at))


def valid(at: int | Column) -> Column:
    return (F.col("from_offset") <= at) & (F.col("to_offset").isNull() | (F.col("to_offset") > at))


def memberships(events: DataFrame) -> DataFrame:
    """article_id, story_id, from_offset, to_offset, late, is_duplicate, score.

    An article joins by ``created`` (as the seed) or ``article_added``. When
    its story is merged, the membership ends and a new one opens in the
    target; when it is split, it ends and opens in the child whose
    ``article_ids`` name it, if one does. Chains are followed level by level,
    each a join over what moved in the level before; a level lies later in the
    log than the one before, so they come to an end. Of two memberships that
    open alike, the one that opens first in the log counts, as for a child's
    seed that the split has moved already.
    """
    opened = events.where(F.col("kind").isin("created", "article_added")).select(
        F.when(F.col("kind") == "created", field("seed_article_id")).otherwise(field("article_id")).alias("article_id"), "story_id", F.col("input_offset").alias("from_offset"),
        F.col("pos").alias("from_pos"), F.coalesce(field("late").cast("boolean"), F.lit(False)).alias("late"),
        F.coalesce(field("is_duplicate").cast("boolean"), F.lit(False)).alias("is_duplicate"), field("score").cast("double").alias("score"),
    ).where("article_id IS NOT NULL AND story_id IS NOT NULL")
    sources = F.from_json(F.get_json_object("payload", "$.source_story_ids"), "array<string>")
    merged = events.where("kind = 'merged'").select(F.explode(sources).alias("s"), field("target_story_id").alias("target"), F.col("pos").alias("end_pos"), F.col("input_offset").alias("end_offset"))
    parent = F.coalesce(field("parent_story_id"), "story_id").alias("s")
    split = events.where("kind = 'split'").select(parent, F.lit(None).cast("string").alias("target"), F.col("pos").alias("end_pos"), F.col("input_offset").alias("end_offset"))
    children = F.from_json(F.get_json_object("payload", "$.children"), "array<struct<story_id:string,article_ids:array<string>>>")
    given = events.where("kind = 'split'").select(parent, F.col("pos").alias("end_pos"), F.inline(children).alias("child", "articles"))
    given = given.select("s", "end_pos", "child", F.explode("articles").alias("article_id"))
    w = Window.partitionBy("s").orderBy("end_pos")
    ends = merged.unionByName(split).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    stages = Stages(events.sparkSession, "memberships")
    ends, given = stages.write(ends, "ends"), stages.write(given, "given")
    level, out = opened, None
    for i in itertools.count():
        placed = level.join(ends, (F.col("story_id") == F.col("s")) & (F.col("end_pos") > F.col("from_pos")), "left").drop("s")
        placed = stages.write(placed.join(given.withColumnRenamed("s", "story_id"), ["story_id", "end_pos", "article_id"], "left"), f"level{i}")
        done = placed.select("article_id", "story_id", "from_offset", "from_pos", F.col("end_offset").alias("to_offset"), "late", "is_duplicate", "score")
        out = done if out is None else out.unionByName(done)
        to = F.coalesce("target", "child")
        moved = placed.where(to.isNotNull()).select("article_id", to.alias("story_id"), F.col("end_offset").alias("from_offset"), F.col("end_pos").alias("from_pos"), "late", "is_duplicate", "score")
        if not moved.limit(1).count():
            break
        level = moved
    rest = F.struct("to_offset", "late", "is_duplicate", "score")
    one = out.groupBy("article_id", "story_id", "from_offset").agg(F.min_by(rest, "from_pos").alias("m"))
    return one.select("article_id", "story_id", "from_offset", "m.*")


def story_cards(events: DataFrame, mem: DataFrame, articles: DataFrame, at: int, min_sources: int = 1, langs: list[str] | None = None, sort: str = "sources", limit: int = 50) -> DataFrame:
    """The ranked stories as of a position: alive then, with the headline and the last event of then, and counts over memberships valid then.

    ``sort``: sources, size or recent, which is by the last event. Stories
    without any valid membership are not shown.
    """
    past = events.where(F.col("input_offset") <= at)
    then = stories(past).where(alive(at)).select("story_id", "headline", "created_offset")
    m = mem.where(valid(at)).join(then.select("story_id"), "story_id", "left_semi").join(articles.select(F.col("id").alias("article_id"), "source_id", "lang", "published_at_ms"), "article_id")
    c = m.groupBy("story_id").agg(
        F.count("*").alias("articles"), F.countDistinct("source_id").alias("sources"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.max("published_at_ms").alias("last_ms")
    )
    last = past.groupBy("story_id").agg(F.max("input_offset").alias("updated_offset"))
    r = then.join(c, "story_id").join(last, "story_id").where(F.col("sources") >= min_sources)
    if langs:
        r = r.where(F.arrays_overlap(F.split("langs", ","), F.array(*map(F.lit, langs))))
    order = {"sources": ["sources", "articles", "updated_offset"], "size": ["articles", "sources", "updated_offset"], "recent": ["updated_offset"]}[sort]
    return r.orderBy(*[F.desc(x) for x in order], "story_id").limit(limit)


def top_sources(mem: DataFrame, articles: DataFrame, at: int, top: int = 3) -> DataFrame:
    m = mem.where(valid(at)).join(articles.select(F.col("id").alias("article_id"), "source_id"), "article_id")
    n = m.groupBy("story_id", "source_id").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("n"), "source_id"))).where(F.col("rank") <= top)


def activity(mem: DataFrame, articles: DataFrame, at: int, ref_ms: int, hours: int = 24) -> DataFrame:
    """Articles of each story in each of the last ``hours`` before ``ref_ms``, oldest first, zeros filled, as one text; of every story with a valid membership."""
    m = mem.where(valid(at)).join(articles.select(F.col("id").alias("article_id"), "published_at_ms"), "article_id")
    ago = F.floor((F.lit(ref_ms) - F.col("published_at_ms")) / HOUR_MS).cast("int")
    n = m.withColumn("ago", F.when(ago.between(0, hours - 1), ago)).groupBy("story_id", "ago").agg(F.count("*").alias("n"))
    by = n.groupBy("story_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("ago").isNotNull(), F.struct("ago", "n")))).alias("m"))
    slots = F.transform(F.sequence(F.lit(hours - 1), F.lit(0)), lambda h: F.coalesce(F.try_element_at("m", h.cast("int")), F.lit(0)).cast("string"))
    return by.select("story_id", F.array_join(slots, ",").alias("activity"))


def timeline(arrivals: DataFrame, events: DataFrame, buckets: int) -> DataFrame:
    """``buckets`` equal stretches of fetch time: arrivals, events by kind, and the highest offset so far, carried over empty buckets."""
    b = arrivals.where("fetched_at_ms IS NOT NULL").agg(F.min("fetched_at_ms").alias("lo"), F.max("fetched_at_ms").alias("hi"))
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    place = F.least(F.floor((F.col("fetched_at_ms") - F.col("lo")) * buckets / width), F.lit(buckets - 1)).cast("int")
    a = arrivals.where("fetched_at_ms IS NOT NULL").select("input_offset", "fetched_at_ms").crossJoin(F.broadcast(b)).select("input_offset", place.alias("bucket"))
    per = a.groupBy("bucket").agg(F.max("input_offset").alias("top"), F.count("*").alias("articles"))
    kinds = events.join(a, "input_offset").groupBy("bucket").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("created", "merged", "split", "closed")])
    dense = events.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    out = dense.join(per, "bucket", "left").join(kinds, "bucket", "left")
    run = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("articles", "created", "merged", "split", "closed")]
    return out.select("bucket", F.max("top").over(run).alias("upto_offset"), *zero)


def lineage(events: DataFrame) -> DataFrame:
    """(parent, child, kind, input_offset) of splits and merges."""
    children = F.from_json(F.get_json_object("payload", "$.children"), "array<struct<story_id:string>>")
    s = events.where("kind = 'split'").select(F.coalesce(field("parent_story_id"), "story_id").alias("parent"), F.explode(children["story_id"]).alias("child"), "kind", "input_offset")
    sources = F.from_json(F.get_json_object("payload", "$.source_story_ids"), "array<string>")
    m = events.where("kind = 'merged'").select(F.explode(sources).alias("parent"), field("target_story_id").alias("child"), "kind", "input_offset")
    return s.unionByName(m)


def events_after(events: DataFrame, offset: int, seq: int, limit: int) -> DataFrame:
    """The next page of the log behind a position."""
    after = F.struct(F.col("input_offset").cast("long"), F.col("seq").cast("long")) > F.struct(F.lit(offset).cast("long"), F.lit(seq).cast("long"))
    return events.where(after).orderBy("input_offset", "seq").limit(limit)


def offset_at(arrivals: DataFrame, time_ms: int) -> DataFrame:
    """The last offset fetched up to a time, -1 if none; and the first from it on, one past the end if none."""
    return arrivals.agg(
        F.coalesce(F.max(F.when(F.col("fetched_at_ms") <= time_ms, F.col("input_offset"))), F.lit(-1)).alias("upto"),
        F.coalesce(F.min(F.when(F.col("fetched_at_ms") >= time_ms, F.col("input_offset"))), F.max("input_offset") + 1).alias("since"),
    )


def diff(original: DataFrame, replayed: DataFrame, order: list[str], value: list[str]) -> DataFrame:
    """One row: how two ordered sequences compare, row by row at equal places.

    identical, matched, first_divergence (null if none), n_original, n_replayed.
    Places are numbered by sorted ranges, so no task holds a whole sequence.
    """
    a, b = (numbered(x, order).select("place", F.struct(*value).alias(n)) for x, n in ((original, "a"), (replayed, "b")))
    j = a.join(b, "place", "full")
    same = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("a").eqNullSafe(F.col("b"))
    return j.agg(
        F.coalesce(F.bool_and(same), F.lit(True)).alias("identical"), F.count_if(same).alias("matched"), F.min(F.when(~same, F.col("place"))).alias("first_divergence"),
        F.count("a").alias("n_original"), F.count("b").alias("n_replayed"),
    )


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``place``, 0-based in the order of the columns: ranks within sorted ranges, plus the sizes of the ranges before."""
    parts = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    parts = Stages(df.sparkSession, "numbered").write(parts, "ranges")
    before = parts.groupBy("__p").agg(F.count("*").alias("n")).withColumn("__b", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__b")
    r = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return parts.withColumn("__r", r).join(F.broadcast(before), "__p").withColumn("place", F.col("__r") + F.col("__b")).drop("__p", "__r", "__b")
