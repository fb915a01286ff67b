"""Replaying a change feed of stories into the table that stands at its end.

A transaction is all events of one input offset. The replay

1. drops repeats: events with the same (input_offset, seq) are one event;
2. assembles transactions and finds those with a gap in their sequence;
3. takes the committed watermark: the last offset before the first gap;
4. folds each story on its own. Only three maxima of a story matter (its last
   ``created``, ``updated`` and ``closed``), and maxima merge, so a story with
   a third of all events is aggregated before it is shuffled.

Up to the watermark the table is exposed as committed. ``flush`` ends the
feed: what was held back is then applied in order as well, since no missing
event can come any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("created", "updated", "closed")


def distinct_events(feed: DataFrame) -> DataFrame:
    """Columns input_offset, seq, kind, story_id, one row per pair of the first two.

    Events without an offset or sequence number have no place in the order and
    are left out. Of events that share a pair but differ, the lowest
    (kind, story_id) counts, nulls last.
    """
    e = feed.select(F.col("input_offset").cast("long").alias("input_offset"), F.col("seq").cast("long").alias("seq"), "kind", "story_id")
    pick = F.struct(F.col("kind").isNull(), "kind", F.col("story_id").isNull(), "story_id")
    one = e.where("input_offset IS NOT NULL AND seq IS NOT NULL").groupBy("input_offset", "seq").agg(F.min(pick).alias("e"))
    return one.select("input_offset", "seq", F.col("e.kind").alias("kind"), F.col("e.story_id").alias("story_id"))


def transactions(events: DataFrame) -> DataFrame:
    """input_offset, n_events, last_seq and ``complete``: sequence numbers run from 0 without a gap."""
    return events.groupBy("input_offset").agg(
        F.count("*").alias("n_events"), F.max("seq").alias("last_seq"), ((F.min("seq") == 0) & (F.count("*") == F.max("seq") + 1)).alias("complete")
    )


def committed_watermark(txns: DataFrame) -> DataFrame:
    """One row: ``first_gap``, the lowest incomplete offset (null if none), and
    ``watermark``, the highest offset before it (null if nothing is committed)."""
    gap = txns.where("NOT complete").agg(F.min("input_offset").alias("first_gap"))
    return (
        txns.join(F.broadcast(gap), F.col("first_gap").isNull() | (F.col("input_offset") < F.col("first_gap")), "right")
        .groupBy("first_gap").agg(F.max("input_offset").alias("watermark"))
    )


def _last(kind: str) -> Column:
    return F.max(F.when(F.col("kind") == kind, F.struct("input_offset", "seq"))).alias(kind)


def fold(events: DataFrame) -> DataFrame:
    """story_id, input_offset, seq of each story that stands after ``events``.

    A story stands if its last ``created`` comes after its last ``closed``. Its
    pair is then the later of its last ``created`` and last ``updated``: no
    update after that creation was without effect, and none before counts
    more. Events without a story change nothing.
    """
    return standing(maxima(events))


def maxima(events: DataFrame) -> DataFrame:
    """The last event of each kind of each story."""
    return events.where(F.col("kind").isin(*KINDS) & F.col("story_id").isNotNull()).groupBy("story_id").agg(*[_last(k) for k in KINDS])


def standing(s: DataFrame) -> DataFrame:
    s = s.where("created IS NOT NULL AND (closed IS NULL OR created > closed)").withColumn("at", F.greatest("created", "updated"))
    return s.select("story_id", "at.input_offset", "at.seq")


def split(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(committed, held): the different events up to the committed watermark, and those that a gap holds back."""
    events = distinct_events(feed)
    mark = F.broadcast(committed_watermark(transactions(events)).select("watermark"))
    judged = events.join(mark, F.col("input_offset") <= F.col("watermark"), "left")
    return judged.where("watermark IS NOT NULL").drop("watermark"), judged.where("watermark IS NULL").drop("watermark")


def replay(feed: DataFrame, flush: bool = True) -> DataFrame:
    """The stories standing at the feed's end, or, without ``flush``, at the committed watermark.

    At the end the held part is released: its maxima merge with those of the committed part.
    """
    committed, held = split(feed)
    if not flush:
        return fold(committed)
    both = maxima(committed).unionByName(maxima(held))
    return standing(both.groupBy("story_id").agg(*[F.max(k).alias(k) for k in KINDS]))
