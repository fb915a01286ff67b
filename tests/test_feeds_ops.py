"""Change feed, lateness, deliveries: against plain Python, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import changefeed, delivery, lateness

FEED = "feed_pos long, input_offset long, seq int, kind string, story_id string, payload string"


def stand(events):
    table = {}
    for (o, s), (kind, story) in sorted({(o, s): (k, st) for _, o, s, k, st, _ in events if o is not None and s is not None}.items()):
        if kind == "created":
            table[story] = (o, s)
        elif kind == "updated" and story in table:
            table[story] = (o, s)
        elif kind == "closed":
            table.pop(story, None)
    return {(k, *v) for k, v in table.items()}


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_event_by_event(spark, seed):
    rng = random.Random(seed)
    ev = [(0, o, s, rng.choice(["created", "updated", "closed", "split", "article_added"]), f"s{rng.randrange(8) if rng.random() < 0.6 else 0}", "") for o in range(60) for s in range(rng.randrange(4))]
    ev += rng.choices(ev, k=40) + [(0, None, 1, "created", "x", ""), (0, 3, None, "created", "y", ""), (0, 99, 0, None, "z", ""), (0, 99, 1, "created", None, "")]
    rng.shuffle(ev)
    df = spark.createDataFrame([(i, *e[1:]) for i, e in enumerate(ev)], FEED)
    got = {tuple(r) for r in changefeed.replay(df).collect()}
    assert got == stand([e for e in ev if e[4] is not None])


def test_gap_holds_what_follows_until_the_feed_ends(spark):
    ev = [(0, 0, 0, "created", "a", ""), (1, 1, 0, "created", "b", ""), (2, 1, 2, "updated", "b", ""), (3, 2, 0, "closed", "a", "")]
    df = spark.createDataFrame(ev, FEED)
    assert {r.story_id for r in changefeed.replay(df, flush=False).collect()} == {"a"}
    assert {r.story_id for r in changefeed.replay(df).collect()} == {"b"}
    mark = changefeed.committed_watermark(changefeed.transactions(changefeed.distinct_events(df))).first()
    assert (mark.first_gap, mark.watermark) == (1, 0)
    whole = changefeed.committed_watermark(changefeed.transactions(changefeed.distinct_events(df.where("input_offset <> 1")))).first()
    assert (whole.first_gap, whole.watermark) == (None, 2)


def test_replay_releases_what_the_gap_held(spark):
    ev = [(0, 0, 0, "created", "a", ""), (1, 1, 0, "created", "b", ""), (2, 1, 2, "updated", "b", ""), (3, 2, 0, "closed", "a", ""), (4, 0, 1, "created", "c", ""), (5, 3, 0, "updated", "c", "")]
    df = spark.createDataFrame(ev, FEED)
    committed, held = changefeed.split(df)
    assert {(r.input_offset, r.seq) for r in committed.collect()} == {(0, 0), (0, 1)} and {(r.input_offset, r.seq) for r in held.collect()} == {(1, 0), (1, 2), (2, 0), (3, 0)}
    assert {tuple(r) for r in changefeed.replay(df).collect()} == stand(ev)
    committed, held = changefeed.split(df.where("input_offset = 1"))
    assert committed.count() == 0 and held.count() == 2


def test_empty_feed(spark):
    df = spark.createDataFrame([], FEED)
    assert changefeed.replay(df).count() == 0 and changefeed.replay(df, flush=False).count() == 0


def test_late_rows_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(lateness, "BLOCK", 7)
    monkeypatch.setattr(lateness, "SPAN", 3)
    rng = random.Random(5)
    rows = [(i * 2, rng.randrange(100) * 3_600_000 if rng.random() < 0.9 else None, rng.randrange(100) * 3_600_000) for i in range(300)]
    df = spark.createDataFrame([*rows, (None, 5, 5)], "raw_offset long, published_at_ms long, fetched_at_ms long")
    got = {r.raw_offset: (r.event_ms, r.late) for r in lateness.judge(df).collect()}
    top, want = -1, {}
    for o, p, f in rows:
        t = f if p is None or p <= 0 or p > f + 300_000 else p
        top = max(top, t)
        want[o] = (t, t < top - lateness.LATENESS_MS)
    assert got == want


def test_partials_merge_and_refuse_closed_periods(spark):
    S = "hour_ms long, batch long, n long, first_ms long, last_ms long"
    h = 3_600_000
    old = spark.createDataFrame([(0, 1, 2, 1, 5), (h, 1, 1, h, h)], S)
    new = spark.createDataFrame([(0, 2, 1, 0, 0), (h, 2, 4, h + 1, h + 9)], S)
    kept, refused = lateness.merge(old, new, closed_before_ms=h)
    assert [r.batch for r in refused.collect()] == [2] and kept.count() == 3
    assert {(r.hour_ms, r.n) for r in lateness.combine(kept).collect()} == {(0, 2), (h, 5)}
    again, _ = lateness.merge(kept, new, closed_before_ms=h)
    assert {(r.hour_ms, r.n) for r in lateness.combine(again).collect()} == {(0, 2), (h, 5)}
    fewer, _ = lateness.merge(kept, new.where("hour_ms = 0").withColumn("hour_ms", F.lit(2 * h).cast("long")), closed_before_ms=h)
    assert {(r.hour_ms, r.batch) for r in fewer.collect()} == {(0, 1), (h, 1), (2 * h, 2)}  # what the batch no longer has is gone
    assert {(r.hour_ms, r.n) for r in lateness.combine(kept, upto_batch=1).collect()} == {(0, 2), (h, 1)}


def test_one_copy_of_each_message(spark):
    S = "raw_offset long, id string, fetched_at_ms long, extra string"
    rows = [(1, "AB", 5, "x"), (2, " ab\t", 4, "y"), (3, "ab", 4, "z"), (4, None, 1, "n"), (5, None, 1, "n"), (6, "cd", None, "q"), (7, "cd", 9, "q"), (8, "ee", 1, "e")]
    df = spark.createDataFrame(rows, S)
    assert {r.raw_offset for r in delivery.redundant(df).collect()} == {1, 3, 6}
    assert {r.raw_offset for r in delivery.keep_one(df).collect()} == {2, 4, 5, 7, 8}
    twice = df.union(df.where("id = 'ee'"))  # the very same row again
    assert delivery.keep_one(twice).where("id = 'ee'").count() == 1
    assert delivery.keep_one(df.limit(0)).count() == 0
    assert {r.raw_offset for r in delivery.admit(df.where("raw_offset < 3"), df.where("raw_offset >= 3")).collect()} == {2, 4, 5, 7, 8}


def test_hot_identifier_is_ranked_in_parts(spark):
    df = spark.range(5_000).select(F.col("id").alias("raw_offset"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.lit(1).cast("long").alias("fetched_at_ms"))
    assert delivery.redundant(df).count() == 1_666
    assert delivery.keep_one(df).where("id = 'hot'").first().raw_offset == 0
