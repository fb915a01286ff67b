"""What readers ask, the seam of the model, and streams that are followed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import detect, embedding, serving
from newsloom.operators import readmodel as rm
from newsloom.sources import feeds, logs
from newsloom.streaming import jobs, live


def test_positions(spark):
    a = spark.createDataFrame([(0, 100), (1, 90), (5, 300), (3, None)], "input_offset long, fetched_at_ms long")
    one = lambda **x: tuple(serving.position(a, **x).first())
    assert one() == (5, 300, 5, True) and one(at=99) == (5, 300, 5, True) and one(at=1) == (1, 100, 5, False) and one(as_of_ms=95) == (1, 100, 5, False) and one(as_of_ms=5) == (-1, None, 5, False)
    assert tuple(serving.position(a.limit(0)).first()) == (-1, None, -1, True)
    with pytest.raises(ValueError):
        serving.position(a, at=1, as_of_ms=1)
    p = spark.createDataFrame([("3:4",), ("x",), ("3:",), (None,)], "s string").select(serving.parse_position(F.col("s")).alias("p")).collect()
    assert [r.p and tuple(r.p) for r in p] == [(3, 4), None, None, None]
    assert [serving.clamped("limit", x) for x in (-1, 7, 9_999)] == [1, 7, 500]


def test_small_functions(spark):
    r = spark.range(1).select(
        serving.base_language(F.lit("pt-BR")), serving.base_language(F.lit("NB")), serving.same_language(F.lit("nn_NO"), F.lit("no")), serving.union_sorted(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("c"), F.lit("a"))),
        serving.union_sorted(F.lit(None).cast("array<string>"), F.array(F.lit("x"))), serving.outcome_label(F.lit("near_dup")), serving.close_reason(F.lit("odd")),
    ).first()
    assert list(r) == ["pt", "no", True, ["a", "b", "c"], ["x"], "near_duplicate", "unspecified"]


def test_detection(spark):
    s = spark.createDataFrame([("en", "the house and the river"), ("es", "la casa y el río"), ("de", "das Haus und der Fluss"), (None, "xx")], "lang string, text string")
    rows = spark.createDataFrame([(1, "the river"), (2, "la casa el"), (3, "the casa"), (4, None), (5, ""), (6, "the"), (7, "THE House"), (8, "das " * 5_000)], "k long, t string").withColumn("lang", F.lit("clash"))
    got = {r.k: r.detected for r in detect.detect(rows, s, "k", F.col("t")).collect()}
    assert got == {1: "en", 2: "es", 3: None, 4: None, 5: None, 6: None, 7: "en", 8: None}
    assert detect.detect(rows.limit(0), s, "k", F.col("t")).count() == 0


def test_search_groups_by_story(spark):
    a = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", [0.8, 0.2])], "id string, v array<float>")
    cur = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("d", "s1")], "article_id string, story_id string")
    found = serving.search(a, a.where("id = 'a'"), cur, "v", 3)
    assert [(r.place, r.id, r.story_id) for r in found.orderBy("place").collect()] == [(1, "a", "s1"), (2, "b", "s2"), (3, "d", "s1")]
    open_stories = spark.createDataFrame([("s1",)], "story_id string")
    assert [(r.place, r.story_id, r.hits, r.strong) for r in serving.search_stories(found, open_stories).collect()] == [(1, "s1", 2, True)]


def test_late_diff(spark):
    d = lambda *x: spark.createDataFrame(list(x), "id string, o long")
    ids = d(("a", 1), ("b", 2))
    assert tuple(serving.late_diff(d(("a", 1), ("z", 9)), d(("a", 1)), ids, "o").first()) == (1, 1, True)
    assert tuple(serving.late_diff(d(("a", 1), ("b", 2)), d(("a", 1)), ids, "o").first()) == (2, 1, False)
    assert tuple(serving.late_diff(ids.limit(0), ids.limit(0), ids, "o").first()) == (0, 0, True)


def test_embedding_in_requests(spark):
    def words(texts):
        """Each text's words as vectors of letters' counts."""
        n = max(1, max(len(t.split()) for t in texts))
        x, m = np.zeros((len(texts), n, 26)), np.zeros((len(texts), n))
        for i, t in enumerate(texts):
            for j, w in enumerate(t.split()):
                m[i, j] = 1
                for c in w.lower():
                    if c.isascii() and c.isalpha():
                        x[i, j, ord(c) - 97] += 1
        return x, m, "letters-1"

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", None, "", "abc " * 4_000, "ab"])], "k long, t string").coalesce(1)
    got = {r.k: r for r in embedding.embed(rows, "k", "t", words, most=2, budget=50).collect()}
    assert len(got) == 5 and list(got[0].vector) == list(got[4].vector) and got[0].model_version == "letters-1"
    assert all(abs(np.linalg.norm(r.vector) - 1) < 1e-5 for r in got.values())
    assert [(s.start, s.stop) for s in embedding.requests(["a" * 30, "b" * 30, "c", "d"], 2, 40)] == [(0, 1), (1, 3), (3, 4)]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return ("ok",)

    assert embedding.tried(flaky, 3, 0) == ("ok",)
    x, m = np.array([[[3.0, 4.0], [9.0, 9.0]], [[1.0, 1.0], [1.0, 1.0]]]), np.array([[1, 0], [0, 0]])
    assert np.allclose(embedding.pooled(x, m), [[0.6, 0.8], [0, 0]])
    assert embedding.means_path("m-e5@61/int8") == "config/centering/m-e5-61-int8.json"


def test_json_feed(spark):
    body = '{"version": "https://jsonfeed.org/version/1.1", "language": "es", "items": [{"id": "https://a.example/1", "title": "T", "content_html": "<p>x</p>", "date_published": "2026-03-01T10:00:00Z"}, {"id": "2", "url": "https://a.example/2", "summary": "s"}, {"id": "3"}]}'
    df = spark.createDataFrame([("https://a.example/feed.json", body), ("f", "<rss/>"), ("g", None)], "feed_url string, body string")
    got = sorted((r.url, r.title, r.summary, r.published_at_ms, r.lang_hint) for r in feeds.parse_json_feeds(df).collect())
    assert got == [("https://a.example/1", "T", "<p>x</p>", 1772359200000, "es"), ("https://a.example/2", "", "s", None, "es")]
    assert spark.range(1).select(feeds.slot_address(F.lit("20260301101500"), "https://x.example/v2/")).first()[0] == "https://x.example/v2/20260301101500.gkg.csv.zip"


def test_following_the_log(spark, tmp_path):
    p = str(tmp_path / "log")
    log = spark.createDataFrame([(i // 2, i % 2, "created") for i in range(20)], "input_offset long, seq int, kind string")
    log.write.parquet(p)
    q = live.changes(spark, p, log.schema).writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("followed").agg(F.max("pos")).first()[0] == (9 << 20) + 1
    p_ = live.progress(spark, q)
    assert p_.agg(F.sum("rows")).first()[0] == 20 and live.rates(p_).agg(F.sum("rows")).first()[0] == 20
    resync, page = live.catch_up(log, 8 << 20, 5)
    assert not resync and [(r.input_offset, r.seq) for r in page.collect()] == [(8, 1), (9, 0), (9, 1)]
    assert live.catch_up(log, -1, 5)[0]
    logs.reset(spark, p)
    assert spark.read.parquet(p).count() == 0 and spark.read.parquet(p).columns == log.columns


def test_event_text(spark):
    rows = [(0, 0, 0, "created", "s", '{"seed_article_id":"a"}', 5, 0), (1, 1, 0, "split", "s", '{"parent_story_id":"s","children":[{"story_id":"k","article_ids":["a","b"]},{"story_id":"l"}]}', 6, 9), (2, 2, 0, "odd", "s", None, 6, 9)]
    e = rm.log(spark.createDataFrame(rows, "feed_pos long, input_offset long, seq int, kind string, story_id string, payload string, event_time_ms long, watermark_ms long"))
    got = [r.payload for r in serving.event_json(e).orderBy("input_offset").collect()]
    assert '"watermark":null' in got[0] and '"children":[{"story_id":"k","article_count":2},{"story_id":"l","article_count":0}]' in got[1] and len(got) == 2


def test_words_of_a_transcript(spark):
    df = spark.createDataFrame([(1, "a 😀b  cd"), (2, None), (3, " "), (4, "")], "k long, t string").withColumn("place", F.lit("clash"))
    w = serving.word_starts(df, "k", "t", 10)
    assert [(r.k, r.place, r.word, r.utf16, r.start_ms) for r in w.orderBy("k", "place").collect()] == [(1, 0, "a", 0, 0), (1, 1, "😀b", 2, 20), (1, 2, "cd", 7, 60)]
    assert [(r.k, r.word) for r in serving.word_at(w, "k", 59).collect()] == [(1, "😀b")]


def test_one_job_at_a_time(spark, tmp_path):
    p = str(tmp_path / "jobs")
    assert jobs.current(spark, p).count() == 0
    jobs.move(spark, p, "a", "queued")
    with pytest.raises(ValueError):
        jobs.move(spark, p, "b", "queued")
    with pytest.raises(ValueError):
        jobs.move(spark, p, "a", "done")
    jobs.move(spark, p, "a", "running")
    assert jobs.recover(spark, p) == 1 and jobs.recover(spark, p) == 0
    jobs.move(spark, p, "b", "queued")
    assert {(r.job, r.state, r.note) for r in jobs.current(spark, p).collect()} == {("a", "failed", "interrupted"), ("b", "queued", None)}
