"""Sources, scalar functions and the read model on small inputs."""

import zipfile

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.functions import urls
from newsloom.operators import readmodel as rm
from newsloom.sources import catalogue, feeds, logs

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:media="m"><channel><title>c</title><language>en-us</language>
<item><title>First &amp; best</title><link>https://a.example/1</link><description>d1</description><pubDate>Tue, 03 Mar 2026 10:00:00 GMT</pubDate><media:title></media:title></item>
<item><title>Second</title><link>/two</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xml:lang="de"><entry><title>E</title><id>x</id><link rel="self" href="https://b.example/self"/><link rel="alternate" href="https://b.example/e"/>
<summary>s</summary><updated>2026-03-03T10:00:00Z</updated></entry></feed>"""


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_feeds(spark):
    df = spark.createDataFrame([("https://a.example/feed", RSS), ("https://b.example/feed", ATOM), ("https://c.example", "<html>no feed</html>"), ("u", None)], "feed_url string, body string")
    got = {r.url: r for r in feeds.parse_feeds(df).collect()}
    assert set(got) == {"https://a.example/1", "https://a.example/two", "https://b.example/e"}
    assert got["https://a.example/1"].published_at_ms == 1772532000000 == got["https://b.example/e"].published_at_ms
    assert got["https://a.example/two"].published_at_ms is None and got["https://a.example/1"].title == "First & best"


def test_graph_rows(spark, tmp_path):
    cols = [""] * 27
    cols[1], cols[4], cols[25], cols[26] = "20260303100000", "https://d.example/x", "srclc:por;eng:x", "<PAGE_TITLE>T</PAGE_TITLE>"
    text = "\t".join(cols) + "\nshort\trow\n"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", text)
    got = feeds.read_graph_zips(spark, str(tmp_path), english=False).collect()
    assert [(r.url, r.title, r.lang_hint, r.published_at_ms) for r in got] == [("https://d.example/x", "T", "por", 1772532000000)]
    assert [r.name for r in feeds.slots(spark, 1772532060000, 1772532060000 + 3_600_000).orderBy("slot_ms").collect()][0] == "20260303100000"


def test_catalogue(spark, tmp_path):
    p = tmp_path / "s.toml"
    p.write_text('[[source]]\nid = "a-b"\nurl = "https://a.example/f"\nlang = "en"\n[[source]]\nid = "Bad Id"\nurl = "ftp://x"\npoll_interval_s = 5\n')
    c = catalogue.load(spark, str(p))
    assert {(r.source_id, r.problem) for r in catalogue.problems(c).collect()} == {("Bad Id", "bad id"), ("Bad Id", "bad url"), ("Bad Id", "polls too often")}
    p.write_text('[[source]]\nid = "a"\nnonsense = 1\n')
    with pytest.raises(ValueError):
        catalogue.load(spark, str(p))


def test_canonical_urls(spark):
    same = ["https://www.a.example/n/1/", "http://a.example:80/n/1?utm_source=x#top", " https://A.example/n/1?ref=y ", "https://a.example/n/1"]
    assert {one(spark, u, urls.canonical) for u in same} == {"https://a.example/n/1"}
    assert one(spark, "https://a.example/?b=2&a=1&utm_campaign=x", urls.canonical) == "https://a.example/?a=1&b=2"
    assert one(spark, "ftp://a.example/x", urls.canonical) is None and one(spark, None, urls.canonical) is None


@pytest.mark.parametrize(
    "given,want",
    [("<p>One</p><p>two &amp; three</p>", "One two & three"), ("a<script>x<y</script>b", "a b"), ("2 < 3 and 5 > 4", "2 < 3 and 5 > 4"), ("東京で<b>地震</b>", "東京で地震"), ("", ""), (None, None)],
)
def test_clean_html(spark, given, want):
    assert one(spark, given, tx.clean_html) == want


def test_other_text_functions(spark):
    assert one(spark, "one two three four", lambda c: tx.truncate(c, 12)) == "one two…"
    assert one(spark, "  Breaking: PM Resigns!! ", tx.shingle_text) == "breaking pm resigns"
    assert one(spark, "LONDON (Agency) - It rained.", tx.spoken) == "It rained."
    assert one(spark, "pt-BR", tx.language_code) == "pt" and one(spark, "spa", tx.language_code) == "es" and one(spark, "unknown", tx.language_code) is None
    assert one(spark, "wire:le.example", lambda c: tx.speakable_source(c, ("en",))) == "le.example" and one(spark, "north-star-en", lambda c: tx.speakable_source(c, ("en",))) == "North Star"
    assert one(spark, "&eacute;", lambda c: tx.unescape(c)) == "é"


LOG = "feed_pos long, input_offset long, seq int, kind string, story_id string, payload string, event_time_ms long, watermark_ms long"


def test_membership_history(spark):
    j = [
        (0, 0, "created", "s1", '{"seed_article_id":"a","headline":"h1","lang":"en"}'), (1, 0, "article_added", "s1", '{"article_id":"b","late":true}'),
        (2, 0, "created", "s2", '{"seed_article_id":"c","headline":"h2","lang":"es"}'), (3, 0, "merged", "s1", '{"source_story_ids":["s2"],"target_story_id":"s1"}'),
        (3, 1, "closed", "s2", '{"reason":"merged"}'), (4, 0, "split", "s1", '{"parent_story_id":"s1","children":[{"story_id":"k1","article_ids":["a","b"]},{"story_id":"k2","article_ids":["c"]}]}'),
        (4, 1, "created", "k1", '{"seed_article_id":"a"}'), (4, 2, "created", "k2", '{"seed_article_id":"c"}'), (4, 3, "closed", "s1", '{"reason":"split"}'),
    ]
    df = spark.createDataFrame([(i, *x, 0, 0) for i, x in enumerate(j + j[:3])], LOG)
    e = rm.log(df)
    m = rm.memberships(e)
    at = lambda o: {(r.story_id, r["count"]) for r in m.where(rm.valid(o)).groupBy("story_id").count().collect()}
    assert [at(o) for o in range(5)] == [{("s1", 1)}, {("s1", 2)}, {("s1", 2), ("s2", 1)}, {("s1", 3)}, {("k1", 2), ("k2", 1)}]
    assert [r.late for r in m.where("story_id = 'k1' AND article_id = 'b'").collect()] == [True]
    assert {(r.parent, r.child) for r in rm.lineage(e).collect()} == {("s2", "s1"), ("s1", "k1"), ("s1", "k2")}
    assert rm.events_after(e, 2, 0, 2).count() == 2
    empty = rm.log(spark.createDataFrame([], LOG))
    assert rm.memberships(empty).count() == 0 and rm.stories(empty).count() == 0


def test_logs(spark, tmp_path):
    p = str(tmp_path / "log")
    a = spark.createDataFrame([("x", 2), ("y", 1)], "id string, fetched_at_ms long")
    logs.append(spark, a, p, ["fetched_at_ms"])
    got = logs.append(spark, a, p, ["fetched_at_ms"])
    assert [(r.input_offset, r.id) for r in got.orderBy("input_offset").collect()] == [(0, "y"), (1, "x"), (2, "y"), (3, "x")]
    h = lambda d, c: logs.sequence_hash(d, ["input_offset"], c).first().hash
    assert h(got, ["id"]) == h(got.repartition(3), ["id"]) != h(got.withColumn("id", F.reverse("id")).withColumn("input_offset", -F.col("input_offset")), ["id"])
    c = logs.check(got, "id", "fetched_at_ms").first()
    assert (c.rows, c.ids, c.repeated) == (4, 2, 2)
    assert logs.scan_range(got, 1, 3).count() == 2 and logs.scan_since(got, 2).count() == 2
