"""How much of a summary is kept."""

from newsloom.plans import ingest

RAW = "raw_offset long, source_id string, source_kind string, url string, title string, summary string, published_at_ms long, fetched_at_ms long, lang string"


def test_summaries_are_cut_at_600_characters(spark, tmp_path):
    d, word = str(tmp_path), "abcdefgh "
    given = [word * 20 + "end", (word * 70)[:600].strip(), "x" * 600, "x" * 601, word * 70, "", None]
    want = [given[0], given[1], given[2], "x" * 599 + "…", (word * 66).strip() + "…", "", ""]
    rows = [(i, "s", "rss", f"https://a.example/{i}", "title", s, 1, 1, "en") for i, s in enumerate(given)]
    spark.createDataFrame(rows, RAW).write.parquet(f"{d}/articles_raw.parquet")
    spark.createDataFrame([("s", "en")], "source_id string, lang string").write.parquet(f"{d}/feed_sources.parquet")
    assert [r.summary or "" for r in ingest.truncated_summaries(spark, d).orderBy("raw_offset").collect()] == want
    assert [r.summary for r in ingest.articles_normalized(spark, d).orderBy("raw_offset").collect()] == want
