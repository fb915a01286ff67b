"""Feeds that lie in files: RSS and Atom documents, and tab-separated knowledge graph exports.

Fetching over the network is no part of this: a landing folder is. Each parser
gives candidates: url, title, summary, published_at_ms, lang_hint.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Media elements that some publishers leave empty.
EMPTY_MEDIA = "title text credit description keywords category copyright".split()

_ITEM = "title: string, link: string, guid: string, description: string, `content:encoded`: string, `media:description`: string, pubDate: string, `dc:date`: string"
_CHANNEL = f"channel struct<language: string, item: array<struct<{_ITEM}>>>"
_ENTRY = "title: string, id: string, link: array<struct<_href: string, _rel: string>>, summary: string, content: string, published: string, updated: string"
_FEED = f"`_xml:lang` string, entry array<struct<{_ENTRY}>>"


def strip_empty_media(body: Column) -> Column:
    names = "|".join(EMPTY_MEDIA)
    return F.regexp_replace(body, rf"<media:({names})>\s*</media:\1>|<media:({names})\s*/>", "")


def _when(*texts: Column) -> Column:
    """Epoch milliseconds of the first text that reads as a time."""
    forms = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"]
    # Weekdays can't be parsed and tell nothing; the named zones of feeds are UTC.
    plain = lambda t: F.regexp_replace(F.regexp_replace(F.trim(t), r"^[A-Za-z]+,\s*", ""), r"\s(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(*[F.unix_millis(F.try_to_timestamp(plain(t), F.lit(f))) for t in texts for f in forms])


def _filled(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in texts])


def parse_feeds(bodies: DataFrame, body: str = "body", feed: str = "feed_url") -> DataFrame:
    """Candidates of RSS and Atom documents, one document a row. What is neither gives none.

    The link is the first without a relation or with ``alternate``, else the
    first, else the id if it is an address; relative ones are put behind the
    feed's host. The summary is the summary, else the content, else the
    media's description. The time is publication, else update.
    """
    b = bodies.select(feed, strip_empty_media(F.col(body)).alias("b"))
    r = b.where(F.col("b").rlike("(?s)<rss[ >]|<channel[ >]")).select(feed, F.from_xml("b", _CHANNEL, {"rowTag": "rss"}).alias("x"))
    r = r.select(feed, F.col("x.channel.language").alias("lang_hint"), F.inline("x.channel.item"))
    rss = r.select(
        feed, _filled(F.col("link"), F.when(F.col("guid").startswith("http"), F.col("guid"))).alias("url"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(_filled(F.col("description"), F.col("content:encoded"), F.col("media:description")), F.lit("")).alias("summary"), _when(F.col("pubDate"), F.col("dc:date")).alias("published_at_ms"), "lang_hint",
    )
    a = b.where(F.col("b").rlike("(?s)<feed[ >]")).select(feed, F.from_xml("b", _FEED, {"rowTag": "feed"}).alias("x")).select(feed, F.col("x.`_xml:lang`").alias("lang_hint"), F.inline("x.entry"))
    best = F.filter("link", lambda k: k["_rel"].isNull() | (k["_rel"] == "alternate"))
    link = F.coalesce(F.try_element_at(best["_href"], F.lit(1)), F.try_element_at(F.col("link._href"), F.lit(1)), F.when(F.col("id").startswith("http"), F.col("id")))
    atom = a.select(
        feed, link.alias("url"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce(_filled(F.col("summary"), F.col("content")), F.lit("")).alias("summary"),
        _when(F.col("published"), F.col("updated")).alias("published_at_ms"), "lang_hint",
    )
    both = rss.unionByName(atom).where("url IS NOT NULL")
    root = F.regexp_extract(feed, r"^(https?://[^/]+)", 1)
    return both.withColumn("url", F.when(F.col("url").startswith("/"), F.concat(root, "url")).otherwise(F.col("url")))


_JSON_ITEM = "id string, url string, external_url string, title string, summary string, content_text string, content_html string, date_published string, date_modified string, language string"


def parse_json_feeds(bodies: DataFrame, body: str = "body", feed: str = "feed_url") -> DataFrame:
    """Candidates of JSON feeds, one document a row, by the same rules as the others. What is no such feed gives none."""
    f = F.from_json(body, f"language string, items array<struct<{_JSON_ITEM.replace(' string', ':string')}>>")
    i = bodies.select(feed, f.alias("f")).select(feed, F.col("f.language").alias("feed_lang"), F.inline("f.items"))
    return i.select(
        feed, F.coalesce(_filled(F.col("url"), F.col("external_url")), F.when(F.col("id").startswith("http"), F.col("id"))).alias("url"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(_filled(F.col("summary"), F.col("content_text"), F.col("content_html")), F.lit("")).alias("summary"),
        _when(F.col("date_published"), F.col("date_modified")).alias("published_at_ms"), F.coalesce("language", "feed_lang").alias("lang_hint"),
    ).where("url IS NOT NULL")


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Every file of a folder as one document; its path stands for the feed's address."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("feed_url"), F.decode("content", "UTF-8").alias("body"))
    return parse_feeds(files).unionByName(parse_json_feeds(files))


def parse_graph(lines: DataFrame, line: str = "value", english: bool = True) -> DataFrame:
    """Candidates of tab-separated rows of 27 columns and more; shorter rows, and those without an address or page title, give none."""
    c = F.split(F.col(line), "\t")
    col = lambda i: F.get("c", F.lit(i))
    t = lines.select(c.alias("c")).where(F.size("c") >= 27)
    title = F.regexp_extract(col(26), "<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1)
    hint = F.lit("en") if english else F.nullif(F.regexp_extract(col(25), "srclc:([^;]*)", 1), F.lit(""))
    t = t.select(col(4).alias("url"), title.alias("title"), F.lit("").alias("summary"), F.unix_millis(F.try_to_timestamp(col(1), F.lit("yyyyMMddHHmmss"))).alias("published_at_ms"), hint.alias("lang_hint"), col(26).contains("</PAGE_TITLE>").alias("ok"))
    return t.where("ok AND url LIKE 'http%'").drop("ok")


def read_graph_zips(spark: SparkSession, path: str, english: bool = True) -> DataFrame:
    """Zipped exports: the single entry of each archive, its checksum verified; broken archives stop the read."""

    def unzip(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for content in p["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
                    for lines in iter(lambda f=f: f.readlines(4_000_000), []):
                        yield pd.DataFrame({"value": [x.decode("utf-8", "replace").rstrip("\r\n") for x in lines]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")
    return parse_graph(files.mapInPandas(unzip, "value string"), english=english)


def slots(spark: SparkSession, from_ms: int, to_ms: int) -> DataFrame:
    """The quarters of an hour in [from, to), the first floored."""
    q = 900_000
    return spark.range(from_ms // q, -(-to_ms // q)).select((F.col("id") * q).alias("slot_ms"), F.date_format(F.timestamp_millis(F.col("id") * q), "yyyyMMddHHmmss").alias("name"))


def slot_address(name: Column, base: str, english: bool = True) -> Column:
    """Where the export of a slot lies below ``base``."""
    return F.concat(F.lit(base.rstrip("/") + "/"), name, F.lit(".gkg.csv.zip" if english else ".translation.gkg.csv.zip"))
