"""Which language a text is in, told from words that only one language's samples hold, and only where that is reliable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that must tell for a language, and how many times as many as for any other.
LEAST, LEAD = 2, 2
#: Letters of words; kana and Han count by character.
WORDS = r"[぀-ヿ一-鿿]|[a-zß-öø-ÿœа-яё]+"


def telling_words(text: Column) -> Column:
    """Different words of a text in lower case; none of a null text."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))), F.array().cast("array<string>"))


def profile(samples: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(word, lang) of the words that occur in samples of one language only."""
    w = samples.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(telling_words(F.col(text))).alias("word"))
    return w.groupBy("word").agg(F.min("lang").alias("lang"), F.max("lang").alias("__other")).where("lang = __other").drop("__other")


def detect(rows: DataFrame, samples: DataFrame, key: str, text: Column) -> DataFrame:
    """``key`` and ``detected`` of each row; null where too few words tell or two languages are near each other. Keys are unique.

    Words go to the profile, whose size is that of the samples; points are
    added up before rows are shuffled by key.
    """
    w = rows.select(key, F.explode(telling_words(text)).alias("word")).join(profile(samples), "word")
    points = w.groupBy(key, "lang").agg(F.count("*").alias("n"))
    best = points.groupBy(key).agg(F.max(F.struct("n", "lang")).alias("top"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    second = F.coalesce(F.get("ns", F.lit(1)), F.lit(0))
    sure = best.where((F.col("top.n") >= LEAST) & (F.col("top.n") >= LEAD * second) & (F.col("top.n") > second)).select(F.col(key).alias("__k"), F.col("top.lang").alias("detected"))
    return rows.select(key).join(sure, F.col(key) == F.col("__k"), "left").select(key, "detected")
