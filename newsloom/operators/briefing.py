"""A short spoken briefing of each story, from its articles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as tx

CHARS, REPORT, REPORTS, REDUNDANT, NATIVE = 520, 280, 3, 0.5, 0.08


def fit(text: str, most: int) -> str:
    """At most ``most`` characters, at a sentence end in the last two thirds, else at a word with an ellipsis; ends like a sentence."""
    stops = ".!?。！？"
    if len(text) <= most:
        t = text.strip()
        return t if t.endswith(tuple(stops + '…"”»')) else t + "."
    cut = text[:most]
    ends = [i + 1 for i, c in enumerate(cut) if c in stops and (i + 1 == len(cut) or cut[i + 1].isspace())]
    if ends and ends[-1] >= most / 3:
        return cut[: ends[-1]]
    at = cut.rfind(" ")
    return cut[: at if at >= 0 else len(cut)].rstrip(",;:") + "…"


def _words(t: str) -> frozenset[str]:
    return frozenset(w.lower() for w in "".join(c if c.isalnum() else " " for c in t).split() if len(w) > 2)


def alike(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def candidates(members: DataFrame, lang: str) -> DataFrame:
    """The best article of each source of a story, those in the listener's language ahead: no more for a story than there are sources.

    ``members``: story_id, source_id, lang, title, summary, score. Only what a
    briefing can use is kept before stories are gathered.
    """
    m = members.withColumn("rank_score", F.col("score") + F.when(F.col("lang") == lang, NATIVE).otherwise(0.0))
    order = (F.desc("rank_score"), F.asc("title"))
    one = m.withColumn("r", F.row_number().over(Window.partitionBy("story_id", "source_id").orderBy(*order))).where("r = 1")
    best = one.withColumn("r", F.row_number().over(Window.partitionBy("story_id").orderBy(*order, "source_id")))
    return best.withColumn("spoken", tx.spoken(F.coalesce("summary", F.lit(""))))


def compose(members: DataFrame, lang: str, chars: int = CHARS) -> DataFrame:
    """(story_id, briefing): the headline, how many sources cover it, and up to REPORTS reports that say something new, within ``chars``."""
    cover = members.groupBy("story_id").agg(F.countDistinct("source_id").alias("s"), F.countDistinct("lang").alias("l"))
    sentence = cover.select("story_id", tx.coverage_sentence(F.col("s"), F.col("l")).alias("coverage"))
    c = candidates(members, lang).join(sentence, "story_id").select("story_id", "r", "title", "spoken", "source_id", "coverage")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("r")
        parts = [fit(p["title"].iloc[0], REPORT), p["coverage"].iloc[0]]
        told = [_words(parts[0])]
        for text in p["spoken"]:
            if len(told) > REPORTS or not text:
                continue
            report = fit(text, REPORT)
            if any(alike(_words(report), t) > REDUNDANT for t in told) or sum(map(len, parts)) + len(parts) + len(report) > chars:
                continue
            parts.append(report)
            told.append(_words(report))
        return pd.DataFrame({"story_id": [p["story_id"].iloc[0]], "briefing": [" ".join(parts)]})

    return c.groupBy("story_id").applyInPandas(one, "story_id string, briefing string")


def sub_batches(lengths: list[int], budget: int) -> Iterator[list[int]]:
    """Positions by length, cut where padding to the longest would exceed the budget of tokens."""
    batch: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if batch and (len(batch) + 1) * lengths[i] > budget:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch
