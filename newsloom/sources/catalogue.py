"""The catalogue of sources: TOML to table, with everything that is wrong with it."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "source_id string, url string, lang string, source_kind string, category string, enabled boolean, poll_interval_s int, sample double, detect_lang boolean"


def load(spark: SparkSession, path: str) -> DataFrame:
    with open(path, "rb") as f:
        rows = tomllib.load(f).get("source", [])
    unknown = {k for r in rows for k in r} - {"id", "url", "lang", "kind", "category", "enabled", "poll_interval_s", "sample", "detect_lang"}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    data = [
        (r.get("id"), r.get("url"), r.get("lang"), r.get("kind", "rss"), r.get("category"), r.get("enabled", True), r.get("poll_interval_s", 180), float(r.get("sample", 1.0)), r.get("detect_lang", False))
        for r in rows
    ]
    return spark.createDataFrame(data, SCHEMA)


def problems(sources: DataFrame) -> DataFrame:
    """(source_id, problem): what makes a catalogue unusable; none when it is sound."""
    twice = sources.groupBy("source_id").count().where("count > 1").select("source_id", F.lit("repeated id").alias("problem"))
    checks = [
        (~F.coalesce(F.col("source_id").rlike("^[a-z0-9-]+$"), F.lit(False)), "bad id"), (~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)), "bad url"),
        (F.col("lang").isNotNull() & ~F.col("lang").rlike("^[a-z]{2}$"), "bad language"), (F.col("poll_interval_s") < 60, "polls too often"), (~F.col("sample").between(1e-12, 1.0), "bad sample"),
    ]
    each = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))
    return sources.select("source_id", F.explode(each).alias("problem")).unionByName(twice)
