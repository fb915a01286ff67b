"""A synthetic stream of embedded articles: drifting topics, exact and near copies, late arrivals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

STEP_MS, START_MS = 6 * 60_000, 1_704_067_200_000
SCHEMA = "input_offset long, article struct<id:string,source_id:string,title:string,summary:string,published_at_ms:long,fetched_at_ms:long,lang:string>, vector array<float>, model_version string"


def article(i: int, seed: int, dim: int = 64, topics: int = 48, sources: int = 12, langs: tuple[str, ...] = ("en", "es", "de", "fr")) -> dict:
    """The i-th row, whatever is made before or after it: each row draws from its own generator.

    Every tenth is 1 to 60 hours late with a random topic; topics drift every
    100; one in 20 repeats the row before, one in 20 copies it "(updated)".
    """
    rng = np.random.default_rng([seed, i])
    kind = int(rng.integers(20))
    if i and kind == 0:
        return article(i - 1, seed, dim, topics, sources, langs) | {"input_offset": i}
    base = article(i - 1, seed, dim, topics, sources, langs) if i and kind == 1 else None
    late = i % 10 == 9
    topic = int(rng.integers(topics)) if late else (i // 100 + int(rng.integers(topics // 8))) % topics
    v = np.random.default_rng([seed, 1_000_003, topic]).standard_normal(dim)
    v = v / np.linalg.norm(v) + rng.standard_normal(dim) * 0.04
    fetched = START_MS + i * STEP_MS
    words = np.random.default_rng([seed, 7, topic, i]).integers(0, 5_000, 9)
    title = base["article"]["title"] + " (updated)" if base else f"topic{topic} " + " ".join(f"w{w}" for w in words)
    art = {
        "id": f"{seed:08x}{i:024x}", "source_id": f"source-{int(rng.integers(sources))}", "title": title, "summary": base["article"]["summary"] if base else "",
        "published_at_ms": fetched - (int(rng.integers(1, 61)) * 3_600_000 if late else 0), "fetched_at_ms": fetched, "lang": langs[int(rng.integers(len(langs)))],
    }
    return {"input_offset": i, "article": art, "vector": (base["vector"] if base else (v / np.linalg.norm(v)).astype(np.float32)), "model_version": "synth"}


def stream(spark: SparkSession, count: int = 5_000, seed: int = 7, **shape) -> DataFrame:
    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([article(int(i), seed, **shape) for i in p["id"]], columns=["input_offset", "article", "vector", "model_version"])

    return spark.range(count).mapInPandas(make, SCHEMA)
