"""The story engine over a batch or a stream of embedded articles.

The engine's decisions have one total order, so it runs as one key. A stream
keeps the engine's saved state in the state store; inputs of a micro-batch are
put in log order first, and how they fall into micro-batches changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.engine.core import Config, StoryEngine, article_text, title_words
from newsloom.functions import minhash
from newsloom.session import spread

EVENTS = "input_offset long, seq int, outcome string, late boolean, article_id string, event_id string, event_time_ms long, watermark_ms long, kind string, story_id string, payload string"
COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]


def inputs(embedded: DataFrame) -> DataFrame:
    """The columns that the engine reads, of the embedded log."""
    a = "article"
    return embedded.select(
        "input_offset", *[F.col(f"{a}.{c}").alias(c) for c in ("id", "source_id", "title", "summary", "published_at_ms", "fetched_at_ms", "lang")],
        "vector", "model_version", F.lit(0).alias("shard"),
    )


def _run(engine: StoryEngine, pdf: pd.DataFrame) -> list[tuple]:
    pdf, out = pdf.sort_values("input_offset", kind="stable"), []
    plain = {c: [None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else v for v in pdf[c].tolist()] for c in pdf.columns if c != "input_offset"}
    rows = [dict(zip(plain, r)) for r in zip(*plain.values())]
    offsets = [int(o) for o in pdf["input_offset"]]
    for r, offset, (outcome, late, events) in zip(rows, offsets, engine.process_all(rows, offsets)):
        out.append((offset, -1, outcome, late, r["id"], None, None, None, None, None, None))
        out += [(offset, e["seq"], outcome, late, r["id"], e["event_id"], e["event_time_ms"], e["watermark_ms"], e["kind"], e["story_id"], e["payload"]) for e in events]
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=COLUMNS)
    for c in ("event_time_ms", "watermark_ms"):
        df[c] = df[c].astype("Int64")
    return df


def prepared(log: DataFrame) -> DataFrame:
    """The log with what the engine needs of an article's texts, which depends on no other article: made in parallel."""

    @F.pandas_udf("sketch binary, words string")
    def texts(title: pd.Series, summary: pd.Series) -> pd.DataFrame:
        rows = [(t or "", s) for t, s in zip(title, summary)]
        sketches = [minhash.sketch(article_text(t, s)) for t, s in rows]
        return pd.DataFrame({"sketch": [b"" if x is None else x.tobytes() for x in sketches], "words": [" ".join(title_words(t)) for t, _ in rows]})

    return log.withColumn("texts", texts("title", "summary")).select(*[c for c in log.columns if c not in ("summary", "shard")], "texts.*")


def run_batch(log: DataFrame, config: Config | None = None, model: str | None = None, tell: bool = True) -> DataFrame:
    """One row per input (seq -1, its outcome) and per event, of a whole log. ``tell``: with the events."""
    return run_configs(log, [config or Config()], model, tell).drop("config")


def run_configs(log: DataFrame, configs: list[Config], model: str | None = None, tell: bool = True) -> DataFrame:
    """The same under several configurations at once, one task each; ``config`` is their place in the list.

    What depends on one article alone is made in parallel. A task sorts the
    log, which may spill, and takes it batch by batch: what it holds is the
    engine's state. All tasks read the log from the same exchange.
    """

    def under(i: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            engine = StoryEngine(configs[i], model=model, tell=tell)
            for pdf in pdfs:
                yield _frame(_run(engine, pdf)).assign(config=i)

        return run

    ordered = prepared(spread(log)).repartition(1).sortWithinPartitions("input_offset")
    runs = [ordered.mapInPandas(under(i), f"{EVENTS}, config int") for i in range(len(configs))]
    # Without an exchange behind each, Spark puts the single partitions of a union into one task, one run after the other.
    return reduce(DataFrame.union, [r.repartition(len(configs), "config") for r in runs]) if len(runs) > 1 else runs[0]


def run_stream(log: DataFrame, config: Config | None = None, model: str | None = None) -> DataFrame:
    """The same over a stream: append mode, state in the state store."""
    c = config or Config()

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        engine = StoryEngine.restore(state.get[0], c) if state.exists else StoryEngine(c, model=model)
        parts = list(pdfs)
        rows = _run(engine, pd.concat(parts)) if parts else []
        state.update((engine.save(),))
        yield _frame(rows)

    return log.groupBy("shard").applyInPandasWithState(step, EVENTS, "saved binary", "append", GroupStateTimeout.NoTimeout)


def events_of(result: DataFrame) -> DataFrame:
    return result.where("seq >= 0").select("input_offset", "seq", "event_id", "event_time_ms", "watermark_ms", "kind", "story_id", "payload")


def outcomes_of(result: DataFrame) -> DataFrame:
    return result.where("seq = -1").select("input_offset", "article_id", "outcome", "late")
