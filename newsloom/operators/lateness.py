"""Event-time periods that late records correct, with a cut-off for lateness.

Partial aggregates are kept for each pair of period and arrival batch. They
merge by addition, minimum and maximum, so a read combines them and a new
batch only adds its own. Records behind the watermark are refused and set
apart; no partial of a closed period is touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
LATENESS_MS = 24 * HOUR_MS
AHEAD_MS = 300_000
#: Rows of the log that one running maximum covers; the blocks' maxima are chained over SPAN blocks at a time.
BLOCK, SPAN = 65_536, 1_024


def event_time(published: str = "published_at_ms", fetched: str = "fetched_at_ms") -> Column:
    """Publication time, or the fetch time where it is null, not positive or more than AHEAD_MS ahead of the fetch."""
    p, f = F.col(published), F.col(fetched)
    return F.when(p.isNull() | (p <= 0) | F.coalesce(p > f + AHEAD_MS, F.lit(False)), f).otherwise(p)


def running_max(rows: DataFrame, order: str, value: str, out: str, inclusive: bool = True) -> DataFrame:
    """``value``'s highest so far in the order of ``order``, without sorting all rows in one task.

    Each block of BLOCK positions takes its own running maximum; what came
    before a block is the chained maximum of the earlier blocks, themselves
    chained in spans. Rows with a null ``order`` have no place and are left
    out. Null values count for nothing; before the first value the result is
    null. Rows at the same position see each other.
    """
    b = rows.where(F.col(order).isNotNull()).withColumn("__b", F.floor(F.col(order) / BLOCK)).withColumn("__s", F.floor(F.col("__b") / SPAN))
    blocks = b.groupBy("__s", "__b").agg(F.max(value).alias("__m"))
    spans = blocks.groupBy("__s").agg(F.max("__m").alias("__sm"))
    before_span = spans.select("__s", F.max("__sm").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)).alias("__ps"))
    before = (
        blocks.withColumn("__pb", F.max("__m").over(Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)))
        .join(before_span, "__s")
        .select("__b", F.greatest("__pb", "__ps").alias("__p"))
    )
    w = Window.partitionBy("__b").orderBy(order)
    # Frames by value, not by row: rows at one position see each other.
    frame = w.rangeBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    own = F.max(value).over(frame)
    return b.join(before, "__b").withColumn(out, F.greatest(own, "__p")).drop("__b", "__s", "__p")


def judge(rows: DataFrame, order: str = "raw_offset", lateness_ms: int = LATENESS_MS) -> DataFrame:
    """Adds ``event_ms``, ``watermark_ms``, ``hour_ms`` and ``late``.

    The watermark is the highest event time up to and including the row, minus
    ``lateness_ms``. A row without any time has null ``event_ms`` and
    ``hour_ms`` and is not late. Tables may hold columns of these names; they
    are replaced.
    """
    t = rows.withColumn("event_ms", event_time())
    t = running_max(t, order, "event_ms", "__top")
    return t.select(
        *[c for c in t.columns if c not in ("__top", "watermark_ms", "hour_ms", "late")],
        (F.col("__top") - lateness_ms).alias("watermark_ms"),
        (F.floor(F.col("event_ms") / HOUR_MS) * HOUR_MS).alias("hour_ms"),
        F.coalesce(F.col("event_ms") < F.col("__top") - lateness_ms, F.lit(False)).alias("late"),
    )


def partials(judged: DataFrame, batch: str = "delivery_batch") -> DataFrame:
    """One mergeable partial for each period and arrival batch; late rows have no part in it."""
    return (
        judged.where("NOT late AND hour_ms IS NOT NULL")
        .groupBy("hour_ms", F.col(batch).alias("batch"))
        .agg(F.count("*").alias("n"), F.min("event_ms").alias("first_ms"), F.max("event_ms").alias("last_ms"))
    )


def combine(parts: DataFrame, upto_batch: int | None = None) -> DataFrame:
    """The periods as they stand after ``upto_batch`` (all batches when null); rows of a null batch count always."""
    p = parts if upto_batch is None else parts.where(F.col("batch").isNull() | (F.col("batch") <= upto_batch))
    return p.groupBy("hour_ms").agg(
        F.sum("n").alias("n"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.count("*").alias("batches")
    )


def merge(stored: DataFrame, new: DataFrame, closed_before_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(stored partials with the new ones added, refused new partials).

    A new partial of an hour that ended at or before ``closed_before_ms`` is
    refused. A batch that was merged already replaces itself, so a repeated
    merge changes nothing.
    """
    closed = F.lit(False) if closed_before_ms is None else (F.col("hour_ms") + HOUR_MS <= closed_before_ms)
    refused, taken = new.where(closed), new.where(~closed)
    # All that a batch left before goes, also hours that it no longer has; closed hours stay as they are.
    again = new.select("batch").distinct()
    kept = stored.where(~closed).alias("s").join(again.alias("t"), F.col("s.batch").eqNullSafe(F.col("t.batch")), "left_anti")
    return stored.where(closed).unionByName(kept).unionByName(taken), refused
