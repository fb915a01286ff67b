"""Following the event log as it grows, and how a stream is doing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from newsloom.operators.readmodel import pack

#: Events that a client may lag behind before it is told to fetch everything anew.
MOST_BEHIND = 1_000


def changes(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """The event log as a stream, a bounded number of files at a time, with the position ``pos`` of each event."""
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return log.where("input_offset IS NOT NULL AND seq IS NOT NULL").withColumn("pos", pack())


def catch_up(log: DataFrame, held: int, most: int = MOST_BEHIND) -> tuple[bool, DataFrame]:
    """(resync, events): the events behind the position that a client holds, in order; or, if they are more than ``most``, none and True."""
    behind = log.withColumn("pos", pack()).where(F.col("pos") > held)
    lag = behind.limit(most + 1).count()
    page = behind.orderBy("pos").limit(most)
    return (True, page.limit(0)) if lag > most else (False, page)


def progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """One row per micro-batch that the query remembers: batch, time, input rows, rows a second, milliseconds it took."""
    rows = [(int(p["batchId"]), p["timestamp"], int(p["numInputRows"]), float(p.get("processedRowsPerSecond") or 0.0), int(p["durationMs"].get("triggerExecution", 0))) for p in query.recentProgress]
    return spark.createDataFrame(rows, "batch long, at string, rows long, rows_per_s double, took_ms long")


def rates(progress: DataFrame, by: str = "1 minute") -> DataFrame:
    """Rows, rows a second, and the median and 95th percentile of a batch's time, per stretch of time."""
    p = progress.withColumn("t", F.to_timestamp("at"))
    return p.groupBy(F.window("t", by).start.alias("start")).agg(
        F.sum("rows").alias("rows"), (F.sum("rows") * 1000 / F.greatest(F.sum("took_ms"), F.lit(1))).alias("rows_per_s"),
        F.percentile_approx("took_ms", 0.5).alias("p50_ms"), F.percentile_approx("took_ms", 0.95).alias("p95_ms"),
    )
