"""Exactly-once outputs of streams: one folder per micro-batch, overwritten when a batch comes again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.streaming.stories import events_of, outcomes_of


def write_epoch(root: str) -> Callable[[DataFrame, int], None]:
    """Events, dropped late inputs and the next offset of a micro-batch. Delivered again, a batch replaces itself."""

    def write(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            events_of(df).write.mode("overwrite").parquet(f"{root}/events/batch={batch_id}")
            outcomes_of(df).where("outcome = 'late_dropped'").write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
            df.agg((F.max("input_offset") + 1).alias("next_offset")).write.mode("overwrite").parquet(f"{root}/offsets/batch={batch_id}")
        finally:
            df.unpersist()

    return write


def start(result: DataFrame, root: str, available_now: bool = True) -> StreamingQuery:
    w = result.writeStream.foreachBatch(write_epoch(root)).option("checkpointLocation", f"{root}/checkpoint")
    return (w.trigger(availableNow=True) if available_now else w).start()


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """What batches whose offset stands have written: the offset goes last and commits the batch, so no reader sees a part of one."""
    data = spark.read.parquet(f"{root}/{name}")
    if name != "offsets":
        data = data.join(spark.read.parquet(f"{root}/offsets").select("batch").distinct(), "batch", "left_semi")
    return data.drop("batch")


def next_offset(spark: SparkSession, root: str) -> DataFrame:
    """Offsets only advance: the highest of all batches."""
    return read(spark, root, "offsets").agg(F.max("next_offset").alias("next_offset"))
