"""Logs as Parquet folders: bounded reads, appends, recorded fixtures, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators.readmodel import numbered


def scan_range(log: DataFrame, start: int, stop: int, offset: str = "input_offset") -> DataFrame:
    """[start, stop): the filter reaches files and row groups."""
    return log.where((F.col(offset) >= start) & (F.col(offset) < stop))


def scan_since(log: DataFrame, since_ms: int, time: str = "fetched_at_ms") -> DataFrame:
    return log.where(F.col(time) >= since_ms)


def append(spark: SparkSession, rows: DataFrame, path: str, order: list[str], offset: str = "input_offset") -> DataFrame:
    """Rows in the given order behind what the log holds; offsets go on where they ended. The log as it is then."""
    try:
        top = spark.read.parquet(path).agg(F.coalesce(F.max(offset), F.lit(-1))).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        top = -1
    n = numbered(rows.drop(offset), order).withColumn(offset, F.col("place") + (top + 1)).drop("place")
    n.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def record_raw(log: DataFrame, path: str, key: str = "id") -> None:
    """A fixture of raw articles: each id once, its first delivery, in the order of fetching, with its place ``ord``."""
    w = Window.partitionBy(key).orderBy("raw_offset")
    first = log.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    numbered(first, ["fetched_at_ms", key]).withColumnRenamed("place", "ord").write.mode("overwrite").parquet(path)


def check(log: DataFrame, key: str, time: str) -> DataFrame:
    """Rows, different ids, ids that repeat, and the time span."""
    g = log.groupBy(key).agg(F.count("*").alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("ids"), F.count_if(F.col("n") > 1).alias("repeated"), F.min("lo").alias("first"), F.max("hi").alias("last"))


def sequence_hash(log: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """One hash of an ordered log: equal for equal rows in equal places only.

    Each row is hashed with its place; the hashes add up, so any number of
    tasks takes part and no task sees the whole.
    """
    n = numbered(log, order)
    value = F.sha2(F.concat_ws("\x1f", F.col("place").cast("string"), *[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]), 256)
    words = [F.sum(F.conv(F.substring(value, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(4)]
    return n.agg(F.count("*").alias("rows"), *words).select("rows", F.sha2(F.concat_ws(",", *[F.col(f"w{i}").cast("string") for i in range(4)]), 256).alias("hash"))


def reset(spark: SparkSession, *paths: str) -> None:
    """Empties tables and keeps their columns, so that they can be folded anew."""
    for path in paths:
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
