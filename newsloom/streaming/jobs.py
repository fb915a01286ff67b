"""Jobs of replays: a log of their states, of which one runs at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: From which states each state can be reached; null is a job that is not there yet.
BEFORE = {"queued": {None}, "running": {"queued"}, "done": {"running"}, "failed": {"queued", "running"}}
SCHEMA = "job string, step long, state string, note string"


def log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def current(spark: SparkSession, path: str) -> DataFrame:
    """(job, step, state, note): where each job stands."""
    return log(spark, path).groupBy("job").agg(F.max("step").alias("step"), F.max_by(F.struct("state", "note"), "step").alias("s")).select("job", "step", "s.*")


def move(spark: SparkSession, path: str, job: str, state: str, note: str | None = None) -> None:
    """Puts a job into its next state; what can't follow is refused, and so is a second job that waits or runs."""
    now = {r.job: r for r in current(spark, path).collect()}
    before = now[job].state if job in now else None
    if before not in BEFORE[state]:
        raise ValueError(f"{job} is {before} and can't be {state}")
    if state == "queued" and any(r.state in ("queued", "running") for r in now.values()):
        raise ValueError("another job waits or runs")
    step = now[job].step + 1 if job in now else 0
    spark.createDataFrame([(job, step, state, note)], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def recover(spark: SparkSession, path: str) -> int:
    """After a restart: jobs that were interrupted have failed. How many."""
    left = [r.job for r in current(spark, path).where("state IN ('queued', 'running')").collect()]
    for job in left:
        move(spark, path, job, "failed", "interrupted")
    return len(left)
