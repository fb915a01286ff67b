"""The story graph and the bookkeeping of what a viewer holds of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import Stages


def roots(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, root) by following parents to the end: pointers jump to their target's target, so chains of n take log n rounds.

    Each child has one parent, the lowest if several. A circle has no end: the
    lowest of those that run in it is their root, and of all that lead into it.
    """
    stages = Stages(links.sparkSession, "roots")
    one = links.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).groupBy(F.col(child).alias("c")).agg(F.min(parent).alias("p"))
    # ``low`` is the lowest of the nodes from c up to p, which are as many as the jumps have passed.
    cur = stages.write(one.withColumn("low", F.col("c")), "r0")
    rounds = max(1, math.ceil(math.log2(cur.count() + 1)) + 1)
    for i in range(1, rounds + 1):
        up = cur.select(F.col("c").alias("p"), F.col("p").alias("pp"), F.col("low").alias("plow"))
        new = cur.join(up, "p", "left").select("c", F.coalesce("pp", "p").alias("p"), F.least("low", "plow").alias("low"), F.col("pp").isNotNull().alias("moved"))
        cur = stages.write(new, f"r{i}")
        if not cur.where("moved").limit(1).count():
            break
    ring = cur.select(F.col("c").alias("p"), F.col("low").alias("ring"))
    return cur.join(ring, "p", "left").select(F.col("c").alias(child), F.coalesce("ring", "p").alias("root"))


def edges(similar: DataFrame, lineage: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, kind, weight): similarity edges and lineage edges between nodes; of two for a pair, lineage counts."""
    both = similar.select("a", "b", F.lit("similar").alias("kind"), F.col("sim").alias("weight"), F.lit(1).alias("o")).unionByName(
        lineage.select(F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b"), F.lit("lineage").alias("kind"), F.lit(1.0).alias("weight"), F.lit(0).alias("o"))
    )
    n = nodes.select("id")
    both = both.join(n.withColumnRenamed("id", "a"), "a", "left_semi").join(n.withColumnRenamed("id", "b"), "b", "left_semi")
    return both.groupBy("a", "b").agg(F.min_by(F.struct("kind", "weight"), "o").alias("e")).select("a", "b", "e.kind", "e.weight")


def reconcile(held: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """(key, state): new, kept or gone between two snapshots."""
    h, s = held.select(F.col(key).alias("h")), shown.select(F.col(key).alias("s"))
    state = F.when(F.col("h").isNull(), "new").when(F.col("s").isNull(), "gone").otherwise("kept")
    return h.join(s, F.col("h") == F.col("s"), "full").select(F.coalesce("h", "s").alias(key), state.alias("state"))


def evicted(nodes: DataFrame, cap: int) -> DataFrame:
    """What goes when only ``cap`` nodes fit: fewest sources first, then longest idle."""
    stay = nodes.orderBy(F.desc("sources"), F.desc("last_ms"), "id").limit(cap).select("id")
    return nodes.join(F.broadcast(stay), "id", "left_anti")


def radius(n: Column) -> Column:
    return F.least(F.lit(56.0), 3 + 4.4 * F.sqrt(F.greatest(n, F.lit(1))))


def recency(hours: Column) -> Column:
    """0 for now to 1 for a day and more, linear between the stops 0, 1, 6 and 24 hours."""
    return (
        F.when(hours <= 0, 0.0).when(hours < 1, hours / 3).when(hours < 6, 1 / 3 + (hours - 1) / 15).when(hours < 24, 2 / 3 + (hours - 6) / 54).otherwise(1.0)
    )


def relative_time(ms_ago: Column) -> Column:
    m = F.floor(ms_ago / 60_000)
    return (
        F.when(m < 1, "just now").when(m < 60, F.concat(m.cast("string"), F.lit(" min ago"))).when(m < 1_440, F.concat(F.floor(m / 60).cast("string"), F.lit(" h ago")))
        .otherwise(F.concat(F.floor(m / 1_440).cast("string"), F.lit(" d ago")))
    )


def layout(segments: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, place, word, from_char): words of a transcript with their place among all its characters."""
    w = segments.select(key, order, F.posexplode(F.split(text, " ")).alias("k", "word"))
    run = Window.partitionBy(key).orderBy(order, "k")
    return w.select(key, (F.row_number().over(run) - 1).alias("place"), "word", (F.sum(F.length("word") + 1).over(run) - F.length("word") - 1).alias("from_char"))
