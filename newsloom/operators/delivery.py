"""Messages delivered at least once: keep exactly one copy of each.

Identifiers are split by their aggregated frequency, counted before any row is
shuffled. Those seen once pass without being ranked; only rows of repeated
identifiers are ranked. The few identifiers that hold more than HOT_SHARE of
all rows are known from the count, at most 1 / HOT_SHARE of them: their rows
are shuffled by identifier and salt, ranked within the salted parts, and the
parts' winners meet in a second ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a hot group of copies is ranked in before the winners meet.
SALTS = 64
#: Share of all rows above which a group is hot; so no more than 1,024 groups are.
HOT_SHARE = 1 / 1_024


def message_key(column: str) -> Column:
    """Identifier without surrounding white space, in lower case; null stays null."""
    return F.lower(F.regexp_replace(F.col(column), r"^[\s ﻿]+|[\s ﻿]+$", ""))


def rank_copies(rows: DataFrame, id_column: str, order: list[str], salts: int = SALTS, hot_share: float = HOT_SHARE) -> tuple[DataFrame, DataFrame]:
    """(singletons, ranked): rows with an identifier of their own, and the rows
    of repeated identifiers with a boolean ``__kept`` true on one row of each.

    Rows with a null identifier are nobody's copies and count as singletons.
    ``order`` names the columns whose lowest tuple is kept, nulls last; rows
    equal in all of them are repeated rows, of which any one is kept. Columns
    of ``rows`` other than the helper columns ``__key``, ``__salt``, ``__hot``,
    ``__r1``, ``__r2`` and ``__kept`` are passed through.
    """
    keyed = rows.withColumn("__key", message_key(id_column))
    counts = keyed.groupBy("__key").agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    repeated = counts.where("__key IS NOT NULL AND __n > 1")
    hot = repeated.join(F.broadcast(total), F.col("__n") > F.col("__total") * hot_share).select("__key", F.lit(True).alias("__hot"))
    # Hot groups, and rows without an identifier, are dealt out by salt; all others keep their rows together.
    salt = F.when(F.col("__key").isNull() | F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*order), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    dealt = keyed.join(F.broadcast(hot), "__key", "left").withColumn("__salt", salt)
    every = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    parts = repeated.join(F.broadcast(hot), "__key", "left").select("__key", F.explode(every).alias("__salt"))
    singles = dealt.join(parts, ["__key", "__salt"], "left_anti").drop("__key", "__salt", "__hot")
    by = [F.col(c).asc_nulls_last() for c in order]
    first = dealt.join(parts, ["__key", "__salt"], "left_semi").withColumn("__r1", F.row_number().over(Window.partitionBy("__key", "__salt").orderBy(*by)))
    cold = first.where("__hot IS NULL OR __r1 > 1").withColumn("__kept", F.col("__r1") == 1)
    finals = first.where("__hot IS NOT NULL AND __r1 = 1").withColumn("__r2", F.row_number().over(Window.partitionBy("__key").orderBy(*by)))
    winners = finals.withColumn("__kept", F.col("__r2") == 1).drop("__r2")
    return singles, cold.unionByName(winners).drop("__key", "__salt", "__hot", "__r1")


def keep_one(rows: DataFrame, id_column: str = "id", order: tuple[str, ...] = ("fetched_at_ms", "raw_offset")) -> DataFrame:
    """Every message once: rows with a null identifier all stay; an empty table stays empty."""
    singles, ranked = rank_copies(rows, id_column, list(order))
    return singles.unionByName(ranked.where("__kept").drop("__kept"))


def redundant(rows: DataFrame, id_column: str = "id", order: tuple[str, ...] = ("fetched_at_ms", "raw_offset")) -> DataFrame:
    """The rows that ``keep_one`` leaves out."""
    _, ranked = rank_copies(rows.select(id_column, *order), id_column, list(order))
    return ranked.where("NOT __kept").drop("__kept")


def admit(stored: DataFrame, new: DataFrame, id_column: str = "id", order: tuple[str, ...] = ("fetched_at_ms", "raw_offset")) -> DataFrame:
    """The stored table after a new batch: one copy over both, whichever came first by ``order``."""
    return keep_one(stored.unionByName(new, allowMissingColumns=True), id_column, order)
