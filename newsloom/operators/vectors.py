"""Operators on vectors of modest tables: centering, exact neighbours, centroids, graphs.

Pairs are formed only within a key, or between a stated set of vectors and
all, in blocks of both: no vector goes through the driver, and no task holds
more than a block of each side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block.
BLOCK = 8_192


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    n = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x / n)


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str = "mean") -> DataFrame:
    """Mean of the vectors of each key, dimension by dimension: sums merge before the shuffle, whatever the size of a group."""
    long = df.select(*keys, F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    m = long.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    return m.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(out))


def centering(df: DataFrame, lang: str, vector: str, least: int) -> DataFrame:
    """(lang, mean): the mean of each language with at least ``least`` vectors, and of all under a null language."""
    many = df.groupBy(lang).count().where(F.col("count") >= least).select(lang)
    per = mean_vectors(df.join(many, lang, "left_semi"), [lang], vector)
    everything = mean_vectors(df.withColumn("__one", F.lit(1)), ["__one"], vector).select(F.lit(None).cast("string").alias(lang), "mean")
    return per.unionByName(everything)


def centered(df: DataFrame, means: DataFrame, lang: str, vector: str) -> DataFrame:
    """``vector`` without its language's mean, or the mean of all, at unit length."""
    per = means.where(F.col(lang).isNotNull()).select(F.col(lang).alias("__l"), F.col("mean").alias("__m"))
    rest = means.where(F.col(lang).isNull()).select(F.col("mean").alias("__g"))
    j = df.join(per, F.col(lang) == F.col("__l"), "left").join(F.broadcast(rest.limit(1)))
    moved = F.zip_with(doubles(F.col(vector)), F.coalesce("__m", "__g"), lambda x, y: x - y)
    return j.withColumn(vector, unit(moved)).drop("__l", "__m", "__g")


def nearest(asking: DataFrame, all_rows: DataFrame, key: str, vector: str, k: int, earlier: bool = False, least: float = -2.0) -> DataFrame:
    """(q, n, sim, rank): the k rows of ``all_rows`` most like each asking row, not itself; equal ones by lower key.

    Both sides are dealt into blocks by hash, and every block of askers meets
    every block of rows in a task of its own, which keeps k per asker. Exact,
    so its work grows with the product of both sides.
    ``earlier``: only rows with a lower key.
    """
    side = lambda df: df.select(F.col(key).cast("long").alias("id"), doubles(F.col(vector)).alias("v"))
    q, x = side(asking), side(all_rows)
    nq, nx = (max(1, -(-df.count() // BLOCK)) for df in (q, x))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q, x = q.select("*", block(nq).alias("i"), every(nx).alias("j")), x.select("*", every(nq).alias("i"), block(nx).alias("j"))
    met = q.groupBy("i", "j").cogroup(x.groupBy("i", "j")).applyInArrow(_met(k, earlier, least), "q long, n long, sim double")
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "n")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _met(k: int, earlier: bool, least: float):
    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        t = t.combine_chunks()
        v = t.column("v").combine_chunks()
        x = np.asarray((v.chunk(0) if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy(zero_copy_only=False))
        return t.column("id").to_numpy(), x.reshape(t.num_rows, -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        qs, ns, ss = [], [], []
        if left.num_rows and right.num_rows:
            (ids, q), (key, x) = matrix(left), matrix(right)
            o = np.argsort(key, kind="stable")
            key, x = key[o], x[o]
            for i in range(0, len(ids), 512):
                s = np.round(q[i : i + 512] @ x.T, 9)
                own = ids[i : i + 512][:, None]
                s = np.where((key >= own) if earlier else (key == own), -np.inf, s)
                s = np.where(s >= least, s, -np.inf)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                v = np.take_along_axis(s, top, 1)
                r, c = np.nonzero(np.isfinite(v))
                qs.append(ids[i : i + 512][r])
                ns.append(key[top[r, c]])
                ss.append(v[r, c])
        z = lambda parts, d: np.concatenate(parts) if parts else np.empty(0, d)
        return pa.table({"q": z(qs, np.int64), "n": z(ns, np.int64), "sim": z(ss, np.float64)})

    return run


def pairs_of(nodes: DataFrame, key: str, vector: str, k: int, least: float) -> DataFrame:
    """Undirected graph of the k most alike of each node: (a, b, sim), a below b."""
    near = nearest(nodes, nodes, key, vector, k, least=least)
    e = near.select(F.least("q", "n").alias("a"), F.greatest("q", "n").alias("b"), "sim")
    return e.groupBy("a", "b").agg(F.max("sim").alias("sim"))


def votes(near: DataFrame, story: DataFrame, least: float) -> DataFrame:
    """(q, story, total, n, rank): each asker's neighbours vote for their stories with their similarity."""
    v = near.where(F.col("sim") >= least).join(story, "n").groupBy("q", "story").agg(F.sum("sim").alias("total"), F.count("*").alias("n"))
    return v.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("total"), "story")))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true (q, n) that were found."""
    return truth.select("q", "n").join(found.select("q", "n", F.lit(1).alias("hit")), ["q", "n"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """Nearest-rank quantiles, one row."""
    return df.agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{int(p * 100)}") for p in shares])
