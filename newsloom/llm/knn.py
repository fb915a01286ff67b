"""The most similar vectors of every vector, by NN-descent on Spark joins.

Equal vectors form one node first, so a vector that many rows share is
searched once. The graph starts, as implementations of NN-descent do, from
small blocks: vectors on the same side of several random hyperplanes are
compared within their block, for several sets of planes. Then each round joins
neighbours of neighbours: every node sends its vector to the nodes on its
list, and where two meet, of which one is new there, they are measured against
each other and offered to each other's lists, until few offers improve
anything. New vectors are answered by greedy search: they enter the graph
through their blocks and walk to neighbours of their best nodes as long as
these get better.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import Stages

NEIGHBOURS, LEAST = 5, 0.82
#: Nodes that a list of the graph holds at least, rows of a class of equal vectors that can be anyone's neighbours, and what a node takes from a block.
KEEP, FROM_BLOCK = 12, 8
#: How far below the least cosine an edge may lie that the descent walks over.
SLACK = 0.12
#: Vectors that a block is meant to hold, up to twice as many, and OVERSIZE times as many at most; sets of hyperplanes, and planes of a set for which there is one set more.
BLOCK, OVERSIZE, TABLES, PLANES = 1_024, 4, 4, 4
#: Rounds at most, the share of new edges at which they end, and nodes that are measured against each other where many meet.
ROUNDS, SETTLED, CHUNK = 8, 0.01, 32
#: Candidates that a vector asks for in a step of the search.
TRIES = 8
#: Vectors whose mean the hyperplanes pass through, and vectors a part that the cuts of an oversized block are drawn from.
CENTRE_SAMPLE, CUT_SAMPLE = 4_096, 128
#: Digits to which cosines count as equal.
DIGITS = 6
#: Rows that a task takes of edges, and of edges with vectors.
ROWS, VECTORS = 250_000, 25_000


def usable(rows: DataFrame, key: str, vector: str, group: str, size: int) -> DataFrame:
    """key, group, unit vector as bytes, digest. Vectors that are null, of another length, all 0, or hold null, NaN or infinity are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            n = np.diff(v.offsets.to_numpy())
            fits = (n == size) & ~np.asarray(v.is_null().to_numpy(zero_copy_only=False), bool)
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            values = v.take(pa.array(at)).flatten()
            x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            top = np.abs(x).max(axis=1)
            ok = np.isfinite(top) & (top > 0)
            x, at = x[ok] / top[ok][:, None], at[ok]
            x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32) + np.float32(0)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "grp", "vec"])

    t = rows.select(F.col(key).cast("long").alias("key"), F.col(group).cast("string").alias("grp"), F.col(vector).cast("array<float>").alias("v")).where("key IS NOT NULL")
    t = t.mapInArrow(run, "key long, grp string, vec binary")
    return t.withColumn("digest", F.unhex(F.md5(F.concat(F.col("vec"), F.coalesce(F.col("grp"), F.lit("\0")).cast("binary")))))


def _matrix(col: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, size)


def _planes(tables: int, bits: int, size: int) -> np.ndarray:
    return np.random.default_rng(97).standard_normal((tables, bits, size))


def _directions(table: int, levels: int, size: int) -> np.ndarray:
    """One direction a level, others in each table, along which oversized blocks are cut."""
    return np.random.default_rng([131, table]).standard_normal((levels, size))


def _levels(count: int, block: int) -> int:
    return max(1, math.ceil(math.log2(count / block)))


def _walk(x: np.ndarray, cuts: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The part of each vector: ``cuts`` are a binary tree's thresholds, a level's nodes after those above."""
    levels = (len(cuts) + 1).bit_length() - 1
    at = np.zeros(len(x), np.int64)
    for d in directions[:levels]:
        at = 2 * at + 1 + (x @ d > cuts[at])
    return at - len(cuts)


def _cuts_of(table: int, size: int):
    """From a sample of an oversized block: thresholds that halve it level by level."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, levels = _matrix(t.column("vec"), size), t.column("levels")[0].as_py()
        cuts, at = np.zeros(2**levels - 1), np.zeros(len(x), np.int64)
        for d in _directions(table, levels, size):
            y = x @ d
            for node in np.unique(at).tolist():
                cuts[node] = np.median(y[at == node])
            at = 2 * at + 1 + (y > cuts[at])
        return pa.table({"code": t.column("code")[:1], "grp": t.column("grp")[:1], "cuts": pa.array([cuts.tolist()])})

    return run


def with_code(nodes: DataFrame, centre: np.ndarray, tables: int, table: int, bits: int, size: int, cuts: dict[tuple, np.ndarray] | None = None) -> DataFrame:
    """Adds ``code``: the sides of one table's hyperplanes that the vector lies on, as a number; and ``part`` of a block that has ``cuts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(tables, bits, size)[table]
        directions = _directions(table, max((len(c).bit_length() for c in (cuts or {}).values()), default=0), size)
        for b in batches:
            v = _matrix(b.column(2), size)
            code = ((v - centre) @ planes.T > 0) @ (1 << np.arange(bits))
            part = np.zeros(len(v), np.int64)
            if cuts:
                rows: dict[tuple, list[int]] = {}
                for i, k in enumerate(zip(code.tolist(), b.column(1).to_pylist())):
                    if k in cuts:
                        rows.setdefault(k, []).append(i)
                for k, at in rows.items():
                    part[at] = _walk(v[at], cuts[k], directions)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.astype(np.int64)), pa.array(part)], names=["nid", "grp", "vec", "code", "part"])

    return nodes.select("nid", "grp", "vec").mapInArrow(run, "nid long, grp string, vec binary, code long, part long")


def _best(u: np.ndarray, v: np.ndarray, s: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (u, v, s) the ``keep`` with the highest s of each u, lower v first among equals."""
    o = np.lexsort((v, -s, u))
    u, v, s = u[o], v[o], s[o]
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.empty(0, np.int64)
    rank = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
    k = rank < keep
    return u[k], v[k], s[k]


def _within_block(size: int, least: float, keep: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids = t.column("nid").to_numpy()
        asks = t.column("asks").to_numpy()
        x = _matrix(t.column("vec"), size)
        us, vs, ss = [], [], []
        rows, cols = np.flatnonzero(asks), np.flatnonzero(t.column("answers").to_numpy())
        y = x[cols].T.copy()
        for i in range(0, len(rows), 1_024):
            own = rows[i : i + 1_024]
            g = x[own] @ y
            r, c = np.nonzero(g >= least)
            if len(r) > 16 * (keep + 1) * len(own) and g.shape[1] > keep + 1:
                # In a dense block few of the rest can be among the best; equal ones after rounding stay.
                kth = np.partition(g, -keep - 1, axis=1)[:, -keep - 1]
                r, c = np.nonzero(g >= np.maximum(kth - 10.0**-DIGITS, least)[:, None])
            s = np.round(g[r, c].astype(np.float64), DIGITS)
            other = own[r] != cols[c]
            u, v, s = _best(ids[own[r[other]]], ids[cols[c[other]]], s[other], keep)
            us.append(u)
            vs.append(v)
            ss.append(s)
        z = lambda p, d: np.concatenate(p) if p else np.empty(0, d)
        return pa.table({"u": z(us, np.int64), "v": z(vs, np.int64), "s": z(ss, np.float64)})

    return run


def _measured(pairs: DataFrame, left: DataFrame, right: DataFrame, size: int, least: float) -> DataFrame:
    """(u, v, s) of pairs whose cosine reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = np.round(np.einsum("ij,ij->i", _matrix(b.column(2), size), _matrix(b.column(3), size)).astype(np.float64), DIGITS)
            take = pa.array(np.flatnonzero(s >= least))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(s).take(take)], names=["u", "v", "s"])

    a, c = left.select(F.col("nid").alias("u"), F.col("vec").alias("x")), right.select(F.col("nid").alias("v"), F.col("vec").alias("y"))
    return pairs.select("u", "v").join(a, "u").join(c, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long, s double")


def best_of(edges: DataFrame, keep: int, by: tuple[Column, ...] | None = None) -> DataFrame:
    w = Window.partitionBy("u").orderBy(*(by or (F.desc("s"), F.asc("v"))))
    return edges.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep).drop("__r")


def _lists(keep: int, full: int):
    """From rows (u, v, s, fresh): each u's ``keep`` best different v, known ones not fresh; with ``worst``, what an offer to a full list of ``full`` must exceed."""

    def best(u: np.ndarray, v: np.ndarray, s: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
        o = np.lexsort((fresh, v, u))
        u, v, s, fresh = u[o], v[o], s[o], fresh[o]
        first = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
        u, v, s, fresh = u[first], v[first], s[first], fresh[first]
        o = np.lexsort((v, -s, u))
        u, v, s, fresh = u[o], v[o], s[o], fresh[o]
        start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        count = np.diff(np.append(start, len(u)))
        kept = np.arange(len(u)) - np.repeat(start, count) < keep
        last = s[start + np.minimum(count, full) - 1]
        return u[kept], v[kept], s[kept], np.repeat(np.where(count >= full, last, -1.0), count)[kept], fresh[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[c.to_numpy(zero_copy_only=False) for c in b.columns[:4]] for b in batches if b.num_rows]
        if cols:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best(*[np.concatenate(c) for c in zip(*cols)])], names=["u", "v", "s", "worst", "fresh"])

    return run


def _both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        u, v, s, fresh = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((u, v), (v, u), (s, s), (fresh, fresh))], names=["u", "v", "s", "fresh"])


def _meet(size: int, floor: float):
    """From rows (m, x, s, worst, fresh, vec), all of an m in one task: what nodes on the same m's doorstep, one of them new there, have to offer each other.

    Where more than CHUNK meet, those most alike m meet each other, the next ones each other, and so on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        m, x, s, worst, fresh = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i in range(5))
        vec = np.concatenate([_matrix(b.column(5), size) for b in got])
        o = np.lexsort((x, -s, m))
        m, x, worst, fresh, vec = m[o], x[o], worst[o], fresh[o], vec[o]
        start = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        rank = np.arange(len(m)) - np.repeat(start, np.diff(np.append(start, len(m))))
        start = np.flatnonzero(rank % CHUNK == 0)
        count = np.diff(np.append(start, len(m)))
        seen: list[tuple[np.ndarray, ...]] = []
        for width in (2, 4, 8, 16, CHUNK):
            groups = start[(count > width // 2) & (count <= width) & (count > 1)]
            i, j = np.triu_indices(width, 1)
            for at in range(0, len(groups), max(1, 40_000 // width)):
                g = groups[at : at + max(1, 40_000 // width)]
                place = g[:, None] + np.arange(width)
                there = np.arange(width) < np.diff(np.append(start, len(m)))[np.searchsorted(start, g)][:, None]
                place = np.where(there, place, g[:, None])
                y = vec[place]
                c = np.round(np.matmul(y, y.transpose(0, 2, 1))[:, i, j].astype(np.float64), DIGITS)
                a, b = place[:, i], place[:, j]
                ok = there[:, i] & there[:, j] & (c >= floor) & (fresh[a] | fresh[b]) & ((c > worst[a]) | (c > worst[b]))
                a, b, c = x[a[ok]], x[b[ok]], c[ok]
                seen.append((np.minimum(a, b), np.maximum(a, b), c))
        if not seen:
            return
        u, v, c = (np.concatenate(p) for p in zip(*seen))
        o = np.lexsort((v, u))
        u, v, c = u[o], v[o], c[o]
        first = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) if len(u) else np.empty(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(u[first]), pa.array(v[first]), pa.array(c[first]), pa.array(np.ones(int(first.sum()), bool))], names=["u", "v", "s", "fresh"])

    return run


_EDGE = "u long, v long, s double, fresh boolean"


class Graph:
    """The neighbour graph over distinct vectors.

    ``nodes``: nid (the lowest key of the vector), grp, vec, keys (its lowest
    ``keep`` keys); ``members``: key, nid; ``edges``: u, v, s, the best ``keep``
    of each u, of cosine ``least`` - SLACK and more. ``k``: neighbours that
    will be asked for at most.
    """

    def __init__(self, rows: DataFrame, key: str, vector: str, group: str, size: int, least: float = LEAST, block: int = BLOCK, rounds: int = ROUNDS, k: int = NEIGHBOURS):
        self.spark, self.size, self.least, self.block = rows.sparkSession, size, least, block
        self.keep, self.floor = max(KEEP, k + 1), least - SLACK
        self.stages = Stages(self.spark, "knn")
        base = self.stages.write(usable(rows, key, vector, group, size), "base")
        w = Window.partitionBy("digest").orderBy("key")
        low = base.select("key", "digest").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= self.keep)
        heads = low.groupBy("digest").agg(F.array_sort(F.collect_list("key")).alias("keys"))
        heads = self.stages.write(heads.withColumn("nid", F.element_at("keys", 1)), "heads")
        self.members = base.select("key", "digest").distinct().join(heads.select("digest", "nid"), "digest").select("key", "nid")
        one = base.join(heads.select(F.col("nid").alias("key"), "nid", "keys", F.col("digest").alias("__d")), "key").where("digest = __d")
        self.nodes = self.stages.write(one.select("nid", "grp", "vec", "keys").dropDuplicates(["nid"]), "nodes")
        self.members = self.stages.write(self.members, "members")
        self.stages.drop("base")
        self.n = self.nodes.count()
        self.bits = math.floor(math.log2(max(1.0, self.n / block)))
        self.tables = TABLES + math.ceil(self.bits / PLANES) if self.bits else 1
        # By hash, so that tasks send only what is drawn.
        share = min(1.0, CENTRE_SAMPLE / max(1, self.n))
        drawn = self.nodes.where(F.pmod(F.xxhash64("nid"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec").collect()
        self.centre = np.mean([np.frombuffer(r[0], np.float32) for r in drawn], axis=0) if drawn else np.zeros(size)
        self.edges = self._descend(rounds)

    def _cuts(self, t: DataFrame, table: int) -> dict[tuple, np.ndarray]:
        """Per block of too many vectors: where directions of this table's own cut it at medians, so that near ones stay
        together and other tables part it elsewhere."""
        sizes = t.groupBy("code", "grp").count().where(F.col("count") > OVERSIZE * self.block).collect()
        if not sizes:
            return {}
        large = self.spark.createDataFrame(
            [(r["code"], r["grp"], _levels(r["count"], self.block), CUT_SAMPLE * 2 ** _levels(r["count"], self.block) / r["count"]) for r in sizes], "c long, g string, levels int, share double"
        )
        t = t.join(F.broadcast(large), (F.col("code") == F.col("c")) & F.col("grp").eqNullSafe(F.col("g")))
        drawn = t.where(F.pmod(F.xxhash64("nid"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("code", "grp", "levels", "vec")
        found = drawn.groupBy("code", "grp").applyInArrow(_cuts_of(table, self.size), "code long, grp string, cuts array<double>").collect()
        return {(r["code"], r["grp"]): np.array(r["cuts"]) for r in found}

    def _block(self, table: int, asking: DataFrame | None) -> DataFrame:
        """(u, v, s) within the blocks of one table; with ``asking`` only its vectors ask, and the nodes answer."""
        code = lambda df, cuts=None: with_code(df, self.centre, self.tables, table, self.bits, self.size, cuts)
        cuts = self._cuts(code(self.nodes), table)
        t = code(self.nodes, cuts).select("*", F.lit(asking is None).alias("asks"), F.lit(True).alias("answers"))
        if asking is not None:
            t = t.unionByName(code(asking, cuts).select("*", F.lit(True).alias("asks"), F.lit(False).alias("answers")))
        t = t.select("nid", "vec", "asks", "answers", "code", "grp", "part")
        return t.groupBy("code", "grp", "part").applyInArrow(_within_block(self.size, self.floor, FROM_BLOCK if asking is None else self.keep), "u long, v long, s double")

    def _blocks(self, name: str, asking: DataFrame | None = None) -> DataFrame:
        """The same over all tables, one after another, so that only one lies shuffled at a time."""
        out = None
        for t in range(self.tables):
            part = self.stages.write(self._block(t, asking), f"{name}{t}")
            out = part if out is None else out.unionByName(part)
            self.stages.sweep()
        return out.distinct()

    def _parts(self, rows: int, most: int) -> int:
        return max(self.spark.sparkContext.defaultParallelism, math.ceil(rows / most))

    def _listed(self, edges: DataFrame, rows: int, name: str) -> DataFrame:
        """The lists that edges make when each is offered to both of its ends."""
        both = edges.select("u", "v", "s", "fresh").mapInArrow(_both_ways, _EDGE).repartition(self._parts(2 * rows, ROWS), "u")
        return self.stages.write(both.mapInArrow(_lists(self.keep, self.keep), "u long, v long, s double, worst double, fresh boolean"), name)

    def _descend(self, rounds: int) -> DataFrame:
        start = self._blocks("blocks").withColumn("fresh", F.lit(True))
        lists = self._listed(start, FROM_BLOCK * self.n, "lists0")
        self.stages.sweep()
        #: Different pairs on the lists after the start and after each round, and how many of them are new.
        self.progress = [lists.agg(F.count("*"), F.count_if("fresh")).first()]
        for i in range(1, rounds + 1):
            edges = self.progress[-1][0]
            vectors = self.nodes.select(F.col("nid").alias("u"), "vec")
            sent = lists.join(vectors, "u").select(F.col("v").alias("m"), F.col("u").alias("x"), "s", "worst", "fresh", "vec")
            offers = sent.repartition(self._parts(edges, VECTORS), "m").mapInArrow(_meet(self.size, self.floor), _EDGE)
            offers = self.stages.write(offers, f"offers{i}")
            self.stages.sweep()
            known = lists.select("u", "v", "s", F.lit(False).alias("fresh"))
            new = self._listed(known.unionByName(offers), 4 * edges, f"lists{i}")
            self.progress.append(new.agg(F.count("*"), F.count_if("fresh")).first())
            self.stages.drop(f"lists{i - 1}")
            self.stages.drop(f"offers{i}")
            lists = new
            self.stages.sweep()
            if self.progress[-1][1] <= SETTLED * self.progress[-1][0]:
                break
        return lists.select("u", "v", "s")

    def _two_hops(self, near: DataFrame, edges: DataFrame) -> DataFrame:
        """(u, v): nodes two hops from u that are not on its list, the TRIES likeliest by the product of the hops' cosines."""
        a, b = near.select("u", F.col("v").alias("m"), F.col("s").alias("s1")), edges.select(F.col("u").alias("m"), "v", F.col("s").alias("s2"))
        two = a.join(b, "m").where("u <> v").groupBy("u", "v").agg(F.max(F.col("s1") * F.col("s2")).alias("s"))
        return best_of(two.join(near.select("u", "v"), ["u", "v"], "left_anti"), TRIES)

    def neighbours(self, k: int = NEIGHBOURS) -> DataFrame:
        """(key, neighbour, cosine): the k nearest of each row, equal cosines by lower key."""
        if k >= self.keep:
            raise ValueError("the graph was built for fewer neighbours")
        own = self.nodes.select(F.col("nid").alias("u"), F.explode("keys").alias("n"), F.lit(1.0).alias("s"))
        keys = self.nodes.select(F.col("nid").alias("v"), "keys")
        other = self.edges.where(F.col("s") >= self.least).join(keys, "v").select("u", F.explode("keys").alias("n"), "s")
        w = Window.partitionBy("u").orderBy(F.desc("s"), F.asc("n"))
        top = own.unionByName(other).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
        lists = top.groupBy(F.col("u").alias("nid")).agg(F.array_sort(F.collect_list(F.struct("r", "n", "s"))).alias("near"))
        out = self.members.join(lists, "nid").select("key", F.slice(F.filter("near", lambda x: x["n"] != F.col("key")), 1, k).alias("near"))
        return out.select("key", F.inline("near")).select("key", F.col("n").alias("neighbour"), F.col("s").alias("cosine"))

    def search(self, queries: DataFrame, key: str, vector: str, group: str, k: int = NEIGHBOURS, steps: int = 4) -> DataFrame:
        """(key, neighbour, cosine) of vectors that need not be in the graph, by greedy search from the nodes of their blocks."""
        if k >= self.keep:
            raise ValueError("the graph was built for fewer neighbours")
        q = usable(queries, key, vector, group, self.size).dropDuplicates(["key"])
        q = self.stages.write(q.select((-F.col("key") - 1).alias("nid"), "grp", "vec"), "queries")
        front = self.stages.write(best_of(self._blocks("asked", q), self.keep), "front0")
        for i in range(1, steps + 1):
            new = _measured(self._two_hops(front, self.edges), q, self.nodes, self.size, self.floor)
            after = self.stages.write(best_of(front.unionByName(new).distinct(), self.keep), f"front{i}")
            gained = after.join(front, ["u", "v"], "left_anti").limit(1).count()
            front = after
            if not gained:
                break
        rows = front.where(F.col("s") >= self.least).join(self.nodes.select(F.col("nid").alias("v"), "keys"), "v").select("u", F.explode("keys").alias("v"), "s")
        return best_of(rows, k).select((-F.col("u") - 1).alias("key"), F.col("v").alias("neighbour"), F.col("s").alias("cosine"))


def pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("key", "neighbour").alias("offset_a"), F.greatest("key", "neighbour").alias("offset_b")).distinct()
