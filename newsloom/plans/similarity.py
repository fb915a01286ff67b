"""Queries on vectors and shingles, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import minhash as mh
from newsloom.functions import text as tx
from newsloom.operators import vectors as vx
from newsloom.session import Stages, spread, table

K, PERMS, ROWS = 10, 16, 4
#: Estimate from which a document is a near-duplicate of an earlier one.
NEAR_DUPLICATE = 0.8


def _vecs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", vx.doubles(F.col("embedding")).alias("v"), "label")


def _near(spark: SparkSession, d: str, earlier: bool = False, k: int = K) -> DataFrame:
    v = _vecs(spark, d)
    return vx.nearest(v, v, "vec_id", "v", k, earlier)


def _langs(spark: SparkSession, d: str) -> DataFrame:
    return _vecs(spark, d).withColumn("lang", F.element_at(F.array(*map(F.lit, ("en", "es", "de"))), (F.col("vec_id") % 3 + 1).cast("int")))


def lang_means(spark: SparkSession, d: str) -> DataFrame:
    m = vx.centering(_langs(spark, d), "lang", "v", 30)
    return m.select("lang", F.posexplode("mean").alias("pos", "x")).select("lang", "pos", F.round("x", 6).alias("x"))


def lang_centering(spark: SparkSession, d: str) -> DataFrame:
    v = _langs(spark, d)
    c = vx.centered(v, vx.centering(v, "lang", "v", 30), "lang", "v")
    return c.select("vec_id", F.round(F.col("v")[0], 6).alias("x0"), F.round(F.col("v")[63], 6).alias("x63"), F.round(vx.dot(F.col("v"), F.col("v")), 6).alias("norm"))


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).select("q", "n", F.round("sim", 6).alias("sim"), "rank")


def knn_earlier(spark: SparkSession, d: str) -> DataFrame:
    """Only vectors that came before."""
    return _near(spark, d, earlier=True).select("q", "n", F.round("sim", 6).alias("sim"), "rank")


def knn_votes(spark: SparkSession, d: str) -> DataFrame:
    story = _vecs(spark, d).select(F.col("vec_id").alias("n"), F.col("label").alias("story"))
    return vx.votes(_near(spark, d, earlier=True), story, 0.3).select("q", "story", F.round("total", 6).alias("total"), "n", "rank")


def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector asks all; hits are grouped by label, best first."""
    v = _vecs(spark, d)
    hits = vx.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "v", 60).join(v.select(F.col("vec_id").alias("n"), "label"), "n")
    g = hits.groupBy("q", "label").agg(F.round(F.max("sim"), 6).alias("best"), F.count("*").alias("hits"))
    return g.withColumn("strong", F.col("best") >= 0.86)


def centroids(spark: SparkSession, d: str) -> DataFrame:
    m = vx.mean_vectors(_vecs(spark, d), ["label"], "v")
    return m.select("label", F.posexplode(vx.unit(F.col("mean"))).alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def _fits(spark: SparkSession, d: str) -> DataFrame:
    v = _vecs(spark, d)
    c = vx.mean_vectors(v, ["label"], "v").select("label", vx.unit(F.col("mean")).alias("c"))
    return v.join(c, "label").select("label", "vec_id", vx.dot(F.col("v"), F.col("c")).alias("fit"))


def story_cohesion(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("fit"), 6).alias("cohesion"), F.round(F.min("fit"), 6).alias("weakest"))


def medoids(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d).groupBy("label").agg(F.max_by("vec_id", F.struct(F.round("fit", 9), -F.col("vec_id"))).alias("medoid"))


def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of blocks of vectors whose directions are alike: of each block, against all."""
    v = _vecs(spark, d).withColumn("block", F.floor(F.col("vec_id") / 25) * 100 + F.col("label"))
    c = vx.mean_vectors(v, ["block"], "v").select("block", vx.unit(F.col("mean")).alias("c"))
    near = vx.nearest(c, c, "block", "c", 1_000_000, least=0.25)
    return near.where("q < n").select(F.col("q").alias("a"), F.col("n").alias("b"), F.round("sim", 6).alias("sim"), (F.col("sim") >= 0.4).alias("alone"))


def similarity_graph(spark: SparkSession, d: str) -> DataFrame:
    return vx.pairs_of(_vecs(spark, d), "vec_id", "v", 3, 0.35).select("a", "b", F.round("sim", 6).alias("sim"))


def similarity_quantiles(spark: SparkSession, d: str) -> DataFrame:
    near = _near(spark, d, k=1).select(F.round("sim", 6).alias("sim"))
    return vx.quantiles(near, "sim", [0.0, 0.1, 0.5, 0.9])


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Of the ten nearest, how many lie among those that share the label."""
    v = _vecs(spark, d)
    near = _near(spark, d)
    own = near.join(v.select(F.col("vec_id").alias("q"), F.col("label").alias("lq")), "q").join(v.select(F.col("vec_id").alias("n"), F.col("label").alias("ln")), "n").where("lq = ln")
    return vx.recall(own, near).select(F.round("recall", 6).alias("recall"))


def _norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", tx.shingle_text(F.col("text")).alias("t"))


def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    return _norm(spark, d).select("item_id", F.size(tx.shingles(F.col("t"))).alias("n"))


def _signed(spark: SparkSession, d: str) -> DataFrame:
    return _norm(spark, d).select("item_id", mh.signature(F.transform(tx.shingles(F.col("t")), mh.shingle_hash), PERMS).alias("sig"))


def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _signed(spark, d).select("item_id", F.array_join("sig", ",").alias("sig"))


def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share a band of a signature, with the estimate of their similarity."""
    s = _signed(spark, d)
    b = s.select("item_id", F.inline(mh.bands(F.col("sig"), PERMS, ROWS)))
    p = b.alias("x").join(b.alias("y"), ["band", "key"]).where("x.item_id < y.item_id").select(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b")).distinct()
    j = p.join(s.select(F.col("item_id").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("item_id").alias("b"), F.col("sig").alias("sb")), "b")
    return j.select("a", "b", F.round(mh.estimate(F.col("sa"), F.col("sb")), 6).alias("estimate"))


def near_duplicate_best(spark: SparkSession, d: str) -> DataFrame:
    """Each item's most alike earlier item by estimate, lowest first among equals."""
    return lsh_candidates(spark, d).groupBy(F.col("b").alias("item_id")).agg(F.max_by(F.struct("a", "estimate"), F.struct("estimate", -F.col("a"))).alias("m")).select("item_id", F.col("m.a").alias("original"), "m.estimate")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))).select("doc_id", tx.shingle_text(F.col("t")).alias("t"))


def document_shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    """Different shingles of every document, texts whole; a text of fewer characters than a shingle is one, an empty one none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len({t[i : i + 5] for i in range(max(1, len(t) - 4))}) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["doc_id", "n"])

    return _documents(spark, d).mapInArrow(run, "doc_id long, n int")


def _document_signatures(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, signature as bytes, keys of its bands; documents without a shingle are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1_000):
                b = batch.slice(i, 1_000)
                sigs = np.stack([mh.sketch_of(t) for t in b.column(1).to_pylist()])
                keys = mh.band_keys(sigs).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1) * mh.BANDS, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in sigs], pa.binary()), lists], names=["doc_id", "sig", "keys"])

    return _documents(spark, d).where("doc_id IS NOT NULL AND t <> ''").mapInArrow(run, "doc_id long, sig binary, keys array<long>")


def document_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of the whole documents: mh.PERMUTATIONS values of 64 bits, as hexadecimal bytes."""
    return _document_signatures(spark, d).select("doc_id", F.lower(F.hex("sig")).alias("sig"))


def _document_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): doc_id and head, the lowest document of the same signature; and (a, b, estimate) of different heads that share a band, a < b."""
    stages = Stages(spark, "documents")
    s = stages.write(_document_signatures(spark, d), "signatures")
    w = Window.partitionBy("digest").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    members = stages.write(s.select("doc_id", F.unhex(F.md5("sig")).alias("digest")).select("doc_id", F.min("doc_id").over(w).alias("head")).distinct(), "members")
    heads = s.join(members.where("doc_id = head").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    b = heads.select("doc_id", F.posexplode("keys").alias("band", "key"))
    b = stages.write(b.join(b.groupBy("band", "key").count().where("count > 1").select("band", "key"), ["band", "key"], "left_semi"), "bands")
    p = b.alias("x").join(b.alias("y"), ["band", "key"]).where("x.doc_id < y.doc_id").select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    p = stages.write(p, "pairs")
    stages.sweep()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(i).to_pylist()), np.uint64).reshape(-1, mh.PERMUTATIONS) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array((x == y).mean(axis=1))], names=["a", "b", "estimate"])

    one = heads.select("doc_id", "sig")
    j = p.join(one.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(one.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
    return members, j.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, estimate double")


def document_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of documents that share a band, with the estimate of their similarity."""
    m, p = _document_pairs(spark, d)
    x, y = m.select(F.col("head").alias("a"), F.col("doc_id").alias("da")), m.select(F.col("head").alias("b"), F.col("doc_id").alias("db"))
    same = x.join(y, F.col("a") == F.col("b")).where("da < db").select("da", "db", F.lit(1.0).alias("estimate"))
    both = same.unionByName(p.join(x, "a").join(y, "b").select("da", "db", "estimate"))
    return both.select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"), "estimate")


def document_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Each document's most alike earlier one whose estimate reaches NEAR_DUPLICATE, lowest first among equals.

    A copy's is the head of its signature, for no other reaches 1; a head's is the best of earlier heads.
    """
    m, p = _document_pairs(spark, d)
    best = p.where(F.col("estimate") >= NEAR_DUPLICATE).groupBy(F.col("b").alias("doc_id")).agg(F.max_by(F.struct("a", "estimate"), F.struct("estimate", -F.col("a"))).alias("m"))
    copies = m.where("doc_id <> head").select("doc_id", F.col("head").alias("original"), F.lit(1.0).alias("estimate"))
    return copies.unionByName(best.select("doc_id", F.col("m.a").alias("original"), "m.estimate"))


def word_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "articles_raw").where("title IS NOT NULL").select("raw_offset", F.explode(tx.title_words(tx.shingle_text(F.col("title")))).alias("word"))
    n = w.groupBy("word").agg(F.count("*").alias("df"))
    return n.where("df >= 20")


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Equal texts: the first document of each group and how many copies it has."""
    t = table(spark, d, "documents").where("text IS NOT NULL AND text <> ''").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    return t.where("n > 1").select("first", "n")


QUERIES = {
    f.__name__: f
    for f in (
        lang_means, lang_centering, knn_topk, knn_earlier, knn_votes, semantic_search, centroids, story_cohesion, medoids, merge_candidates, similarity_graph,
        similarity_quantiles, recall_at_k, shingle_counts, minhash_signatures, lsh_candidates, near_duplicate_best, word_document_frequency, exact_duplicates,
        document_shingle_counts, document_signatures, document_candidates, document_near_duplicates,
    )
}

_V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) v, label FROM embeddings)"
_L = f"{_V}, l AS (SELECT *, ['en', 'es', 'de'][vec_id % 3 + 1] lang FROM v)"
_LONG = "u AS (SELECT {k}, unnest(v) x, generate_subscripts(v, 1) - 1 pos FROM {t})"
_S = f"{_V}, s AS (SELECT a.vec_id q, b.vec_id n, round(list_dot_product(a.v, b.v), 9) sim FROM v a JOIN v b ON a.vec_id <> b.vec_id)"
_TOP = "t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, n) rank FROM s {w} QUALIFY rank <= {k})"
_MEAN = "m AS (SELECT label, list(x ORDER BY pos) c FROM (SELECT label, pos, avg(x) x FROM u GROUP BY 1, 2) GROUP BY 1), c AS (SELECT label, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-12)) c FROM m)"
_FIT = f"WITH {_V}, {_LONG.format(k='label', t='v')}, {_MEAN}, f AS (SELECT label, vec_id, list_dot_product(v, c) fit FROM v JOIN c USING (label))"
_COEF = mh.coefficients(PERMS)
_NORM = r"e AS (SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) t FROM eval_items)"
_SH = f"{_NORM}, sh AS (SELECT DISTINCT item_id, substr(t, i::BIGINT, 5) s FROM (SELECT item_id, t, unnest(range(1, greatest(length(t) - 4, 1) + 1)) i FROM e WHERE t <> ''))"
_SIG = f"""{_SH}, h AS (SELECT item_id, ('0x' || substr(md5(s), 1, 15))::BIGINT::HUGEINT x FROM sh),
sg AS (SELECT item_id, [{', '.join(f'min((x * {a}::HUGEINT + {b}::HUGEINT) % {mh.PRIME}::HUGEINT)::BIGINT' for a, b in _COEF)}] sig FROM h GROUP BY 1)"""
_BANDS = ", ".join(f"({i}, array_to_string(sig[{i * ROWS + 1}:{i * ROWS + ROWS}], ','))" for i in range(PERMS // ROWS))
_CAND = f"""{_SIG}, bd AS (SELECT item_id, sig, unnest([{_BANDS}]) k FROM sg),
p AS (SELECT DISTINCT x.item_id a, y.item_id b, x.sig sa, y.sig sb FROM bd x JOIN bd y ON x.k = y.k AND x.item_id < y.item_id),
cand AS (SELECT a, b, round(len(list_filter(list_zip(sa, sb), lambda z: z[1] = z[2])) / {PERMS}::DOUBLE, 6) estimate FROM p)"""

SQL = {
    "lang_means": f"""WITH {_L}, {_LONG.format(k='lang', t='l')} SELECT lang, pos::INT pos, round(avg(x), 6) x FROM u WHERE lang IN (SELECT lang FROM l GROUP BY 1 HAVING count(*) >= 30) GROUP BY 1, 2
UNION ALL SELECT NULL, pos::INT, round(avg(x), 6) FROM u GROUP BY pos""",
    "lang_centering": f"""WITH {_L}, {_LONG.format(k='lang', t='l')}, m AS (SELECT lang, list(x ORDER BY pos) m FROM (SELECT lang, pos, avg(x) x FROM u GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT vec_id, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) c FROM l JOIN m USING (lang)),
n AS (SELECT vec_id, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-12)) c FROM c)
SELECT vec_id, round(c[1], 6) x0, round(c[64], 6) x63, round(list_dot_product(c, c), 6) norm FROM n""",
    "knn_topk": f"WITH {_S}, {_TOP.format(w='', k=K)} SELECT q, n, round(sim, 6) sim, rank FROM t",
    "knn_earlier": f"WITH {_S}, {_TOP.format(w='WHERE n < q', k=K)} SELECT q, n, round(sim, 6) sim, rank FROM t",
    "knn_votes": f"""WITH {_S}, {_TOP.format(w='WHERE n < q', k=K)}, g AS (SELECT q, label story, sum(sim) total, count(*) n FROM t JOIN v ON v.vec_id = t.n WHERE sim >= 0.3 GROUP BY 1, 2)
SELECT q, story, round(total, 6) total, n, row_number() OVER (PARTITION BY q ORDER BY total DESC, story) rank FROM g""",
    "semantic_search": f"""WITH {_S}, {_TOP.format(w='WHERE q % 100 = 0', k=60)} SELECT q, label, round(max(sim), 6) best, count(*) hits, round(max(sim), 6) >= 0.86 strong FROM t JOIN v ON v.vec_id = t.n GROUP BY 1, 2""",
    "centroids": f"WITH {_V}, {_LONG.format(k='label', t='v')}, {_MEAN} SELECT label, (generate_subscripts(c, 1) - 1)::INT pos, round(unnest(c), 6) x FROM c",
    "story_cohesion": f"{_FIT} SELECT label, count(*) n, round(avg(fit), 6) cohesion, round(min(fit), 6) weakest FROM f GROUP BY 1",
    "medoids": f"{_FIT} SELECT label, max_by(vec_id, (round(fit, 9), -vec_id)) medoid FROM f GROUP BY 1",
    "merge_candidates": f"""WITH {_V}, w AS (SELECT (vec_id // 25) * 100 + label label, v FROM v), {_LONG.format(k='label', t='w')}, {_MEAN}
SELECT x.label a, y.label b, round(list_dot_product(x.c, y.c), 6) sim, list_dot_product(x.c, y.c) >= 0.4 alone FROM c x JOIN c y ON x.label < y.label WHERE list_dot_product(x.c, y.c) >= 0.25""",
    "similarity_graph": f"WITH {_S}, {_TOP.format(w='WHERE sim >= 0.35', k=3)} SELECT least(q, n) a, greatest(q, n) b, round(max(sim), 6) sim FROM t GROUP BY 1, 2",
    "similarity_quantiles": f"WITH {_S}, o AS (SELECT q, round(max(sim), 6) sim FROM s GROUP BY 1) SELECT " + ", ".join(f"quantile_disc(sim, {p}) p{int(p * 100)}" for p in (0.0, 0.1, 0.5, 0.9)) + " FROM o",
    "recall_at_k": f"WITH {_S}, {_TOP.format(w='', k=K)} SELECT round(avg((a.label = b.label)::INT), 6) recall FROM t JOIN v a ON a.vec_id = t.q JOIN v b ON b.vec_id = t.n",
    "shingle_counts": f"WITH {_SH} SELECT item_id, count(s)::INT n FROM e LEFT JOIN sh USING (item_id) GROUP BY 1",
    "minhash_signatures": f"WITH {_SIG} SELECT item_id, array_to_string(sig, ',') sig FROM sg",
    "lsh_candidates": f"WITH {_CAND} SELECT * FROM cand",
    "near_duplicate_best": f"WITH {_CAND} SELECT b item_id, max_by(a, (estimate, -a)) original, max(estimate) estimate FROM cand GROUP BY 1",
    "word_document_frequency": r"""WITH w AS (SELECT raw_offset, list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^\p{N}+$'))) ws FROM articles_raw WHERE title IS NOT NULL)
SELECT word, count(*) df FROM (SELECT unnest(ws) word FROM w) GROUP BY 1 HAVING count(*) >= 20""",
    "exact_duplicates": "SELECT min(doc_id) AS first, count(*) n FROM documents WHERE text <> '' GROUP BY text HAVING count(*) > 1",
}
