"""Queries of this subpackage, each over its whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, encoding, knn, language, leakage, neardup, splitting, truncation
from newsloom.operators import delivery
from newsloom.session import Stages, table

#: Where the public tokenizers' files lie.
TOKENIZERS = os.environ.get("NEWSLOOM_TOKENIZERS", bpe.DEFAULT_FOLDER)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "articles_raw"))


def p1_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts."""
    return truncation.by_source(table(spark, d, "articles_raw"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(table(spark, d, "articles_raw"), table(spark, d, "lang_samples"))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of each headline and sentence."""
    rows = table(spark, d, "articles_raw")
    found = language.identify(rows, table(spark, d, "lang_samples"), rows)
    return found.select("raw_offset", "main", F.inline("segments"))


def _graph(spark: SparkSession, d: str) -> knn.Graph:
    return knn.Graph(table(spark, d, "articles_embedded"), "input_offset", "vector", "model_version", size=64)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.pairs(_graph(spark, d).neighbours())


def p6_search(spark: SparkSession, d: str) -> DataFrame:
    """Greedy search of every hundredth row's vector against all; its own row is among the answers."""
    asking = table(spark, d, "articles_embedded").where("input_offset % 100 = 0")
    return _graph(spark, d).search(asking, "input_offset", "vector", "model_version")


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates among messages that have an identifier, each once. Texts are made normal once; repeats are sorted out on digests."""
    rows = table(spark, d, "articles_raw").where("id IS NOT NULL").select("id", "fetched_at_ms", "raw_offset", "title", "summary")
    stages = Stages(spark, "neardup")
    normal = stages.write(neardup.normalized(rows), "normal")
    members = delivery.keep_one(normal.drop("text")).select(delivery.message_key("id").alias("key"), "digest")
    return neardup.near_duplicates(normal.select("digest", "text"), members, stages)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs(*_near(spark, d)).select("id_a", "id_b")


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Group and number of links of each article; copies of one text share both."""
    return neardup.groups(*_near(spark, d)).select(F.col("key").alias("id"), "group", "links")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.token_ids(table(spark, d, "documents"), folder=TOKENIZERS)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents."""
    return _leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("longest").alias("longest"))


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """All documents, without the leaked spans that exceed the limits of length and coverage."""
    return leakage.without_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "documents"), folder=TOKENIZERS)


QUERIES = {f.__name__: f for f in (p1_found, p1_sources, p2_found, p2_segments, p6_found, p6_search, p7_found, p7_groups, p8_ids, p9_found, p9_items, p9_cleaned, p10_pieces)}
_NEAR = """v AS (
  SELECT input_offset o, model_version m, list_transform(vector, lambda x: x::DOUBLE) x FROM articles_embedded
  WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
c AS (SELECT a.o a, b.o b, round(list_cosine_similarity(a.x, b.x), 6) s FROM v a JOIN v b ON a.m = b.m AND a.o <> b.o),
n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) r FROM c WHERE s >= 0.82)"""

_TEXTS = r"""m AS (
  SELECT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) id, trim(regexp_replace(lower(CASE WHEN coalesce(summary, '') = '' THEN coalesce(title, '') ELSE coalesce(title, '') || chr(10) || summary END), '[^\p{L}\p{N}]+', ' ', 'g')) t
  FROM articles_raw WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) ORDER BY fetched_at_ms NULLS LAST, raw_offset) = 1),
x AS (SELECT row_number() OVER (ORDER BY t) tid, t, list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) g FROM (SELECT DISTINCT t FROM m WHERE length(t) >= 5)),
e AS (SELECT tid, len(g) n, unnest(g) k FROM x),
f AS (SELECT k, count(*) df FROM e GROUP BY 1),
p AS (SELECT tid, n, k FROM e JOIN f USING (k) QUALIFY row_number() OVER (PARTITION BY tid ORDER BY df, k) <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.tid a, b.tid b FROM p a JOIN p b ON a.k = b.k AND a.tid < b.tid AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
l AS (SELECT a, b FROM (SELECT a, b, len(list_intersect(u.g, v.g)) s, len(u.g) + len(v.g) n FROM c JOIN x u ON u.tid = a JOIN x v ON v.tid = b) WHERE 5 * s >= 4 * (n - s)),
w AS (SELECT id, tid FROM m JOIN x USING (t))"""

SQL: dict[str, str] = {
    # Frequent substrings last: two similar sets share one of the first of theirs.
    "p7_found": f"""WITH {_TEXTS} SELECT least(y.id, z.id) id_a, greatest(y.id, z.id) id_b FROM w y JOIN w z ON y.tid = z.tid AND y.id < z.id
UNION ALL SELECT least(y.id, z.id), greatest(y.id, z.id) FROM l JOIN w y ON y.tid = a JOIN w z ON z.tid = b""",
    "p7_groups": f"""WITH RECURSIVE {_TEXTS}, d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT tid a, tid b FROM x UNION SELECT r.a, d.b FROM r JOIN d ON d.a = r.b),
n AS (SELECT r.a tid, min(w.id) g FROM r JOIN w ON w.tid = r.b GROUP BY 1)
SELECT w.id, n.g AS "group", (SELECT count(*) FROM d WHERE d.a = w.tid) links FROM w JOIN n USING (tid)""",
    "p6_found": f"WITH {_NEAR} SELECT DISTINCT least(a, b) offset_a, greatest(a, b) offset_b FROM n WHERE r <= 5",
}
