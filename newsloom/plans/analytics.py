"""Queries on graphs, snapshots, caches and evaluations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.engine.core import Config
from newsloom.operators import graph
from newsloom.operators import readmodel as rm
from newsloom.operators import vectors as vx
from newsloom.session import table
from newsloom.streaming import stories


def _log(spark: SparkSession, d: str) -> DataFrame:
    return rm.log(table(spark, d, "story_events"))


def duplicate_roots(spark: SparkSession, d: str) -> DataFrame:
    """The original that each duplicate goes back to, over chains of copies."""
    dup = _log(spark, d).where("kind = 'article_added'").select(rm.field("article_id").alias("article_id"), rm.field("duplicate_of").alias("of")).where("of IS NOT NULL AND article_id <> of")
    return graph.roots(dup, "article_id", "of")


def lineage_roots(spark: SparkSession, d: str) -> DataFrame:
    """Where merged stories end up after chains of merges."""
    m = rm.lineage(_log(spark, d)).where("kind = 'merged' AND parent <> child")
    return graph.roots(m, "parent", "child")


def story_graph(spark: SparkSession, d: str) -> DataFrame:
    """Similarity edges between embeddings, and lineage edges between neighbours in number, which win."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vx.doubles(F.col("embedding")).alias("v"))
    sim = vx.pairs_of(v, "id", "v", 3, 0.35)
    lin = v.where("id % 7 = 0").select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    return graph.edges(sim, lin, v).select("a", "b", "kind", F.round("weight", 6).alias("weight"))


def snapshot_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Stories alive at one position against those alive at a later one."""
    s = rm.stories(_log(spark, d))
    return graph.reconcile(s.where(rm.alive(300)).select("story_id"), s.where(rm.alive(600)).select("story_id"), "story_id")


def node_eviction(spark: SparkSession, d: str) -> DataFrame:
    s = rm.stories(_log(spark, d)).where("source_count IS NOT NULL")
    return graph.evicted(s.select(F.col("story_id").alias("id"), F.col("source_count").alias("sources"), F.col("updated_offset").alias("last_ms")), 40).select("id")


def node_display(spark: SparkSession, d: str) -> DataFrame:
    """Size, recency and age of each story's node as of the log's end."""
    e = _log(spark, d).where("kind IN ('created', 'updated')")
    top = e.agg(F.max("event_time_ms").alias("now"))
    s = e.groupBy("story_id").agg(F.max("event_time_ms").alias("t"), F.count("*").alias("n")).join(F.broadcast(top))
    ago = F.col("now") - F.col("t")
    return s.select("story_id", F.round(graph.radius(F.col("n")), 6).alias("radius"), F.round(graph.recency(ago / 3_600_000), 6).alias("recency"), graph.relative_time(ago).alias("age"))


def transcript_layout(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "eval_items").where("text IS NOT NULL").select("item_id", F.lit(0).alias("part"), F.regexp_replace("text", r"\s+", " ").alias("text"))
    return graph.layout(t, "item_id", "part", "text")


def translation_cache(spark: SparkSession, d: str) -> DataFrame:
    """Headlines whose translation is not in the cache, by hash; cached are those of the first batches."""
    t = table(spark, d, "articles_raw").where("title IS NOT NULL").select("delivery_batch", F.sha2("title", 256).alias("hash"))
    return t.select("hash").distinct().join(t.where("delivery_batch < 5").select("hash").distinct(), "hash", "left_anti")


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    """Stories, singletons, those of several sources and languages, the largest, over all memberships."""
    m = rm.memberships(_log(spark, d)).where("to_offset IS NULL").select("article_id", "story_id").distinct()
    a = table(spark, d, "articles_embedded").select("input_offset", "article.*").groupBy("id").agg(F.min_by(F.struct("source_id", "lang"), "input_offset").alias("a"))
    s = m.join(a, m.article_id == a.id).groupBy("story_id").agg(F.count("*").alias("n"), F.countDistinct("a.source_id").alias("s"), F.countDistinct("a.lang").alias("l"))
    return s.agg(F.count("*").alias("stories"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("s") >= 2).alias("multi_source"), F.count_if(F.col("l") >= 2).alias("cross_language"), F.max("n").alias("largest"))


def rounding_precision(spark: SparkSession, d: str) -> DataFrame:
    """Cosine between vectors and their 8-bit roundings: lowest, first percentile, median."""
    v = table(spark, d, "embeddings").select(vx.doubles(F.col("embedding")).alias("v"))
    q = F.transform("v", lambda x: F.rint(x * 127) / 127)
    c = v.select(F.round(vx.dot(F.col("v"), q) / F.sqrt(vx.dot(F.col("v"), F.col("v")) * vx.dot(q, q)), 6).alias("cos"))
    return vx.quantiles(c, "cos", [0.0, 0.01, 0.5])


def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    """Time from fetch to delivery per source kind: median, 99th percentile, mean."""
    t = table(spark, d, "articles_raw").where("delivered_at IS NOT NULL AND fetched_at_ms IS NOT NULL").select("source_kind", (F.unix_millis("delivered_at") - F.col("fetched_at_ms")).alias("ms"))
    g = t.groupBy("source_kind").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ms)").alias("p50"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY ms)").alias("p99"), F.round(F.avg("ms"), 3).alias("mean"))
    return g


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The engine's outcomes under a grid of thresholds, one row each."""
    grid = [(n, c) for n in (0.5, 0.8) for c in (0.5, 0.8)]
    all_runs = stories.run_configs(stories.inputs(table(spark, d, "articles_embedded")), [Config(neighbor=n, centroid=c) for n, c in grid], tell=False)
    count = lambda label: F.count_if((F.col("seq") == -1) & (F.col("outcome") == label))
    g = all_runs.groupBy("config").agg(count("created").alias("stories"), count("joined").alias("joined"), count("late_dropped").alias("late_dropped"))
    setting = F.element_at(F.array(*[F.struct(F.lit(n).alias("neighbor"), F.lit(c).alias("centroid")) for n, c in grid]), F.col("config") + 1).alias("s")
    return g.select(setting, "*").select("s.*", "stories", "joined", "late_dropped")


QUERIES = {
    f.__name__: f
    for f in (
        duplicate_roots, lineage_roots, story_graph, snapshot_reconcile, node_eviction, node_display, transcript_layout, translation_cache,
        eval_summary, rounding_precision, latency_stats, threshold_sweep,
    )
}

from newsloom.plans.stories import _ART, _J, _LOG, _MEM, _ST  # noqa: E402

_WALK = """w AS (SELECT c, p FROM l UNION SELECT w.c, l.p FROM w JOIN l ON l.c = w.p),
r AS (SELECT c, coalesce(min(p) FILTER (WHERE p NOT IN (SELECT c FROM l)), min(p) FILTER (WHERE p IN (SELECT c FROM w WHERE c = p))) root FROM w GROUP BY 1)"""
_R = "(3 + 4.4 * sqrt(greatest(n, 1)))"

SQL = {
    "duplicate_roots": f"""WITH {_LOG}, d AS (SELECT {_J('article_id')} a, {_J('duplicate_of')} o FROM ev WHERE kind = 'article_added'),
l AS (SELECT a c, min(o) p FROM d WHERE a <> o GROUP BY 1), {_WALK} SELECT c article_id, root FROM r""",
    "lineage_roots": f"""WITH {_LOG}, m AS (SELECT unnest(json_extract_string(payload, '$.source_story_ids[*]')) a, {_J('target_story_id')} o FROM ev WHERE kind = 'merged'),
l AS (SELECT a c, min(o) p FROM m WHERE a <> o GROUP BY 1), {_WALK} SELECT c parent, root FROM r""",
    "story_graph": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) v FROM embeddings),
s AS (SELECT a.vec_id q, b.vec_id n, round(list_dot_product(a.v, b.v), 9) sim FROM v a JOIN v b ON a.vec_id <> b.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, n) r FROM s WHERE sim >= 0.35 QUALIFY r <= 3),
lin AS (SELECT vec_id a, vec_id + 1 b FROM v WHERE vec_id % 7 = 0 AND vec_id + 1 IN (SELECT vec_id FROM v)),
sm AS (SELECT least(q, n) a, greatest(q, n) b, max(sim) w FROM t GROUP BY 1, 2)
SELECT a, b, 'lineage' kind, 1.0::DOUBLE weight FROM lin UNION ALL SELECT a, b, 'similar', round(w, 6) FROM sm WHERE (a, b) NOT IN (SELECT (a, b) FROM lin)""",
    "snapshot_reconcile": f"""WITH {_LOG}, {_ST}, h AS (SELECT story_id FROM st WHERE created_offset <= 300 AND (closed_offset IS NULL OR closed_offset > 300)),
s AS (SELECT story_id FROM st WHERE created_offset <= 600 AND (closed_offset IS NULL OR closed_offset > 600))
SELECT coalesce(h.story_id, s.story_id) story_id, CASE WHEN h.story_id IS NULL THEN 'new' WHEN s.story_id IS NULL THEN 'gone' ELSE 'kept' END state FROM h FULL JOIN s ON h.story_id = s.story_id""",
    "node_eviction": f"WITH {_LOG}, {_ST}, o AS (SELECT story_id, row_number() OVER (ORDER BY source_count DESC, updated_offset DESC, story_id) r FROM st WHERE source_count IS NOT NULL) SELECT story_id id FROM o WHERE r > 40",
    "node_display": f"""WITH RECURSIVE ev AS (SELECT * FROM story_events WHERE input_offset IS NOT NULL AND seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY input_offset, seq ORDER BY feed_pos) = 1),
e AS (SELECT * FROM ev WHERE kind IN ('created', 'updated')), s AS (SELECT story_id, max(event_time_ms) t, count(*) n FROM e GROUP BY 1),
g AS (SELECT *, (SELECT max(event_time_ms) FROM e) - t ago FROM s), h AS (SELECT *, ago / 3600000.0::DOUBLE hh, ago // 60000 m FROM g)
SELECT story_id, round(least(56.0, {_R}), 6) radius,
  round(CASE WHEN hh <= 0 THEN 0.0::DOUBLE WHEN hh < 1 THEN hh / 3 WHEN hh < 6 THEN 1.0::DOUBLE / 3 + (hh - 1) / 15 WHEN hh < 24 THEN 2.0::DOUBLE / 3 + (hh - 6) / 54 ELSE 1.0::DOUBLE END, 6) recency,
  CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN m < 1440 THEN (m // 60) || ' h ago' ELSE (m // 1440) || ' d ago' END age FROM h""",
    "transcript_layout": r"""WITH w AS (SELECT item_id, unnest(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')) word, generate_subscripts(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), 1) - 1 place FROM eval_items WHERE text IS NOT NULL)
SELECT item_id, place::INT place, word, (sum(length(word) + 1) OVER (PARTITION BY item_id ORDER BY place ROWS UNBOUNDED PRECEDING) - length(word) - 1)::BIGINT from_char FROM w""",
    "translation_cache": "SELECT DISTINCT sha256(title) hash FROM articles_raw WHERE title IS NOT NULL AND title NOT IN (SELECT title FROM articles_raw WHERE title IS NOT NULL AND delivery_batch < 5)",
    "eval_summary": f"""WITH {_LOG}, {_MEM}, {_ART}, s AS (SELECT story_id, count(*) n, count(DISTINCT source_id) s, count(DISTINCT lang) l
  FROM (SELECT DISTINCT article_id, story_id FROM mem WHERE to_offset IS NULL) JOIN art ON art.id = article_id GROUP BY 1)
SELECT count(*) stories, count(*) FILTER (WHERE n = 1) singletons, count(*) FILTER (WHERE s >= 2) multi_source, count(*) FILTER (WHERE l >= 2) cross_language, max(n) largest FROM s""",
    "rounding_precision": """WITH v AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) v FROM embeddings), q AS (SELECT v, list_transform(v, lambda x: round_even(x * 127, 0) / 127) q FROM v),
c AS (SELECT round(list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)), 6) cos FROM q)
SELECT quantile_disc(cos, 0.0) p0, quantile_disc(cos, 0.01) p1, quantile_disc(cos, 0.5) p50 FROM c""",
    "latency_stats": """WITH t AS (SELECT source_kind, epoch_ms(delivered_at) - fetched_at_ms ms FROM articles_raw WHERE delivered_at IS NOT NULL AND fetched_at_ms IS NOT NULL)
SELECT source_kind, quantile_disc(ms, 0.5) p50, quantile_disc(ms, 0.99) p99, round(avg(ms), 3) mean FROM t GROUP BY 1""",
}
