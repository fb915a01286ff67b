"""Graph bookkeeping and streams by event time."""

from pyspark.sql import functions as F

from newsloom.operators import graph, vectors
from newsloom.streaming import windows


def test_roots_follow_long_chains_and_refuse_circles(spark):
    n = 40
    df = spark.createDataFrame([(i, i - 1) for i in range(1, n)] + [(None, 3), (100, None)], "c int, p int")
    assert {(r.c, r.root) for r in graph.roots(df, "c", "p").collect()} == {(i, 0) for i in range(1, n)}
    assert graph.roots(df.limit(0), "c", "p").count() == 0
    # Circles: their lowest node is the root, of what leads into them too.
    ring = spark.createDataFrame([(5, 4), (4, 7), (7, 5), (1, 7), (0, 1), (9, 8)], "c int, p int")
    assert {(r.c, r.root) for r in graph.roots(ring, "c", "p").collect()} == {(5, 4), (4, 4), (7, 4), (1, 4), (0, 4), (9, 8)}


def test_graph_bookkeeping(spark):
    nodes = spark.createDataFrame([("a", 3, 1), ("b", 3, 2), ("c", 1, 9)], "id string, sources int, last_ms int")
    assert {r.id for r in graph.evicted(nodes, 2).collect()} == {"c"} and graph.evicted(nodes, 5).count() == 0
    sim = spark.createDataFrame([("a", "b", 0.5), ("a", "z", 0.9)], "a string, b string, sim double")
    lin = spark.createDataFrame([("b", "a"), ("b", "c")], "parent string, child string")
    assert {(r.a, r.b, r.kind) for r in graph.edges(sim, lin, nodes).collect()} == {("a", "b", "lineage"), ("b", "c", "lineage")}
    assert {(r.id, r.state) for r in graph.reconcile(nodes.where("id <> 'c'"), nodes.where("id <> 'a'"), "id").collect()} == {("a", "gone"), ("b", "kept"), ("c", "new")}


def test_nearest_with_ties_and_empty_sides(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i < 4 else [0.0, 1.0]) for i in range(6)], "k long, v array<double>")
    got = {(r.q, r.n, r.rank) for r in vectors.nearest(v.where("k = 2"), v, "k", "v", 2).collect()}
    assert got == {(2, 0, 1), (2, 1, 2)}
    assert vectors.nearest(v.limit(0), v, "k", "v", 2).count() == 0
    assert {r.n for r in vectors.nearest(v.where("k = 1"), v, "k", "v", 9, earlier=True).collect()} == {0}


def test_streams_by_event_time(spark, tmp_path):
    h = 3_600_000
    src = str(tmp_path / "in")
    for k, rows in enumerate([[("a", 0), ("a", 1), ("b", 5 * h)], [("a", 2), ("c", 80 * h)], [("d", 200 * h), ("b", 200 * h)]]):
        spark.createDataFrame(rows, "id string, t long").coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema("id string, t long").option("maxFilesPerTrigger", 1).parquet(src)

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.id for r in run(windows.first_seen(s, "id", "t", "1000 hours"), "seen")) == ["a", "b", "c", "d"]
    batch = spark.read.parquet(src)
    assert sorted(r.id for r in windows.first_seen(batch, "id", "t").collect()) == ["a", "b", "c", "d"]
    total = {(r.start_ms, r.n) for r in windows.counts(batch, "t", "1 hour").collect()}
    assert total == {(0, 3), (5 * h, 1), (80 * h, 1), (200 * h, 2)}
    got = {(r.start_ms, r.n) for r in run(windows.counts(s, "t", "1 hour"), "counted")}
    assert got <= total and (5 * h, 1) in got
    assert {(r.id, r.n) for r in windows.sessions(batch, "id", "t", "48 hours").collect()} == {("a", 3), ("b", 1), ("c", 1), ("d", 1)}
