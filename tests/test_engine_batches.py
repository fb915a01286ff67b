"""The story engine over batches: neighbours looked up ahead, bookkeeping by time, one preparation for several configurations."""

import numpy as np
import pytest

from newsloom.engine import core
from newsloom.engine.core import Config, StoryEngine, Vectors
from newsloom.sources import synth


def inputs(n, seed=3):
    rows = [synth.article(i, seed, dim=16, topics=16) for i in range(n)]
    out = [{**r["article"], "vector": r["vector"], "model_version": "synth"} for r in rows]
    for i in range(0, n, 37):  # some that can't be used, some of other lengths of vector
        out[i] |= {"vector": [None, np.ones(3), np.full(16, np.nan), np.zeros(16), 5 * np.asarray(out[i]["vector"])][i // 37 % 5]}
    return out


@pytest.mark.parametrize("config", [Config(lineage_every=7), Config(lineage_every=20, neighbor=0.8, centroid=0.8), Config(neighbor=-1.0, centroid=-1.0, k=3), Config(idle_ms=3_600_000, dedup_ms=7_200_000, seen_ms=7_200_000)])
def test_many_at_once_equal_one_at_a_time(config, monkeypatch):
    rows = inputs(700)
    one = StoryEngine(config)
    want = [one.process(r, i) for i, r in enumerate(rows)]
    scans, scan = [], Vectors.nearest
    monkeypatch.setattr(Vectors, "nearest", lambda *a: scans.append(1) or scan(*a))
    e = StoryEngine(config)
    assert list(e.process_all(rows, range(len(rows)))) == want
    # Whole scans only where those kept of an input don't do.
    assert len(scans) < (40 if config.neighbor > 0 else len(rows))
    assert e.seen == one.seen and e.word_df == one.word_df and e.copies.band == one.copies.band and e.stories.keys() == one.stories.keys()
    silent = StoryEngine(config, tell=False)
    assert [x[:2] for x in silent.process_all(rows, range(len(rows)))] == [x[:2] for x in want] and not silent.events


def test_what_is_remembered_is_what_a_full_look_would_keep():
    c = Config(idle_ms=5 * 3_600_000, dedup_ms=8 * 3_600_000, seen_ms=9 * 3_600_000, lateness_ms=3_600_000)
    e = StoryEngine(c)
    for i, r in enumerate(inputs(600, 11)):
        ticks = e.tick
        e.process(r, i)
        if e.tick == ticks or e.watermark is None or i == 0:
            continue
        now = e.watermark
        fresh = {k for k in e.articles if k == e.next_key - 1}
        assert all(s.last >= now - c.idle_ms or set(s.members) <= fresh for s in e.stories.values())
        assert set(e.articles) == {m for s in e.stories.values() for m in s.members}
        assert set(e.copies.signature) - fresh == {k for k in e.copies.signature if e.articles[k].time >= now - c.dedup_ms} - fresh
        assert all(t >= now - c.seen_ms for x, t in e.seen.items() if x != r["id"])
        words = {}
        for a in e.articles.values():
            for w in a.words:
                words[w] = words.get(w, 0) + 1
        assert e.word_df == words
    assert e.next_key > len(e.articles) + 100


def test_neighbours_looked_up_ahead_are_exact(monkeypatch):
    monkeypatch.setattr(core, "CHUNK", 50)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 8))
    x[::9] *= 1e3
    x[200:260] = x[0]
    for have in (0, 1, 130, 300):
        index = Vectors()
        for i in range(have):
            index.add(3 * i, x[i])
        live = lambda k: k % 2 == 0
        for known in index.ahead(x[have:], 0.5):
            i = have + known.place
            got = index.nearest_of(known, 5, 0.5, live)
            exact = (x[:i].astype(np.float32).astype(float) @ x[i].astype(np.float32).astype(float)).astype(np.float32)
            want = sorted(((-s, 3 * j) for j, s in enumerate(exact.tolist()) if s >= 0.5 and live(3 * j)))[:5]
            assert [k for _, k in got] == [k for _, k in want] and np.allclose([s for s, _ in got], [-s for s, _ in want], rtol=1e-6)
            index.add(3 * i, x[i])
            known.added[known.place] = 3 * i


def test_runs_on_spark_share_what_depends_on_one_article(spark):
    from newsloom.streaming import stories

    log = stories.inputs(synth.stream(spark, 300, seed=5, dim=16, topics=16))
    configs = [Config(), Config(neighbor=0.9, centroid=0.9)]
    both = stories.run_configs(log, configs, tell=False)
    got = [tuple(r) for r in both.orderBy("config", "input_offset").select("config", "input_offset", "outcome", "late").collect()]
    plan = both._jdf.queryExecution().executedPlan().toString()
    rows = [{**r.asDict(), "vector": np.asarray(r.vector, float)} for r in log.orderBy("input_offset").collect()]
    assert got == [(k, i, *o) for k, c in enumerate(configs) for i, o in enumerate(x[:2] for x in StoryEngine(c).process_all(rows, range(300)))]
    assert plan.count("MapInPandas") >= 2 and "SinglePartition" in plan


def test_outcomes_are_counted_without_making_events(spark, tiny, monkeypatch):
    from newsloom.plans import streams
    from newsloom.session import table
    from newsloom.streaming import stories

    whole = stories.outcomes_of(stories.run_batch(stories.inputs(table(spark, tiny, "articles_embedded")))).collect()
    told, run = [], stories.run_batch
    monkeypatch.setattr(stories, "run_batch", lambda *a, **k: told.append(r := run(*a, **k)) or r)
    want = {}
    for r in whole:
        want[r.outcome, r.late] = want.get((r.outcome, r.late), 0) + 1
    assert {(r.outcome, r.late): r.n for r in streams.story_engine_outcomes(spark, tiny).collect()} == want and sum(want.values()) == len(whole)
    assert stories.events_of(told[0]).count() == 0


def test_each_configuration_runs_in_a_task_of_its_own(spark):
    from pyspark import TaskContext

    from newsloom.streaming import stories

    log, run = stories.inputs(synth.stream(spark, 60, seed=5, dim=16, topics=16)), stories._run

    def named(engine, pdf):
        return [(*r[:2], str(TaskContext.get().taskAttemptId()), *r[3:]) for r in run(engine, pdf)]

    stories._run = named
    try:
        got = stories.run_configs(log, [Config(), Config(neighbor=0.8), Config(k=3)], tell=False).select("config", "outcome").distinct().collect()
    finally:
        stories._run = run
    assert len({r.config for r in got}) == 3 == len({r.outcome for r in got})
