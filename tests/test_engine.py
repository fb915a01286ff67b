"""Scenarios of the story engine, state that is saved anywhere, and runs on Spark."""

import pickle

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.engine.core import CREATED, EXACT_DUP, INVALID, JOINED, LATE_DROPPED, NEAR_DUP, Config, StoryEngine
from newsloom.functions import minhash
from newsloom.operators import briefing, readmodel
from newsloom.sources import synth

H = 3_600_000
T0 = 1_700_000_000_000


def row(i, axis=0, t=T0, title=None, jitter=0.05, source=None, id_=None):
    v = np.zeros(8)
    v[axis] = 1
    v[(axis + 1) % 8] = jitter * (i % 5) / 5
    return {"id": id_ or f"{i:032x}", "title": title or f"headline {'abcdefgh'[axis]} number {i * 7919} about thing {i * 104729}", "summary": "", "source_id": source or f"s{i % 3}", "lang": "en", "published_at_ms": t, "fetched_at_ms": t, "vector": v / np.linalg.norm(v), "model_version": "m"}


def kinds(events):
    return [e["kind"] for e in events]


def test_outcomes_in_order():
    e = StoryEngine()
    a = row(1, title="the mayor of the town resigns after a long night of talks")
    assert e.process(a, 0)[0] == CREATED
    o, _, ev = e.process(row(2), 1)
    assert (o, kinds(ev)) == (JOINED, ["article_added", "updated"])
    o, _, ev = e.process({**row(3), "title": a["title"] + "!", "source_id": "other"}, 2)
    assert (o, kinds(ev)) == (NEAR_DUP, ["article_added", "updated"])
    assert e.process(row(4, axis=4), 3)[0] == CREATED
    assert e.process(row(4, axis=4), 4) == (EXACT_DUP, False, [])
    assert len({x["event_id"] for x in ev}) == len(ev)


@pytest.mark.parametrize("bad", [{"id": ""}, {"vector": None}, {"vector": []}, {"vector": np.ones(3)}, {"vector": np.full(8, np.nan)}])
def test_invalid_inputs_change_nothing(bad):
    e = StoryEngine()
    e.process(row(1), 0)
    before = pickle.dumps(sorted(e.articles)), e.inputs
    assert e.process({**row(2), **bad}, 1)[0] == INVALID
    assert before == (pickle.dumps(sorted(e.articles)), e.inputs)


def test_late_rows_join_but_never_create():
    e = StoryEngine()
    e.process(row(1, t=T0), 0)
    e.process(row(2, axis=4, t=T0 + 40 * H), 1)
    assert e.process(row(3, t=T0 + 10 * H), 2)[:2] == (JOINED, True)
    assert e.process(row(4, axis=2, t=T0 + 10 * H), 3)[:2] == (LATE_DROPPED, True)
    assert e.process(row(4, axis=2, t=T0 + 10 * H), 4)[0] == EXACT_DUP
    assert e.process(row(5, axis=2, t=T0 + 39 * H), 5)[0] == CREATED


def test_idle_stories_close_and_leave_the_index():
    e = StoryEngine()
    e.process(row(1), 0)
    _, _, ev = e.process(row(2, axis=4, t=T0 + 80 * H), 1)
    assert kinds(ev) == ["closed", "created"] and ev[0]["event_time_ms"] == e.watermark
    assert e.vectors.n == 1 and len(e.articles) == 1


@pytest.mark.parametrize("k,outcome", [(1, CREATED), (10, JOINED)])
def test_established_story_needs_two_votes(k, outcome):
    e = StoryEngine(Config(k=k, cohesion_margin=9.0, established_votes=2, established=3))
    rows = [row(i) for i in range(4)]
    big = StoryEngine(Config(cohesion_margin=9.0))
    for i, r in enumerate(rows):
        big.process(r, i)
    e.__dict__.update({**big.__dict__, "c": e.c})
    assert e.process(row(50), 9)[0] == outcome


def test_story_of_two_narratives_splits_and_one_does_not():
    c = Config(lineage_every=5, neighbor=-1.0, centroid=-1.0, cohesion_margin=9.0, established_votes=0)
    e, seen = StoryEngine(c), []
    for i in range(40):
        seen += kinds(e.process(row(i, axis=4 * (i % 2)), i)[2])
    assert "split" in seen
    e, seen = StoryEngine(c), []
    for i in range(40):
        seen += kinds(e.process(row(i), i)[2])
    assert "split" not in seen


def test_alike_stories_merge_once():
    c = Config(lineage_every=5, neighbor=2.0)
    e, seen = StoryEngine(c), []
    for i in range(12):
        seen += kinds(e.process(row(i), i)[2])
    assert "merged" not in seen  # each has one article: too few
    c = Config(lineage_every=6, cohesion_margin=0.0, centroid=0.99, neighbor=0.9)
    e, seen = StoryEngine(c), []
    for i in range(60):
        v = np.zeros(8)
        v[0 if i < 12 else 4], v[1] = 1, 0.5 * (i % 2) if i < 12 else 0
        seen += kinds(e.process({**row(i), "vector": v / np.linalg.norm(v)}, i)[2])
    assert seen.count("merged") == 1  # and the two stay together


def inputs(n, seed=3):
    out = []
    for i in range(n):
        r = synth.article(i, seed, dim=16, topics=16)
        out.append({**r["article"], "vector": r["vector"], "model_version": "synth"})
    return out


@settings(max_examples=5, deadline=None)
@given(seed=st.integers(0, 1000), cut=st.floats(0.1, 0.9))
def test_restore_anywhere(seed, cut):
    c, rows = Config(lineage_every=7), inputs(220, seed)
    one = StoryEngine(c)
    want = [one.process(r, i)[2] for i, r in enumerate(rows)]
    e, at, got = StoryEngine(c), int(len(rows) * cut), []
    for i, r in enumerate(rows):
        if i == at:
            e = StoryEngine.restore(e.save(), c)
        got.append(e.process(r, i)[2])
    assert got == want
    with pytest.raises(ValueError):
        StoryEngine.restore(e.save(), Config(dup_jaccard=0.9))


def test_stream_equals_batch_however_it_is_cut(spark, tmp_path):
    from newsloom.streaming import sinks, stories

    log = synth.stream(spark, 240, seed=5, dim=16, topics=16)
    want = [tuple(r) for r in stories.events_of(stories.run_batch(stories.inputs(log))).orderBy("input_offset", "seq").collect()]
    src = str(tmp_path / "in")
    for k in range(3):
        log.where(f"input_offset >= {80 * k} AND input_offset < {80 * k + 80}").coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    sinks.start(stories.run_stream(stories.inputs(s)), out).awaitTermination()
    got = [tuple(r) for r in sinks.read(spark, out, "events").select("input_offset", "seq", "event_id", "event_time_ms", "watermark_ms", "kind", "story_id", "payload").orderBy("input_offset", "seq").collect()]
    assert got == want and len(want) > 100
    assert sinks.next_offset(spark, out).first()[0] == 240
    # A batch that comes again replaces itself.
    df = stories.run_batch(stories.inputs(log))
    write = sinks.write_epoch(str(tmp_path / "again"))
    write(df, 0)
    write(df, 0)
    assert sinks.read(spark, str(tmp_path / "again"), "events").count() == len(want)


def test_replay_is_identical_and_a_perturbed_one_is_not(spark):
    from newsloom.streaming import stories

    log = stories.inputs(synth.stream(spark, 150, seed=9, dim=16, topics=16))
    cols = ["input_offset", "seq", "kind", "story_id"]
    a = stories.events_of(stories.run_batch(log)).select(*cols)
    same = readmodel.diff(a, stories.events_of(stories.run_batch(log)).select(*cols), cols[:2], cols).first()
    other = readmodel.diff(a, stories.events_of(stories.run_batch(log, Config(neighbor=0.98, centroid=0.98))).select(*cols), cols[:2], cols).first()
    assert same.identical and same.first_divergence is None and same.matched == same.n_original
    assert not other.identical


def test_sketches_estimate_the_share_of_shingles():
    rng = np.random.default_rng(1)
    base = "".join(rng.choice(list("abcdefgh "), 400))
    for n in (0, 20, 60, 150):
        other = base[:-n] + "".join(rng.choice(list("ijklmn"), n)) if n else base
        a, b = ({minhash.normalize(t)[i : i + 5] for i in range(len(minhash.normalize(t)) - 4)} for t in (base, other))
        got = float((minhash.sketch(base) == minhash.sketch(other)).mean())
        assert abs(got - len(a & b) / len(a | b)) < 0.12
    assert minhash.sketch(" .!") is None and minhash.sketch("ab") is not None


def test_briefing_parts():
    assert briefing.fit("One. Two three four five six", 12) == "One."
    assert briefing.fit("word " * 10, 12).endswith("…")
    assert list(briefing.sub_batches([5, 1, 3, 9], 9)) == [[1, 2], [0], [3]]
