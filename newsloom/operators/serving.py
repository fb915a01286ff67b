"""What a reader asks of the tables: positions, flattened events, families of stories, search, windows to run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators import vectors as vx
from newsloom.operators.readmodel import field

#: How the reasons and outcomes are labelled.
REASONS = ("idle", "merged", "split")
OUTCOMES = {"invalid": "invalid", "exact_dup": "exact_duplicate", "near_dup": "near_duplicate", "joined": "joined", "created": "created", "late_dropped": "late_dropped"}
#: Languages under another code.
SAME_AS = {"nb": "no", "nn": "no", "fil": "tl"}
#: Bounds of what can be asked for: rows, nodes of a graph, hits, buckets.
BOUNDS = {"limit": (1, 500), "graph": (1, 400), "search": (1, 200), "buckets": (4, 500)}
STRONG = 0.85


def clamped(what: str, value: int) -> int:
    low, high = BOUNDS[what]
    return min(high, max(low, value))


def parse_position(c: Column) -> Column:
    """``offset:seq`` as a struct; null where it is not of this form."""
    ok = c.rlike(r"^-?\d+:-?\d+$")
    return F.when(ok, F.struct(F.substring_index(c, ":", 1).cast("long").alias("offset"), F.substring_index(c, ":", -1).cast("int").alias("seq")))


def unpack(pos: Column) -> Column:
    return F.struct(F.shiftright(pos, 20).alias("offset"), pos.bitwiseAND(0xFFFFF).cast("int").alias("seq"))


def base_language(code: Column) -> Column:
    """The code before region and script; codes of SAME_AS as the other one."""
    base = F.element_at(F.split(code, "[-_]"), 1)
    known = F.create_map(*[F.lit(x) for kv in SAME_AS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(base)), base)


def same_language(a: Column, b: Column) -> Column:
    return F.lower(base_language(a)) == F.lower(base_language(b))


def union_sorted(a: Column, b: Column) -> Column:
    """Two arrays as one set, ascending; a null array is empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def close_reason(c: Column) -> Column:
    return F.when(c.isin(*REASONS), c).otherwise("unspecified")


def outcome_label(c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv]), c)


def event_json(events: DataFrame) -> DataFrame:
    """(input_offset, seq, kind, story_id, payload): each event of the log as one JSON text. No watermark is null, children are counts."""
    strings = lambda name: F.coalesce(F.from_json(F.get_json_object("payload", f"$.{name}"), "array<string>"), F.array().cast("array<string>"))
    number = lambda name, kind: field(name).cast(kind).alias(name)
    story = F.col("story_id")
    parent, target = F.coalesce(field("parent_story_id"), story), F.coalesce(field("target_story_id"), story)
    children = F.coalesce(F.from_json(F.get_json_object("payload", "$.children"), "array<struct<story_id:string,article_ids:array<string>>>"), F.array())
    counted = F.transform(children, lambda c: F.struct(c["story_id"].alias("story_id"), F.size(F.coalesce(c["article_ids"], F.array())).alias("article_count")))
    base = [F.col("input_offset").alias("offset"), F.col("seq").cast("int").alias("seq"), F.col("event_time_ms").alias("event_time"), F.when(F.col("watermark_ms") > 0, F.col("watermark_ms")).alias("watermark"), "kind"]
    bodies = {
        "created": [story, field("seed_article_id").alias("seed_article_id"), field("headline").alias("headline"), field("lang").alias("lang"), strings("parent_story_ids").alias("parent_ids")],
        "article_added": [story, field("article_id").alias("article_id"), number("score", "double"), number("is_duplicate", "boolean"), field("duplicate_of").alias("duplicate_of"), number("late", "boolean")],
        "updated": [story, field("headline").alias("headline"), field("headline_article_id").alias("headline_article_id"), number("article_count", "long"), number("source_count", "long"), strings("langs").alias("langs")],
        "split": [parent.alias("story_id"), counted.alias("children")],
        "merged": [target.alias("story_id"), strings("source_story_ids").alias("source_ids")],
        "closed": [story, close_reason(field("reason")).alias("reason")],
    }
    text = F.coalesce(*[F.when(F.col("kind") == k, F.to_json(F.struct(*base, *b), {"ignoreNullFields": "false"})) for k, b in bodies.items()])
    of = F.when(F.col("kind") == "split", parent).when(F.col("kind") == "merged", target).otherwise(story)
    return events.where(F.col("kind").isin(*bodies)).select("input_offset", "seq", "kind", of.alias("story_id"), text.alias("payload"))


def position(arrivals: DataFrame, at: int | None = None, as_of_ms: int | None = None) -> DataFrame:
    """One row (at, time_ms, latest, live): a position no later than the latest, or that of a time, or the latest."""
    if at is not None and as_of_ms is not None:
        raise ValueError("use either a position or a time")
    a = arrivals.select("input_offset", "fetched_at_ms")
    top = F.coalesce(F.max("input_offset"), F.lit(-1)).alias("latest")
    if as_of_ms is not None:
        where = F.coalesce(F.max(F.when(F.col("fetched_at_ms") <= as_of_ms, F.col("input_offset"))), F.lit(-1))
    else:
        where = F.least(F.lit(at).cast("long"), top) if at is not None else top
    one = a.agg(top, where.alias("at"))
    timed = one.join(a, F.col("input_offset") <= F.col("at"), "left").groupBy("latest", "at").agg(F.max("fetched_at_ms").alias("time_ms"))
    return timed.select("at", "time_ms", "latest", (F.col("at") >= F.col("latest")).alias("live"))


def merged_from(lineage: DataFrame) -> DataFrame:
    """(story_id, merged_from, merged_into): which stories went into one, in order, and where it went itself."""
    m = lineage.where("kind = 'merged'")
    into = m.groupBy(F.col("child").alias("story_id")).agg(F.array_join(F.array_sort(F.collect_set("parent")), ",").alias("merged_from"))
    gone = m.groupBy(F.col("parent").alias("story_id")).agg(F.max_by("child", "input_offset").alias("merged_into"))
    return into.join(gone, "story_id", "full").select("story_id", F.coalesce("merged_from", F.lit("")).alias("merged_from"), "merged_into")


def family(events: DataFrame) -> DataFrame:
    """(parent, child, child_offset): stories that name a parent at their creation."""
    parents = F.from_json(F.get_json_object("payload", "$.parent_story_ids"), "array<string>")
    c = events.where("kind = 'created'").select(F.explode(parents).alias("parent"), F.col("story_id").alias("child"), F.col("input_offset").alias("child_offset"))
    return c.groupBy("parent", "child").agg(F.min("child_offset").alias("child_offset"))


def search(articles: DataFrame, asked: DataFrame, current: DataFrame, vector: str, hits: int) -> DataFrame:
    """(place, id, similarity, story_id) of the articles most alike the one asked vector, with their current story if they have one."""
    unit = vx.unit(vx.doubles(F.col(vector)))
    q = asked.select(unit.alias("__q")).limit(1)
    near = articles.select("id", unit.alias("__v")).join(F.broadcast(q)).select("id", F.round(vx.dot(F.col("__v"), F.col("__q")), 6).alias("similarity"))
    top = near.orderBy(F.desc("similarity"), "id").limit(clamped("search", hits))
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))
    story = current.groupBy(F.col("article_id").alias("__a")).agg(F.min("story_id").alias("story_id"))
    return placed.join(story, F.col("id") == F.col("__a"), "left").select("place", "id", "similarity", "story_id")


def search_stories(found: DataFrame, open_stories: DataFrame) -> DataFrame:
    """(place, story_id, best, hits, strong): hits gathered by story in the order of their first hit; closed stories drop out."""
    g = found.where("story_id IS NOT NULL").groupBy("story_id").agg(F.min("place").alias("first"), F.max("similarity").alias("best"), F.count("*").alias("hits"))
    g = g.join(open_stories.select("story_id"), "story_id", "left_semi")
    return g.select(F.row_number().over(Window.orderBy("first")).cast("int").alias("place"), "story_id", "best", "hits", (F.col("best") >= STRONG).alias("strong"))


def late_diff(original: DataFrame, replayed: DataFrame, in_range: DataFrame, order: str) -> DataFrame:
    """One row (original, replayed, identical): late articles of a range as they were and as a replay has them; ``id`` tells which, ``order`` when."""
    was = original.join(in_range.select("id"), "id", "left_semi")
    rank = lambda df: df.select("id", F.row_number().over(Window.orderBy(order, "id")).alias("place"))
    j = rank(was).join(rank(replayed).withColumnRenamed("id", "rid"), "place", "full")
    same = F.coalesce(F.bool_and(F.col("id").isNotNull() & F.col("rid").isNotNull() & F.col("id").eqNullSafe(F.col("rid"))), F.lit(True))
    return j.agg(F.count("id").alias("original"), F.count("rid").alias("replayed"), same.alias("identical"))


def windows_before(timeline: DataFrame, width_ms: float, span_ms: int = 3_600_000) -> DataFrame:
    """(bucket, from_offset, to_offset): for each bucket of a timeline the inputs of the ``span_ms`` that end with it."""
    first = F.greatest(F.ceil(F.col("bucket") + 1 - F.lit(span_ms / width_ms)), F.lit(0)).cast("int")
    before = timeline.select((F.col("bucket") + 1).alias("__b"), F.col("upto_offset").alias("__u"))
    t = timeline.withColumn("__f", first).join(before, F.col("__f") == F.col("__b"), "left")
    return t.select("bucket", F.coalesce(F.col("__u") + 1, F.lit(0)).alias("from_offset"), (F.coalesce("upto_offset", F.lit(-1)) + 1).alias("to_offset"))


def preferred(rows: DataFrame, key: str, category: str, default: str, first_category: str) -> DataFrame:
    """Adds ``place``: the default first, then those of one category, then by name. For a catalogue, which is of bounded size."""
    order = (F.col(key) != default, F.coalesce(F.col(category) != first_category, F.lit(True)), F.col(key))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def word_starts(rows: DataFrame, key: str, text: str, ms_per_char: int) -> DataFrame:
    """(key, place, word, utf16, start_ms): each word of a text spoken evenly, with the offset at which a browser finds it.

    Browsers count characters beyond the first plane as two. Null and blank
    texts have no words; keys are unique.
    """
    w = rows.select(key, F.posexplode(F.split(text, r"\s")).alias("__k", "word"))
    run = Window.partitionBy(key).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    wide = F.length(F.regexp_replace("word", r"[^\x{10000}-\x{10FFFF}]", ""))
    before = lambda c: F.coalesce(F.sum(c).over(run), F.lit(0))
    w = w.select(key, "__k", "word", before(F.length("word") + 1 + wide).alias("utf16"), (before(F.length("word") + 1) * ms_per_char).alias("start_ms")).where("word <> ''")
    return w.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("__k")) - 1).alias("place"), "word", "utf16", "start_ms")


def word_at(starts: DataFrame, key: str, time_ms: int) -> DataFrame:
    """(key, place, word): the word that is spoken at a time, the last that has begun."""
    g = starts.where(F.col("start_ms") <= time_ms).groupBy(key).agg(F.max(F.struct("place", "word")).alias("w"))
    return g.select(key, "w.*")


def ranking(mem: DataFrame, articles: DataFrame, events: DataFrame, top: int = 20) -> DataFrame:
    """(list, place, id, sources, members, score): the largest stories now, by sources and members; and the weakest joins."""
    m = mem.where("to_offset IS NULL").join(articles.select(F.col("id").alias("article_id"), "source_id"), "article_id")
    g = m.groupBy(F.col("story_id").alias("id")).agg(F.countDistinct("source_id").alias("sources"), F.count("*").alias("members"))
    best = g.orderBy(F.desc("sources"), F.desc("members"), "id").limit(top).select(F.lit("stories").alias("list"), F.row_number().over(Window.orderBy(F.desc("sources"), F.desc("members"), "id")).alias("place"), "id", "sources", "members", F.lit(None).cast("double").alias("score"))
    j = events.where("kind = 'article_added'").select(field("article_id").alias("id"), field("score").cast("double").alias("score"), "pos").where("score IS NOT NULL AND id IS NOT NULL")
    weak = j.orderBy("score", "pos").limit(top).select(F.lit("joins").alias("list"), F.row_number().over(Window.orderBy("score", "pos")).alias("place"), "id", F.lit(None).cast("long").alias("sources"), F.lit(None).cast("long").alias("members"), "score")
    return best.unionByName(weak)
