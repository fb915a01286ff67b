"""Texts cut off by limits or broken transfers, told from the corpus itself.

Word trigrams are counted inside texts and at ends, where a sentence stop or
the end of a headline follows. A value that ends in a trigram that is frequent
inside but almost never terminal stops inside a sentence. Around this stand
what the characters show (cut marks, broken entities and markup, open
brackets), words that occur only as ends and begin longer words, the habit of
the publisher to set a final stop, and lengths at which one source's values
pile up. All of it is SQL functions, joins and aggregates over all values.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import Stages, spread

#: Share of terminal occurrences below which a final trigram means a cut, and occurrences inside that it takes.
TERMINAL_SHARE, LEAST_INSIDE = 0.06, 3
#: Share of its plain ends that a publisher closes with a stop for a missing stop to count as a cut, and ends that it takes.
STOP_HABIT, LEAST_ENDS = 0.75, 10
#: How often a length must occur in a source against the lengths around it to be a limit; half of its values must show a cut otherwise.
PILE, PILE_LEAST, AROUND = 6.0, 8, 5

#: Marks of a cut; what closes after a stop; stops; brackets that are opened and what closes each.
CUT_MARK = r"(?:\s*(?:…|\.\.\.+|\[\s*(?:…|\.\.\.)\s*\]|\(\s*(?:…|\.\.\.)\s*\)|\(more\)|&hellip;|&#8230;))+\s*$"
BLANKS = " \t\r\n"
CLOSERS = " \"'”’»›）)]」』*+"
STOPS = ".!?…。！？"
BROKEN = r"(?:&#?\w{0,8}|�)\s*$"
OPENED = (("(", ")"), ("[", "]"), ("«", "»"), ("„", "“”"), ("「", "」"))
#: Notes behind a whole text: bracketed notes, counters, signs, a word behind a dash.
NOTES = r"(?:\s*(?:\([^()]*\)|\[[^\[\]]*\]|[*+]+|\s[–—-]\s\p{L}{2,8}))+\s*$"
TOKEN = r"\p{N}+|[\p{IsKatakana}ー]+|[\p{IsHan}\p{IsHiragana}]|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*|[^\s\p{L}\p{N}\p{M}]"
STOP = "."


def _any(test: Callable[[str], Column], signs: Iterable[str]) -> Column:
    return functools.reduce(Column.__or__, [test(x) for x in signs])


def _translated(text: Column, signs: str, into: str) -> Column:
    """``translate``, which looks at every character, only where one of the signs occurs at all."""
    return F.when(_any(text.contains, signs), F.translate(text, signs, into)).otherwise(text)


def with_plain(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the text without markup and entities of white space. Step by step, so that no step is computed again for each of its uses."""
    c = F.col(out)
    df = df.withColumn(out, F.when(F.col(text).contains("<"), F.regexp_replace(text, r"<[^<>]*>", " ")).otherwise(F.col(text)))
    df = df.withColumn(out, F.when(c.contains("&"), F.regexp_replace(out, r"&nbsp;|&#160;", " ")).otherwise(c))
    return df.withColumn(out, _translated(c, " 　\t\r\n", "     ")).withColumn(out, F.rtrim(out))


def has_mark(p: Column) -> Column:
    return _any(p.endswith, ("…", "...", "]", ")", ";")) & F.right(p, F.lit(16)).rlike(CUT_MARK)


def with_ending(df: DataFrame, p: str, out: str) -> DataFrame:
    """Adds what ends the text once cut marks or notes behind it are taken off."""
    c = F.col(out)
    df = df.withColumn(out, F.when(has_mark(F.col(p)), F.rtrim(F.regexp_replace(p, CUT_MARK, ""))).otherwise(F.col(p)))
    noted = _any(c.endswith, ")]*+") | (_any(c.contains, (" – ", " — ", " - ")) & F.right(out, F.lit(12)).rlike(r"\s[–—-]\s"))
    return df.withColumn(out, F.when(noted, F.rtrim(F.regexp_replace(out, NOTES, ""))).otherwise(c))


def stopped(p: Column) -> Column:
    """Whether a stop ends the text, whatever closes behind it."""
    return _any(p.endswith, STOPS) | (_any(p.endswith, CLOSERS) & _any(F.rtrim(p, F.lit(CLOSERS)).endswith, STOPS))


def unclosed(p: Column, opens: str, closes: str) -> Column:
    """Whether no closing sign follows the last opening one."""
    return p.contains(opens) & ~_any(F.substring_index(p, opens, -1).contains, closes)


def in_markup(text: Column) -> Column:
    """Whether the text ends inside a tag, however long."""
    return text.contains("<") & ~F.substring_index(text, "<", -1).contains(">")


def with_tokens(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds words, numbers, signs; Japanese by character, katakana in runs; every stop is the same."""
    return df.withColumn(out, _translated(F.col(text), "!?。！？", ".....")).withColumn(out, F.regexp_extract_all(out, F.lit(TOKEN), F.lit(0)))


def masked(x: Column) -> Column:
    """Numbers, katakana and capitalised words each as one class: most are names."""
    code, c = F.ascii(x), F.substring(x, 1, 1)
    return (
        F.when(code.between(ord("a"), ord("z")), x).when(code.between(ord("A"), ord("Z")), F.lit("X")).when(code.between(ord("0"), ord("9")), F.lit("0"))
        .when((c >= "ァ") & (c <= "ヿ"), F.lit("K")).when(c != F.lower(c), F.lit("X")).otherwise(x)
    )


def values(rows: DataFrame, key: str = "raw_offset", source: str = "source_id", fields: tuple[str, ...] = ("title", "summary")) -> DataFrame:
    """One row per non-empty value: key, source, field, text."""
    arr = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    v = spread(rows.select(key, source, *fields)).select(F.col(key).alias("key"), F.col(source).alias("source"), F.inline(arr))
    return v.where(F.col("text").isNotNull() & (F.trim("text") != ""))


def counts(vals: DataFrame, headline: str = "title") -> DataFrame:
    """(ab, c, inside, stopped, ended): how often word c follows the two words whose hash is ab and goes on, and how often a stop or a headline's end follows it.

    Each different text counts once, so copies of a cut text don't vouch for
    its end. Ends of other fields and behind cut marks tell nothing and are
    left out.
    """
    t = with_ending(with_plain(vals.select("field", "text").distinct(), "text", "p"), "p", "tail")
    cut = has_mark(F.col("p")) | (_any(F.col("text").contains, "&�") & F.right("text", F.lit(12)).rlike(BROKEN))
    t = with_tokens(t.select("field", cut.alias("cut"), "tail"), "tail", "r")
    # Each word beside the two before it and the one after it.
    pad = F.concat(F.array(F.lit(""), F.lit("")), "r")
    zipped = F.arrays_zip(pad.alias("a"), F.slice(pad, 2, F.size("r") + 1).alias("b"), F.col("r").alias("c"), F.slice("r", 2, F.size("r")).alias("d"))
    g = t.select("field", "cut", F.inline(zipped)).toDF("field", "cut", "a", "b", "c", "d").where(f"c IS NOT NULL AND c <> '{STOP}'")
    end = F.when(F.col("d") == STOP, F.lit(3)).when(F.col("d").isNotNull(), F.lit(0)).when((F.col("field") == headline) & ~F.col("cut"), F.lit(1))
    g = g.select(F.xxhash64(masked(F.col("a")), masked(F.col("b"))).alias("ab"), "c", end.alias("e")).where("e IS NOT NULL")
    return g.groupBy("ab", "c").agg(*[F.count_if(F.col("e") == k).alias(n) for n, k in (("inside", 0), ("stopped", 3), ("ended", 1))])


def ends(vals: DataFrame) -> DataFrame:
    """What each value's characters show: mark, broken, open, stop, its length, and the words of its end."""
    v = vals.select(
        "*", F.when(_any(F.col("text").endswith, BLANKS), F.rtrim("text", F.lit(BLANKS))).otherwise(F.col("text")).alias("e"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("digest")
    )
    v = with_ending(with_plain(v, "text", "p"), "p", "tail")
    broken = F.col("e").endswith("�") | (F.col("e").contains("&") & F.right("e", F.lit(12)).rlike(BROKEN)) | in_markup(F.col("text"))
    opened = _any(lambda x: unclosed(F.col("p"), *x), OPENED)
    v = v.select(
        "key", "source", "field", has_mark(F.col("p")).alias("mark"), broken.alias("broken"), opened.alias("open"), (stopped(F.col("p")) | ((F.col("tail") != F.col("p")) & stopped(F.col("tail")))).alias("stop"),
        # Words don't reach across white space: the last three are in the last three stretches.
        F.substring_index("tail", " ", -3).alias("last"), ((F.col("e") != F.col("text")) & F.right("e", F.lit(1)).rlike(r"[\p{L},]")).alias("blank"), "chars", "bytes", "digest",
    )
    v = with_tokens(v, "last", "r")
    word = lambda k: F.coalesce(F.try_element_at("r", F.lit(-k)), F.lit(""))
    return v.withColumn("ab", F.xxhash64(masked(word(3)), masked(word(2)))).withColumn("c", F.try_element_at("r", F.lit(-1))).drop("r", "last")


def judged(rows: DataFrame, key: str = "raw_offset", source: str = "source_id", fields: tuple[str, ...] = ("title", "summary")) -> DataFrame:
    """Every non-empty value with ``cut`` and the evidence: key, source, field, mark, broken, open, stop, share, partial, limit, cut.

    Null and blank values are no values. Repeated rows are judged each. Other
    columns are left out, so they can't clash.
    """
    vals = values(rows, key, source, fields)
    stages = Stages(rows.sparkSession, "truncation")
    stats, v = stages.write(counts(vals, fields[0]), "stats"), stages.write(ends(vals), "ends")
    # Final trigrams, each once, against all counts; masked words share their counts.
    terminal = F.sum(F.col("stopped") + F.col("ended"))
    tri = stats.groupBy("ab", masked(F.col("c")).alias("mc")).agg(F.sum("inside").alias("inside"), terminal.alias("terminal"))
    finals = stages.write(v.where("c IS NOT NULL").select("ab", "c").distinct().withColumn("mc", masked(F.col("c"))), "finals")
    letters = finals.where(F.col("c").rlike(r"^[\p{L}\p{M}'’]+$")).select("ab", "c")
    # A word that never goes on anywhere but begins longer ones is the rest of one.
    word = stages.write(stats.groupBy("c").agg(F.sum(F.col("inside") + F.col("stopped")).alias("vouched"), F.sum("inside").alias("goes_on")).where("goes_on > 0"), "words")
    alone = letters.join(word, "c", "left_anti")
    rest = alone.join(_beginnings(word.where("vouched >= 2").select("c")), "c", "left_semi")
    # So is a word known elsewhere that no text carries on or stops at after these two words, if longer ones that it begins stand there.
    unheard = letters.join(stats.where("inside + stopped > 0"), ["ab", "c"], "left_anti")
    there = stats.where("inside + stopped >= 2").join(unheard.select("ab").distinct(), "ab", "left_semi").select("ab", "c")
    rest = rest.select("ab", "c").unionByName(unheard.join(_beginnings(there), ["ab", "c"], "left_semi")).distinct()
    known_finals = (
        finals.join(tri, ["ab", "mc"], "left").join(rest.withColumn("partial", F.lit(True)), ["ab", "c"], "left")
        .select("ab", "c", F.coalesce("inside", F.lit(0)).alias("inside"), F.coalesce("terminal", F.lit(0)).alias("terminal"), F.coalesce("partial", F.lit(False)).alias("partial"))
        .withColumn("share", F.try_divide(F.col("terminal"), F.col("inside") + F.col("terminal")))
    )
    v = v.join(known_finals, ["ab", "c"], "left")
    inner = (F.col("inside") >= LEAST_INSIDE) & (F.col("share") < TERMINAL_SHARE)
    v = v.withColumn("inner", F.coalesce(inner, F.lit(False)) | F.coalesce("partial", F.lit(False)))
    # A publisher's habit: of its ends that could be ends, how many have a stop.
    could = ~F.col("mark") & ~F.col("broken") & ~F.col("open") & (F.col("stop") | ~F.col("inner"))
    habit = v.where(could).groupBy("source", "field").agg(F.count("*").alias("n"), F.avg(F.col("stop").cast("int")).alias("stops"))
    habit = habit.select("source", "field", ((F.col("n") >= LEAST_ENDS) & (F.col("stops") >= STOP_HABIT)).alias("sets_stop"))
    # Lengths that pile up in one source, in characters or bytes.
    by = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("len")) for u in ("chars", "bytes")])
    lens = v.where("NOT stop AND NOT mark").dropDuplicates(["source", "field", "digest"]).select("source", "field", "inner", "blank", F.inline(by)).groupBy("source", "field", "unit", "len").agg(F.count("*").alias("count"), F.count_if(F.col("inner") | F.col("blank")).alias("within"))
    around = F.sum("count").over(Window.partitionBy("source", "field", "unit").orderBy("len").rangeBetween(-AROUND, AROUND)) - F.col("count")
    piles = lens.withColumn("around", around / (2 * AROUND)).where((F.col("count") >= PILE_LEAST) & (F.col("count") >= PILE * (F.col("around") + 0.5)) & (2 * F.col("within") >= F.col("count")))
    limits = lambda u: piles.where(F.col("unit") == u).select("source", "field", F.col("len").alias(u), F.lit(True).alias(f"at_{u}"))
    v = v.join(habit, ["source", "field"], "left").join(limits("chars"), ["source", "field", "chars"], "left").join(limits("bytes"), ["source", "field", "bytes"], "left")
    limit = F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False))
    cut = F.col("broken") | F.col("mark") | (~F.col("stop") & (F.col("open") | F.col("inner") | F.coalesce("sets_stop", F.lit(False)) | limit | F.col("blank")))
    return v.select(F.col("key").alias(key), F.col("source").alias(source), "field", "mark", "broken", "open", "stop", "blank", "inside", "terminal", "share", "partial", limit.alias("limit"), cut.alias("cut"), F.col("sets_stop"))


def _beginnings(words: DataFrame) -> DataFrame:
    """The proper beginnings of column ``c``, beside the other columns."""
    rest = [x for x in words.columns if x != "c"]
    n = F.transform(F.sequence(F.lit(1), F.length("c") - 1), lambda k: F.substring(F.col("c"), F.lit(1), k))
    return words.where(F.length("c") > 1).select(*rest, F.explode(n).alias("c")).distinct()


def truncated(rows: DataFrame, key: str = "raw_offset", source: str = "source_id") -> DataFrame:
    return judged(rows, key, source).where("cut").select(key, "field")


def by_source(rows: DataFrame, key: str = "raw_offset", source: str = "source_id") -> DataFrame:
    """How often each source cuts, by field; and in how many cut values the final trigram, or a last word that is the rest of one, says so."""
    tells = F.col("cut") & ((F.coalesce("inside", F.lit(0)) >= LEAST_INSIDE) & F.coalesce(F.col("share") < TERMINAL_SHARE, F.lit(False)))
    partial = F.col("cut") & F.coalesce("partial", F.lit(False))
    g = judged(rows, key, source).groupBy(source, "field")
    return g.agg(
        F.count("*").alias("n"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("int")).alias("share"), F.count_if(tells).alias("n_trigram"), F.count_if(partial).alias("n_partial")
    )
