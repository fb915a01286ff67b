"""Scalar functions on text, as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Tags whose boundaries separate words.
BLOCK_TAGS = "p br div li ul ol h1 h2 h3 h4 h5 h6 tr td th blockquote figure figcaption img hr section article".split()
#: Entities that are decoded without a Python function.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&amp;": "&"}
#: Three-letter language codes of two-letter ones.
THREE_LETTER = {"eng": "en", "spa": "es", "por": "pt", "deu": "de", "fra": "fr", "rus": "ru", "jpn": "ja", "ita": "it", "nld": "nl"}


def strip_tags(c: Column) -> Column:
    """Without scripts, styles and tags; block tags leave a space, a bare ``<`` stays."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^a-z0-9>][^>]*>.*?(</(script|style)[^>]*>|$)|<(script|style)>.*?(</(script|style)[^>]*>|$)", " ")
    c = F.regexp_replace(c, r"(?i)</?(" + "|".join(BLOCK_TAGS) + r")(\s[^>]*|/[^>]*)?>", " ")
    return F.regexp_replace(c, r"<[A-Za-z/!?][^>]*>", "")


def squeeze(c: Column) -> Column:
    """White space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_html(c: Column) -> Column:
    """Plain text of an HTML fragment; the entities of ENTITIES are decoded."""
    c = strip_tags(c)
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return squeeze(c)


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Every entity that HTML knows; null stays null."""
    return s.map(lambda x: None if x is None else html.unescape(x), na_action="ignore")


def truncate(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut at a word end in the second half where there is one, with an ellipsis."""
    cut = F.substring(c, 1, most - 1)
    last = F.element_at(F.split(cut, " "), -1)
    head = F.substring(cut, F.lit(1), F.length(cut) - F.length(last) - 1)
    word = (F.length(last) < F.length(cut)) & (F.octet_length(head) > F.floor(F.octet_length(cut) / 2))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.when(word, head).otherwise(cut)), F.lit("…")))


def embedding_text(title: Column, summary: Column) -> Column:
    """What is embedded and shingled: the title, and the summary on a line of its own unless it is empty."""
    return F.when(F.coalesce(summary, F.lit("")) == "", title).otherwise(F.concat_ws("\n", title, summary))


def language_code(c: Column) -> Column:
    """Two-letter code of a language tag; null where there is none."""
    base = F.lower(F.element_at(F.split(F.trim(c), "[-_]"), 1))
    three = F.create_map(*[F.lit(x) for kv in THREE_LETTER.items() for x in kv])
    return F.when(base.rlike("^[a-z]{2}$") & (base != "xx"), base).when(base.rlike("^[a-z]{3}$"), F.try_element_at(three, base))


def resolve_language(configured: Column, hint: Column, detected: Column, detect_first: Column) -> Column:
    by_config = F.coalesce(configured, hint, detected, F.lit("und"))
    return F.when(detect_first, F.coalesce(detected, hint, configured, F.lit("und"))).otherwise(by_config)


def shingle_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def shingles(norm: Column, size: int = 5) -> Column:
    """Different substrings of ``size`` characters; a shorter text is one shingle, an empty one none."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(norm) - size + 1, F.lit(1))), lambda i: F.substring(norm, i, F.lit(size)))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.array_distinct(many))


def title_words(norm: Column) -> Column:
    """Different words of three characters or more that are no numbers."""
    return F.array_distinct(F.filter(F.split(norm, " "), lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\p{N}+$")))


def long_words(c: Column) -> Column:
    """Different words of more than two characters, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage_sentence(sources: Column, langs: Column) -> Column:
    n = F.when(sources > 10, F.concat(F.lit("More than "), (F.floor(sources / 10) * 10).cast("string"))).otherwise(sources.cast("string"))
    many = F.when(langs > 1, F.concat(n, F.lit(" sources in "), langs.cast("string"), F.lit(" languages are"))).otherwise(F.concat(n, F.lit(" sources are")))
    return F.concat(F.when(sources == 1, F.lit("1 source is")).otherwise(many), F.lit(" covering this story."))


def speakable_source(source: Column, langs: tuple[str, ...]) -> Column:
    """The host of an aggregated source; else the words of the id, capitalised, without a trailing language code."""
    words = F.split(source, "-")
    kept = F.when((F.size(words) > 1) & F.element_at(words, -1).isin(*langs), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(1)))).otherwise(words)
    named = F.array_join(F.transform(kept, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return F.when(F.instr(source, ":") > 0, F.regexp_extract(source, r"^[^:]*:(.*)$", 1)).otherwise(named)


def spoken(c: Column) -> Column:
    """Feed text for reading aloud: dateline in front and ellipsis behind taken off; a sentence that was cut off goes if one of 40 characters or more is left."""
    c = squeeze(c)
    head = F.regexp_extract(c, r"^(.{0,80}?)(?: -- | — | – | - )", 1)
    letters, capitals = F.length(F.regexp_replace(head, r"[^\p{L}]", "")), F.length(F.regexp_replace(head, r"[^\p{Lu}]", ""))
    dateline = head.endswith(")") | ((letters >= 3) & (capitals * 10 >= letters * 7))
    c = F.when((head != "") & dateline, F.regexp_replace(c, r"^.{0,80}?(?: -- | — | – | - )", "")).otherwise(c)
    bare = F.rtrim(F.regexp_replace(c, r"(\[…\]|\[\.\.\.\]|\.\.\.|…)$", ""))
    whole = F.regexp_extract(bare, r"(?s)^(.*[.!?。！？])(?=\s|$)", 1)
    return F.trim(F.when(bare == c, c).when(F.octet_length(whole) >= 40, whole).otherwise(bare))


def redact(url: Column) -> Column:
    return F.regexp_replace(url, "://.*@", "://***@")
