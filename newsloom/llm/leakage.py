"""Evaluation items whose passages stand in the corpus.

All test items form one generalised suffix automaton over words. Documents are
streamed through it: after each word the automaton knows the longest run of
words, ending here, that stands in some item. Where that run is long enough,
the items holding it have leaked into the document.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from newsloom.session import spread

#: Words of an item in a row that count as leaked.
WORDS = 12
#: Bytes of item text that one automaton may hold, but for one item that has more; more items make more automata, which each document passes one after another.
BLOCK_BYTES = 8_000_000

_DROP = regex.compile(r"[\p{M}\p{Cf}]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_ASCII = regex.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKD, without marks and invisible format characters, in lower case."""
    if not text:
        return []
    if text.isascii():
        return _ASCII.findall(text.lower())
    return _WORD.findall(_DROP.sub("", unicodedata.normalize("NFKD", text)).lower())


def placed_words(text: str | None) -> list[tuple[str, int, int]]:
    """The same words with where each starts and stops in the text; marks and format characters after a word belong to it."""
    if not text:
        return []
    if text.isascii():
        return [(m[0], *m.span()) for m in _ASCII.finditer(text.lower())]
    kept = [_DROP.sub("", unicodedata.normalize("NFKD", c)) for c in text]
    origin = [i for i, x in enumerate(kept) for _ in x]
    out = []
    for m in _WORD.finditer("".join(kept).lower()):
        stop = origin[m.end() - 1] + 1
        while stop < len(text) and not kept[stop]:
            stop += 1
        out.append((m[0], origin[m.start()], stop))
    return out


class SuffixAutomaton:
    """Generalised over sequences of word numbers; each state knows its items.

    A state's items are those of all states below it in the tree of suffix
    links, so they are gathered bottom up and kept only for states that stand
    for runs of at least ``least`` words.
    """

    def __init__(self, items: list[tuple[int, list[str]]], least: int = WORDS):
        self.least = least
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        for item, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, self.number.setdefault(w, len(self.number)), ends)
                ends[last].add(item)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.length[s] >= least and self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        self.items = [tuple(sorted(e)) if self.length[s] >= least else () for s, e in enumerate(ends)]

    def _new(self, length: int, nxt: dict[int, int], link: int, ends: list[set[int]]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: int, ends: list[set[int]]) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int, ends: list[set[int]]) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w, ends)
        cur, p = self._new(self.length[last] + 1, {}, 0, ends), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w, ends)
        return cur

    def scan(self, doc: list[str]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length): the longest runs, of at least ``least`` words, that end at each word."""
        get = self.number.get
        known = np.array([get(w, -1) for w in doc], np.int64)
        if len(known) < self.least:
            return
        # Only stretches of known words long enough can hold a run.
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (known >= 0).astype(np.int8), [0]])))
        nxt, link, length, least = self.next, self.link, self.length, self.least
        for a, b in edge.reshape(-1, 2).tolist():
            if b - a < least:
                continue
            s = n = 0
            for i, w in enumerate(known[a:b].tolist(), a):
                while s and w not in nxt[s]:
                    s = link[s]
                    n = length[s]
                if w in nxt[s]:
                    s, n = nxt[s][w], n + 1
                if n >= least:
                    yield i, s, n



def leaks(docs: DataFrame, items: DataFrame, least: int = WORDS, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item that share a run of at least ``least`` words.

    Columns: ``key``, ``item_key``, ``longest`` (words of the longest shared
    run), ``covered`` (words of the document under such runs with any item),
    ``words`` (of the document). Null, empty or short texts on either side
    share nothing; repeated rows count each. Items are packed into automata of
    at most ``block_bytes`` of text, so what is shipped to the workers is
    bounded; the corpus is read once, and each document passes them all.
    """
    kind, item_type = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType
    shipped = list(_shipments(docs.sparkSession, items, least, item_key, item_text, block_bytes))
    t = spread(docs.select(key, text))
    found = f"found array<struct<item:{item_type.simpleString()},longest:int>>"
    for i, block in enumerate(shipped):
        if i == len(shipped) - 1:
            schema = f"`{key}` {kind}, `{item_key}` {item_type.simpleString()}, longest int, covered int, words int"
        else:
            schema = f"`{key}` {kind}, `{text}` string, {found}, runs array<int>"
        t = t.mapInArrow(_scanner(block, least, key, text, item_key, item_type, i == len(shipped) - 1), schema)
    return t


_AUTOMATA: dict[tuple, SuffixAutomaton] = {}


def _shipments(spark, items: DataFrame, least: int, item_key: str, item_text: str, block_bytes: int) -> Iterator:
    """The words of the items, as broadcasts of at most ``block_bytes`` of text."""
    size = F.coalesce(F.octet_length(item_text), F.lit(0))
    total = items.agg(F.sum(size)).first()[0] or 0
    # Within groups of some hundred blocks items fill one block after another.
    groups = max(1, int(total) // (256 * block_bytes))
    numbered = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).alias("k"), F.col(item_text).alias("t"), F.pmod(F.xxhash64(item_key), F.lit(groups)).alias("g"), size.alias("n"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("k", "t").rowsBetween(Window.unboundedPreceding, -1))
    numbered = numbered.withColumn("b", F.floor(F.coalesce(before, F.lit(0)) / block_bytes))
    blocks = sorted(tuple(r) for r in numbered.select("g", "b").distinct().collect()) or [(0, 0)]
    for g, b in blocks:
        rows = numbered.where((F.col("g") == g) & (F.col("b") == b)).select("k", "t").collect()
        yield spark.sparkContext.broadcast([(r.k, ws) for r in rows if len(ws := words(r.t)) >= least])


def without_spans(docs: DataFrame, items: DataFrame, least: int = WORDS, longest: int = 50, coverage: float = 0.2, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key``, ``text``, ``removed`` (words): documents without the leaked spans that exceed the limits.

    A span is a stretch of words under shared runs that touch. It goes if a run
    in it has more than ``longest`` words, and every span goes where they cover
    more than ``coverage`` of the document's words. All rows stay.
    """
    t = spread(docs.select(key, text)).withColumn("runs", F.array().cast("array<int>"))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{text}` string, runs array<int>"
    for shipped in _shipments(docs.sparkSession, items, least, item_key, item_text, block_bytes):
        t = t.mapInArrow(_runs(shipped, least, key, text), schema)
    return t.mapInArrow(_remover(longest, coverage, key, text), f"`{key}` {docs.schema[key].dataType.simpleString()}, `{text}` string, removed int")


def _runs(shipped, least: int, key: str, text: str):
    """Adds the runs with one automaton's items: first and last word of each, longest of those that end at a word."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = (name, least)
        if k not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[k] = SuffixAutomaton([(i, ws) for i, (_, ws) in enumerate(shipped.value)], least)
        auto = _AUTOMATA[k]
        for b in batches:
            runs = [(before or []) + [x for at, _, n in auto.scan(words(t)) for x in (at + 1 - n, at)] for t, before in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(runs, pa.list_(pa.int32()))], names=[key, text, "runs"])

    return run


def cut_spans(text: str, runs: list[int], longest: int, coverage: float) -> tuple[str, int]:
    """The text without the spans that exceed the limits, and how many words went."""
    spans: list[list[int]] = []
    for a, z in sorted(zip(runs[::2], runs[1::2])):
        if spans and a <= spans[-1][1] + 1:
            spans[-1][1:] = max(spans[-1][1], z), max(spans[-1][2], z + 1 - a)
        else:
            spans.append([a, z, z + 1 - a])
    placed = placed_words(text)
    everything = sum(z + 1 - a for a, z, _ in spans) > coverage * len(placed)
    gone = [(a, z) for a, z, n in spans if everything or n > longest]
    kept, at = [], 0
    for a, z in gone:
        kept.append(text[at : placed[a][1]])
        at = placed[z][2]
    return "".join([*kept, text[at:]]), sum(z + 1 - a for a, z in gone)


def _remover(longest: int, coverage: float, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [cut_spans(t, r, longest, coverage) if r else (t, 0) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32())], names=[key, text, "removed"])

    return run


def _scanner(shipped, least: int, key: str, text: str, item_key: str, item_type: DataType, last: bool):
    """Adds what documents share with one automaton's items to what they share with those before; the last one gives the rows."""
    name, b_type = uuid.uuid4().hex, to_arrow_type(item_type)
    found_type = pa.list_(pa.struct([("item", b_type), ("longest", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = (name, least)
        if k not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[k] = SuffixAutomaton([(i, ws) for i, (_, ws) in enumerate(shipped.value)], least)
        auto, keys = _AUTOMATA[k], [item for item, _ in shipped.value]
        for b in batches:
            texts = b.column(1).to_pylist()
            known = [[(x["item"], x["longest"]) for x in f or []] for f in b.column(2).to_pylist()] if b.num_columns > 2 else [[] for _ in texts]
            runs = [list(r or []) for r in b.column(3).to_pylist()] if b.num_columns > 2 else [[] for _ in texts]
            count = [0] * len(texts)
            for i, t in enumerate(texts):
                ws = words(t)
                count[i] = len(ws)
                best: dict[int, int] = {}
                own: list[int] = []
                for at, s, n in auto.scan(ws):
                    if own and own[-1] + 1 >= at + 1 - n >= own[-2]:
                        own[-1] = at
                    else:
                        own += [at + 1 - n, at]
                    # Items of the state hold the whole run; items further up hold a shorter end of it.
                    while auto.length[s] >= least:
                        for item in auto.items[s]:
                            if best.get(item, 0) < n:
                                best[item] = n
                        s = auto.link[s]
                        n = min(n, auto.length[s])
                runs[i] += own
                known[i] += [(keys[item], n) for item, n in best.items()]
            if not last:
                found = pa.array([[{"item": x, "longest": n} for x, n in f] for f in known], found_type)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found, pa.array(runs, pa.list_(pa.int32()))], names=[key, text, "found", "runs"])
                continue
            rows = [(i, x, n, c, count[i]) for i, f in enumerate(known) if f for c in [_covered(runs[i])] for x, n in f]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], b_type), *[pa.array(c, pa.int32()) for c in cols[2:]]],
                names=[key, item_key, "longest", "covered", "words"],
            )

    return run


def _covered(runs: list[int]) -> int:
    """Words under any of the runs, given by first and last word."""
    total = reach = 0
    for a, z in sorted(zip(runs[::2], runs[1::2])):
        total += max(0, z + 1 - max(a, reach))
        reach = max(reach, z + 1)
    return total


def without_leaks(docs: DataFrame, found: DataFrame, key: str = "doc_id", longest: int = 50, coverage: float = 0.2) -> DataFrame:
    """Documents that stay: none of whose shared runs exceeds ``longest`` words or ``coverage`` of their words."""
    bad = found.where((F.col("longest") > longest) | (F.col("covered") > coverage * F.col("words"))).select(key).distinct()
    return docs.join(bad, key, "left_anti")
