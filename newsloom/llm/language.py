"""Language of documents and of their segments, with a confidence.

For each language a tree of byte contexts up to ORDER bytes is counted over
labelled sentences and then frozen. Prediction by partial matching (method C,
without exclusion) gives every byte its exact code length under each language:
the longest context that has seen the byte codes it, each longer context that
has not pays for its escape. Contexts don't reach across word starts, so a
word's code lengths depend on the word alone and equal words are scored once.
The language with the shortest code wins; the others' extra bits give the
confidence.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import spread

ORDER = 5
#: Labelled sentences that the models are trained on; of more, about as many with the lowest hash are taken.
MAX_SAMPLES = 20_000
#: Rows of the corpus with a label that the models agree with which they are trained on as well, those with the lowest hash.
LABELLED_ROWS = 6_000
#: Bits by which a segment must favour its language over the row's main one to count as another language.
MARGIN_BITS = 4.0
#: The same for each byte of the segment: what models trained on few sentences differ by within one language.
MARGIN_RATE = 0.4
#: Bits by which the main language of a row must lead; below, the row's language is unknown.
LEAST_BITS = 4.0

#: Three-letter codes (ISO 639-2) of two-letter ones.
THREE_LETTER = {
    "eng": "en", "spa": "es", "por": "pt", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "rus": "ru", "jpn": "ja", "ita": "it",
    "nld": "nl", "dut": "nl", "zho": "zh", "chi": "zh", "bul": "bg", "ukr": "uk", "ara": "ar", "kor": "ko", "pol": "pl", "swe": "sv", "tur": "tr",
}

#: Markup, entities, and brackets around one or two words: notes, initials or places.
_MARKUP = re.compile(r"<[^<>]{0,300}>|&#?\w{1,10};?|[(\[（]\s*[^\s()\[\]]+(?:\s*[\s,/]\s*[^\s()\[\]]+)?\s*[)\]）]")
_SENTENCE = re.compile(r"(?<=[.!?…][\"'”’»)\]])\s+|(?<=[.!?…])\s+|(?<=[。！？])\s*|\s[/|]\s")
_WORD = re.compile(r"\n|[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Han and kana other than katakana: names of places in Japanese are katakana.
_CJK_WORDS = re.compile(r"[぀-ゟ一-鿿]")


def label_code(column: str) -> Column:
    """Two-letter code that a label spells, whatever its case, region or length; null where it names no language."""
    base = F.lower(F.regexp_extract(F.col(column), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    three = F.create_map(*[F.lit(x) for kv in THREE_LETTER.items() for x in kv])
    code = F.when(F.length(base) == 3, F.element_at(three, base)).when(F.length(base) == 2, base)
    return F.when(~code.isin("xx", "zz"), code)


@dataclass
class Models:
    langs: list[str]
    escape_keys: list[np.ndarray]  # of each order, sorted
    escape_bits: list[np.ndarray]  # rows as escape_keys, a column for each language; nan where the context is unknown
    symbol_keys: list[np.ndarray]
    symbol_bits: list[np.ndarray]  # nan where the context has not seen the byte


def framed(word: str) -> bytes:
    return b" " + word.encode("utf-8", "replace") + b" "


def scored_words(raw: list[str]) -> list[str]:
    """Words in lower case, without those in title case: most are names, which say nothing of the language."""
    kept = [w.lower() for w in raw if not w.istitle()]
    return kept or [w.lower() for w in raw]


def _keys(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k bytes before each position as one number: exact, not a hash."""
    key = np.zeros(len(at), np.int64)
    for j in range(k, 0, -1):
        key = (key << 8) | data[at - j]
    return key


def train(samples: list[tuple[str, str]]) -> Models:
    """Counts the context trees over (language, text) pairs and freezes them."""
    langs = sorted({lang for lang, _ in samples})
    seen: list[dict] = [defaultdict(lambda: [Counter() for _ in langs]) for _ in range(ORDER + 1)]
    words = Counter((langs.index(lang), w) for lang, text in samples for w in scored_words(_WORD.findall(text.replace("\n", " "))))
    for (li, w), n in words.items():
        b = framed(w)
        for i in range(1, len(b)):
            for k in range(min(i, ORDER) + 1):
                seen[k][b[i - k : i]][li][b[i]] += n
    m = Models(langs, [], [], [], [])
    for tree in seen:
        ctx = sorted(tree, key=lambda c: int.from_bytes(c, "big"))
        esc = np.full((len(ctx), len(langs)), np.nan)
        sym: dict[int, np.ndarray] = {}
        for r, c in enumerate(ctx):
            for li, counts in enumerate(tree[c]):
                if not counts:
                    continue
                total, kinds = sum(counts.values()), len(counts)
                esc[r, li] = -np.log2(kinds / (total + kinds))
                for s, n in counts.items():
                    sym.setdefault(int.from_bytes(c, "big") << 8 | s, np.full(len(langs), np.nan))[li] = -np.log2(n / (total + kinds))
        m.escape_keys.append(np.array([int.from_bytes(c, "big") for c in ctx], np.int64))
        m.escape_bits.append(esc)
        order = sorted(sym)
        m.symbol_keys.append(np.array(order, np.int64))
        m.symbol_bits.append(np.array([sym[x] for x in order]).reshape(len(order), len(langs)))
    return m


def code_lengths(m: Models, words: list[str]) -> np.ndarray:
    """Bits of each word under each language."""
    parts = [framed(w) for w in words]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    sizes = np.array([len(p) for p in parts])
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    depth = np.arange(len(data)) - start
    at = np.flatnonzero(depth > 0)
    bits = np.full((len(at), len(m.langs)), 8.0)
    for k in range(ORDER + 1):
        rows = np.flatnonzero(depth[at] >= k)
        if not len(rows) or not len(m.escape_keys[k]):
            continue
        key = _keys(data, at[rows], k)
        i = np.minimum(np.searchsorted(m.escape_keys[k], key), len(m.escape_keys[k]) - 1)
        known = m.escape_keys[k][i] == key
        rows, key, i = rows[known], key[known], i[known]
        esc = m.escape_bits[k][i]
        cost = np.where(np.isnan(esc), 0.0, esc) + bits[rows]
        key = key << 8 | data[at[rows]]
        j = np.minimum(np.searchsorted(m.symbol_keys[k], key), len(m.symbol_keys[k]) - 1)
        hit = m.symbol_keys[k][j] == key
        own = m.symbol_bits[k][j[hit]]
        cost[hit] = np.where(np.isnan(own), cost[hit], own)
        bits[rows] = cost
    word = np.repeat(np.arange(len(words)), sizes)[at]
    out = np.zeros((len(words), len(m.langs)))
    np.add.at(out, word, bits)
    return out


def models_of(samples: DataFrame, rows: DataFrame | None = None, lang: str = "lang", text: str = "text", most: int = MAX_SAMPLES, most_rows: int = LABELLED_ROWS) -> Models:
    """Models trained on about ``most`` labelled sentences at most, and, where rows with title, summary and label are given,
    once more with those of about ``most_rows`` rows whose label the first models confirm. Rows without label or text are left out."""
    sure = samples.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    pairs = [(r[0], r[1]) for r in _drawn(sure, F.xxhash64(text, lang), most).collect()]
    m = train(pairs)
    if rows is None or not m.langs:
        return m
    r = rows.select(label_code("lang").alias("code"), "title", "summary").where(F.col("code").isin(m.langs) & F.col("title").isNotNull())
    drawn = _drawn(r, F.xxhash64("title", "summary"), most_rows).collect()
    for x, (main, langs, _) in zip(drawn, score(m, [(x.title, x.summary) for x in drawn])):
        if main == x.code and len(langs) == 1:
            pairs += [(x.code, t) for _, t in segments(x.title, x.summary)]
    return train(pairs)


def _drawn(df: DataFrame, by: Column, most: int) -> DataFrame:
    """About ``most`` rows, or all of fewer: those below a threshold of a hash, so that tasks send no more than what is drawn."""
    share = min(1.0, most / max(1, df.count()))
    return df.where(F.pmod(by, F.lit(1 << 30)) < int(share * (1 << 30)))


def segments(title: str | None, summary: str | None) -> list[tuple[str, str]]:
    """(field, text) of each headline and sentence."""
    out = [("title", p) for p in _SENTENCE.split(_MARKUP.sub(" ", title)) if p.strip()] if title else []
    if summary:
        out += [("summary", p) for p in _SENTENCE.split(_MARKUP.sub(" ", summary)) if p.strip()]
    return out


def score(m: Models, rows: list[tuple[str | None, str | None]]) -> list[tuple[str | None, list[str], list[tuple[str, int, str, float]]]]:
    """(main language, all languages, segments) of each (title, summary)."""
    segs = [(i, f, t) for i, (a, b) in enumerate(rows) for f, t in segments(a, b)]
    tokens = _WORD.findall("\n".join(t.replace("\n", " ") for _, _, t in segs)) if segs else []
    out: list = [(None, [], []) for _ in rows]
    if not segs:
        return out
    # Equal words are looked at once: their code lengths, whether they are title case, lower case or Japanese.
    codes, uniq = pd.factorize(np.array(tokens, object))
    uniq = list(uniq)
    gap = np.array([w == "\n" for w in uniq])
    cost = np.where(gap[:, None], 0.0, code_lengths(m, [w.lower() for w in uniq]))
    name = np.array([w.istitle() for w in uniq])
    plain = np.array([w[0].islower() or bool(_CJK_WORDS.search(w)) for w in uniq]) & ~gap
    capital = np.array([len(w) > 1 and w.isupper() for w in uniq])
    size = np.where(gap, 0, np.array([len(w.encode("utf-8", "replace")) + 1 for w in uniq]))
    breaks = np.flatnonzero(gap[codes])
    a, b = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(codes)]])

    def per_segment(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x[codes], axis=0)])
        return total[b] - total[a]

    kept = per_segment(~name & ~gap) > 0
    bits = np.where(kept[:, None], per_segment(np.where(name[:, None], 0.0, cost)), per_segment(cost))
    length = np.where(kept, per_segment(np.where(name, 0, size)), per_segment(size))
    need = np.maximum(MARGIN_BITS, MARGIN_RATE * length)
    bears = (per_segment(plain) > 0) | ((b - a > 5) & (per_segment(capital) > 0))
    # Places a segment among the languages; rows are walked with their segments together.
    i = 0
    while i < len(segs):
        j = i
        while j < len(segs) and segs[j][0] == segs[i][0]:
            j += 1
        own = [k for k in range(i, j) if bears[k]]
        if own:
            out[segs[i][0]] = _row(m, segs, bits, need, own)
        i = j
    return out


def _row(m: Models, segs: list, bits: np.ndarray, need: np.ndarray, own: list[int]):
    best = bits[own].argmin(axis=1)
    lead = np.sort(bits[own], axis=1)
    lead = lead[:, 1] - lead[:, 0] if bits.shape[1] > 1 else np.full(len(own), 99.0)
    weight = np.bincount(best, weights=np.minimum(lead, 200.0), minlength=len(m.langs))
    # Every segment votes with its lead; what a single long one wins by is bounded.
    main = int(weight.argmax())
    if weight[main] < LEAST_BITS:
        return None, [], []
    found, detail = {main}, []
    for k, bst in zip(own, best.tolist()):
        if bst != main and bits[k, main] - bits[k, bst] < need[k]:
            bst = main
        found.add(bst)
        x = np.exp2(np.minimum(bits[k, bst] - bits[k], 60.0))
        detail.append((segs[k][1], k - own[0], m.langs[bst], float(1.0 / x.sum())))
    return m.langs[main], sorted(m.langs[x] for x in found), detail


SEGMENT = "array<struct<field:string,segment:int,lang:string,confidence:double>>"


def identify(rows: DataFrame, samples: DataFrame, training: DataFrame | None = None, key: str = "raw_offset", title: str = "title", summary: str = "summary") -> DataFrame:
    """``key``, ``main``, ``langs`` and ``segments`` of each row.

    Texts that are null, empty, or hold only names of places, numbers or
    markup have null ``main`` and empty lists. Repeated rows are judged each;
    other columns are left out; texts are read whole.
    """
    kind = rows.schema[key].dataType.simpleString()
    shipped = rows.sparkSession.sparkContext.broadcast(models_of(samples, training))
    seg_type = pa.list_(pa.struct([("field", pa.string()), ("segment", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            got = score(m, list(zip(b.column(1).to_pylist(), b.column(2).to_pylist())))
            segs = [[dict(zip(("field", "segment", "lang", "confidence"), s)) for s in x[2]] for x in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.list_(pa.string())), pa.array(segs, seg_type)],
                names=[key, "main", "langs", "segments"],
            )

    return spread(rows.select(key, title, summary)).mapInArrow(run, f"`{key}` {kind}, main string, langs array<string>, segments {SEGMENT}")


def mislabelled(rows: DataFrame, samples: DataFrame, key: str = "raw_offset", lang: str = "lang") -> DataFrame:
    """``key`` and ``lang`` for each language of a row whose label does not name it or whose text holds several."""
    labelled = rows.select(F.struct(F.col(key).alias("k"), label_code(lang).alias("code")).alias("__id"), "title", "summary")
    found = identify(labelled, samples, rows, key="__id")
    case = (F.size("langs") > 1) | ((F.size("langs") == 1) & (F.col("__id.code").isNull() | (F.col("__id.code") != F.col("main"))))
    return found.where(case).select(F.col("__id.k").alias(key), F.explode("langs").alias("lang"))
