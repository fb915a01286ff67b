"""Cutting long texts into pieces at natural boundaries, with overlap.

Each token becomes one character of a skeleton that says what kind of boundary
follows it. Over the skeleton, one regular expression with bounded
quantifiers extracts the pieces: its alternatives, strongest boundary first,
take as many tokens as the limit allows, and no fewer than a share of it where there is another boundary. Offsets back into the skeleton give
the overlap. All but the skeleton is SQL functions on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import bpe
from newsloom.llm.encoding import CHARS
from newsloom.session import spread

LIMIT, OVERLAP = 512, 64
#: Share of the limit that a piece fills before a stronger boundary counts more than its size.
FILL = 0.5
#: Kinds of boundary, strongest first: paragraph, sentence or line, word; within a word; within a character.
PARAGRAPH, SENTENCE, WORD, INSIDE, BROKEN = "PSWcx"

#: What ends a sentence, what ends one without white space after it, and what may close behind it.
STOPS = ".!?…。！？"
WIDE_STOPS = "。！？"
CLOSERS = "\"'”’»›)]}」』）】"
#: Markup that ends a paragraph.
BLOCK_ENDS = ("</p>", "</div>", "</li>", "<br>", "<br/>")


def _members(cps: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(cps, np.array([ord(c) for c in chars], np.uint32))


def boundary_kinds(cps: np.ndarray, at: np.ndarray, text_end: np.ndarray) -> np.ndarray:
    """Kind of the boundary at each position of ``at`` (0 < position <= len); ``text_end`` marks positions that end a text."""
    n = len(cps)
    space = bpe.char_classes()[cps] == bpe.SPACE
    lf, cr = cps == 10, cps == 13
    breaks = lf | (cr & ~np.append(lf[1:], False)) | _members(cps, "  ")
    total = np.concatenate([[0], np.cumsum(breaks)])
    idx = np.arange(n)
    solid = np.maximum.accumulate(np.where(space, -1, idx))  # last character that is no white space
    before, nxt = at - 1, np.minimum(at, n - 1)
    ends = text_end | (at >= n)
    after_space = ~ends & space[nxt]
    lines = total[at] - total[solid[before] + 1]
    closing, stop, wide = _members(cps, CLOSERS), _members(cps, STOPS), _members(cps, WIDE_STOPS)
    word_end = np.maximum.accumulate(np.where(closing | space, -1, idx))  # last character that neither closes nor is space
    w = word_end[before]
    stopped = (w >= 0) & stop[np.maximum(w, 0)]
    wide_stopped = (w >= 0) & wide[np.maximum(w, 0)]
    kind = np.full(len(at), INSIDE)
    prev_space = space[before]
    whole_word = ~prev_space & (after_space | ends)
    kind[whole_word] = WORD
    kind[(whole_word & stopped) | (~prev_space & wide_stopped & ~(~ends & closing[nxt]))] = SENTENCE
    run_over = prev_space & (ends | ~after_space)
    kind[run_over & (lines == 1)] = SENTENCE
    kind[run_over & (lines >= 2)] = PARAGRAPH
    angle = np.flatnonzero(~prev_space & (cps[before] == ord(">")))
    for end in BLOCK_ENDS:
        hit = angle[at[angle] >= len(end)]
        for k, c in enumerate(reversed(end)):
            x = cps[at[hit] - 1 - k]
            hit = hit[(x == ord(c)) | (x == ord(c.upper()))]
        kind[hit] = PARAGRAPH
    return kind


def skeletons(coder: bpe.ByteBPE, texts: list[str]) -> Iterator[tuple[int, str, np.ndarray]]:
    """(tokens, skeleton, end of each token as a position in its text) of each text."""
    e = coder.encode(texts)
    if not len(e.ids):
        yield from ((0, "", np.empty(0, np.int32)) for _ in texts)
        return
    width = np.where(e.cps < 0x80, 1, np.where(e.cps < 0x800, 2, np.where(e.cps < 0x10000, 3, 4)))
    bytes_at = np.concatenate([[0], np.cumsum(width)])
    token_end = np.cumsum(coder.size[e.ids])
    pos = np.searchsorted(bytes_at, token_end)
    clean = bytes_at[pos] == token_end
    natural = np.zeros(len(e.cps) + 1, bool)
    natural[e.pre] = True
    natural[e.first] = True
    ends = np.zeros(len(e.cps) + 1, bool)
    ends[e.first] = True
    kind = np.full(len(pos), INSIDE)
    at = np.flatnonzero(clean & natural[pos])
    kind[at] = boundary_kinds(e.cps, pos[at], ends[pos[at]])
    kind[~clean] = BROKEN
    for i in range(len(texts)):
        a, b = e.bounds[i], e.bounds[i + 1]
        yield int(b - a), "".join(kind[a:b].tolist()), (pos[a:b] - e.first[i]).astype(np.int32)


def pattern(limit: int = LIMIT, overlap: int = OVERLAP, fill: float = FILL) -> str:
    """The first piece takes up to ``limit`` tokens, each later one as many less as its overlap may take.

    Alternatives, strongest first: as many tokens as fit that end a paragraph,
    a sentence, a word and are at least the share ``fill`` of the limit; then
    the same of any number; then a character. A lone character longer than the
    limit can't be cut and is taken whole.
    """
    natural = [PARAGRAPH, SENTENCE, WORD]
    take = lambda n: "|".join([f".{{{int(fill * n)},{n - 1}}}{k}" for k in natural if int(fill * n) < n] + [f".{{0,{n - 1}}}{k}" for k in [*natural, f"[^{BROKEN}]"]])
    return f"^(?:.{{1,{limit}}}$|{take(limit)})|(?:.{{1,{limit - overlap}}}$|{take(limit - overlap)}|.+?[^{BROKEN}])"


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, fill: float = FILL, name: str = bpe.DEFAULT_NAME, folder: str = bpe.DEFAULT_FOLDER) -> DataFrame:
    """Pieces of the texts that have more than ``limit`` tokens.

    Columns: ``key``, ``piece`` (from 0), ``n_pieces``, ``start`` and ``stop``
    (code points of the text), ``n_tokens``, ``overlap_tokens``,
    ``boundary`` (paragraph, sentence, word or none: what the piece ends at)
    and ``piece_text``. Without the repeats the pieces of a text join to it
    without loss. Null, empty and short texts have no pieces. Repeated rows
    are cut each; other columns are left out.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(name, folder)
        for b in batches:
            texts = b.column(1).to_pylist()
            # No token is longer than its bytes: a text of so few bytes is short for sure.
            rows = [i for i, t in enumerate(texts) if t and (len(t) > limit or len(t.encode()) > limit)]
            long = [texts[i] for i in rows]
            for s in bpe.slices(long, CHARS):
                at, skeleton, ends, kept = [], [], [], []
                for i, (n, sk, e) in zip(rows[s], skeletons(coder, long[s])):
                    if n > limit:
                        at.append(i)
                        skeleton.append(sk)
                        ends.append(e)
                        kept.append(texts[i])
                bounds = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
                flat = pa.array(np.concatenate(ends) if ends else np.empty(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), pa.array(kept, pa.string()), pa.array(skeleton, pa.string()), pa.ListArray.from_arrays(pa.array(bounds), flat)],
                    names=[key, "__text", "__skeleton", "__ends"],
                )

    kind = docs.schema[key].dataType.simpleString()
    t = spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, __text string, __skeleton string, __ends array<int>")
    t = t.withColumn("__cut", F.regexp_extract_all("__skeleton", F.lit(pattern(limit, overlap, fill)), F.lit(0)))
    # Where each piece's new part ends, in tokens.
    stops = F.aggregate("__cut", F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(c))))
    t = t.withColumn("__stops", stops)
    t = t.select(key, "__text", "__skeleton", "__ends", F.size("__cut").alias("n_pieces"), F.posexplode(F.slice("__stops", 2, F.size("__cut"))).alias("piece", "__b"), "__stops")
    t = t.withColumn("__a", F.expr("__stops[piece]"))
    # The overlap starts behind the first word end among the tokens before; where there is none, behind the first whole character.
    lo = F.greatest(F.col("__a") - overlap, F.lit(0))
    back = F.when(lo == 0, F.lit(0)).otherwise(
        lo - 1 + F.coalesce(
            F.nullif(F.regexp_instr(F.substring("__skeleton", lo, F.col("__a") - lo), F.lit(f"[{PARAGRAPH}{SENTENCE}{WORD}]")), F.lit(0)),
            F.nullif(F.regexp_instr(F.substring("__skeleton", lo, F.col("__a") - lo), F.lit(f"[^{BROKEN}]")), F.lit(0)),
            F.col("__a") - lo + 1,
        )
    )
    t = t.withColumn("__o", F.when((F.col("piece") == 0) | F.lit(overlap == 0), F.col("__a")).otherwise(F.least(back, F.col("__a"))))
    end_of = lambda c: F.when(F.col(c) == 0, F.lit(0)).otherwise(F.expr(f"__ends[{c} - 1]"))
    t = t.withColumn("start", end_of("__o")).withColumn("stop", end_of("__b"))
    names = F.create_map(*[F.lit(x) for kv in ((PARAGRAPH, "paragraph"), (SENTENCE, "sentence"), (WORD, "word")) for x in kv])
    return t.select(
        key, "piece", "n_pieces", "start", "stop", (F.col("__b") - F.col("__o")).alias("n_tokens"), (F.col("__a") - F.col("__o")).alias("overlap_tokens"),
        F.coalesce(names[F.substring("__skeleton", F.col("__b"), F.lit(1))], F.lit("none")).alias("boundary"),
        F.substring("__text", F.col("start") + 1, F.col("stop") - F.col("start")).alias("piece_text"),
    )
