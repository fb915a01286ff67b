"""Byte-level BPE over Arrow batches.

A batch's texts are cut into pre-tokens at once, on arrays of code points.
Equal pre-tokens are resolved once: a minimal perfect hash answers those that
are whole words of the vocabulary, a heap over a linked list of bytes merges
the others. No step loops over single occurrences.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash

DEFAULT_FOLDER = "/opt/tokenizers"
DEFAULT_NAME = "byte_bpe_50k"

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Endings that the pattern takes after an apostrophe (fixed values of the tokenizer's pattern).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Merged pre-tokens that a worker remembers; it forgets all of them beyond that.
MEMO = 1_000_000


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, cls in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            for a, b in ((m.start(), m.end()),):
                for lo, hi, shift in ((0, 0xD800, 0), (0xD800, 0x10F800, 0x800)):
                    x, y = max(a, lo), min(b, hi)
                    if x < y:
                        out[x + shift : y + shift] = cls
    return out


def pretoken_starts(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where a pre-token starts, over texts laid end to end.

    ``first`` holds where each non-empty text starts. What the pattern says of
    runs: a run of letters, numbers or others takes one blank before it; of
    white space before something else, the last character stands alone.
    """
    n = len(cps)
    if not n:
        return np.empty(0, np.int64)
    cls = char_classes()[cps]
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    opens[n] = True
    run = opens[:n].copy()
    run[1:] |= cls[1:] != cls[:-1]
    blank = np.zeros(n, bool)  # a blank just before, in the same text
    blank[1:] = (cps[:-1] == 32) & ~opens[1:n]
    space = cls == SPACE
    start = run & (space | ~blank)
    last = space & ~opens[1:]  # the last of a run of white space that something follows in its text
    last[:-1] &= ~space[1:]
    last[-1] = False
    start |= last
    # An apostrophe that opens a pre-token takes its ending along.
    at = np.flatnonzero((cps == 39) & start & ~blank)
    at = at[at + 1 < n]
    at = at[~opens[at + 1]]
    if len(at):
        c1 = cps[at + 1]
        c2 = np.where((at + 2 < n), cps[np.minimum(at + 2, n - 1)], 0)
        c2 = np.where(opens[np.minimum(at + 2, n)], 0, c2)
        size = np.zeros(len(at), np.int64)
        for e in ENDINGS:
            hit = (c1 == ord(e[0])) if len(e) == 1 else (c1 == ord(e[0])) & (c2 == ord(e[1]))
            size = np.where((size == 0) & hit, len(e), size)
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        after = at + 1 + size
        inside = after < n
        after = after[inside]
        keep = ~opens[after] & (cls[after] == LETTER)
        start[after[keep]] = True
    return np.flatnonzero(start)


class MinimalPerfectHash:
    """Hash and displace: every key of a fixed set gets a slot of its own among exactly as many slots."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        self.buckets = max(1, n // 3)
        b = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        ends = np.searchsorted(b[order], np.arange(self.buckets + 1))
        # Below 0: the bucket's single key has slot -shift - 1.
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_key = np.full(n, -1, np.int64)
        taken = np.zeros(n, bool)
        sizes = ends[1:] - ends[:-1]
        for k in np.argsort(-sizes, kind="stable").tolist():
            own = order[ends[k] : ends[k + 1]]
            if len(own) < 2:
                break
            d = 0
            while True:
                tries = np.arange(d, d + 64, dtype=np.uint64)[:, None]
                s = self._slots(h[own][None, :], tries)
                free = ~taken[s].any(axis=1)
                t = np.sort(s, axis=1)
                free &= (t[:, 1:] != t[:, :-1]).all(axis=1)
                if free.any():
                    i = int(free.argmax())
                    break
                d += 64
            self.shift[k] = d + i
            taken[s[i]] = True
            self.slot_key[s[i]] = own
        singles = np.flatnonzero(sizes == 1)
        rest = np.flatnonzero(~taken)
        self.shift[singles] = -rest - 1
        self.slot_key[rest] = order[ends[singles]]

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        return ((x * np.uint64(0x94D049BB133111EB)) >> np.uint64(17)).astype(np.int64) % self.n

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each key the number it has if it is of the set; any number otherwise, so compare."""
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.slot_key[np.where(shift < 0, -shift - 1, self._slots(h, shift.astype(np.uint64)))]


@dataclass
class Encoded:
    """Token ids of texts laid end to end: text i has ids[bounds[i]:bounds[i + 1]]."""

    ids: np.ndarray
    bounds: np.ndarray
    cps: np.ndarray
    first: np.ndarray  # where each text starts in cps
    pre: np.ndarray  # where each pre-token starts in cps
    pre_tokens: np.ndarray  # tokens of each pre-token


class ByteBPE:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.words = list(self.rank)
        self.ids = np.array([self.rank[w] for w in self.words], np.int32)
        self.size = np.zeros(int(self.ids.max()) + 1, np.int32)
        self.size[self.ids] = [len(w) for w in self.words]
        self.mph = MinimalPerfectHash(self.words)
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merges adjacent parts, lowest rank first, leftmost first among equals."""
        n, rank = len(piece), self.rank
        end, nxt, prv, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or end[j] != e:
                continue
            alive[j] = False
            end[i], k = e, nxt[j]
            nxt[i] = k
            if k < n:
                prv[k] = i
                if (r := rank.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (p := prv[i]) >= 0 and (r := rank.get(piece[p:e])) is not None:
                heapq.heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = nxt[i]
        return tuple(out)

    def resolve(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        if not pieces:
            return []
        at = self.mph.find(pieces)
        out = []
        for p, k in zip(pieces, at.tolist()):
            if self.words[k] == p:
                out.append((int(self.ids[k]),))
                continue
            got = self.memo.get(p)
            if got is None:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                got = self.memo[p] = self.merge(p)
            out.append(got)
        return out

    def encode(self, texts: list[str | None]) -> Encoded:
        """Null and empty texts have no tokens."""
        whole = "".join(t or "" for t in texts)
        cps = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        pre = pretoken_starts(cps, first[:-1][sizes > 0])
        m = len(pre)
        if not m:
            return Encoded(np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64), cps, first, pre, np.empty(0, np.int64))
        stop = np.append(pre[1:], len(cps))
        codes, lead = _classes(cps, pre, stop)
        ids = self.resolve([whole[a:b].encode() for a, b in zip(pre[lead].tolist(), stop[lead].tolist())])
        n_of = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((y for x in ids for y in x), np.int32, int(n_of.sum()))
        at_of = np.cumsum(n_of) - n_of
        per = n_of[codes]
        ends = np.cumsum(per)
        take = np.repeat(at_of[codes] - (ends - per), per) + np.arange(int(ends[-1]))
        counts = np.concatenate([[0], ends])
        return Encoded(flat[take], counts[np.searchsorted(pre, first)], cps, first, pre, per)


def _classes(cps: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers spans so that equal numbers mean equal code points; and one span of each number."""
    base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    up = np.cumprod(np.full(len(cps), base, np.uint64))
    down = np.cumprod(np.full(len(cps), inverse, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * up)])
    key = (total[b] - total[a]) * down[a]
    key ^= (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    codes, _ = pd.factorize(key)
    lead = np.zeros(codes.max() + 1, np.int64)
    lead[codes[::-1]] = np.arange(len(codes))[::-1]
    # Equal keys are held against the texts; spans that differ after all are numbered anew.
    size = b - a
    other = lead[codes]
    odd = size != size[other]
    same = np.flatnonzero(~odd)
    reach = size[same]
    flat = np.repeat(np.arange(len(same)), reach)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(reach) - reach, reach)
    unlike = cps[a[same][flat] + within] != cps[a[other[same]][flat] + within]
    if unlike.any():
        odd[same[flat[unlike]]] = True
    if odd.any():
        extra = np.flatnonzero(odd)
        codes[extra] = len(lead) + np.arange(len(extra))
        lead = np.concatenate([lead, extra])
    return codes, lead


@lru_cache(maxsize=4)
def load(name: str = DEFAULT_NAME, folder: str = DEFAULT_FOLDER) -> ByteBPE:
    """A vocabulary, once per process."""
    return ByteBPE(f"{folder}/{name}.tiktoken")


def slices(texts: list[str | None], most: int) -> list[slice]:
    """Stretches of rows of about ``most`` characters together, so that arrays stay small; a longer text stands alone."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            out.append(slice(start, i))
            start, size = i, 0
        size += n
    return [*out, slice(start, len(texts))] if len(texts) else []
