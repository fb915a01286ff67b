"""Near-duplicate texts: a size-aware heavy-light join on sets of 5-character substrings.

Equal texts form one class first, so a text that many rows share is compared
once. Between different texts, keys bring candidates together, by size of set:

* small sets enumerate every subset of two elements of a beginning of their
  set, in one global order, that is long enough for two similar sets to share
  two of its elements;
* larger ones draw BANDS subsets of ROWS elements by minima of random hashes,
  so that two sets draw the same subset the likelier the more they share: all
  subsets would be too many;
* large sets scan inverted lists: each stands on the lists of its first
  elements, as many as a similar set must meet one of.

The two boundaries are chosen by cost, and sets within reach of a boundary
take the keys of both sides. Every candidate is then held against both texts.
Enumerated subsets and lists lose nothing; a pair of drawn subsets at exactly
the bound misses all of them with a chance of (1 - 0.8 ** ROWS) ** BANDS =
1.5e-4, at 0.85 of 1e-6.

Keys travel as blocks of numbers, many to a row, each to the bucket of its
key. Keys that many of a bounded sample of texts share are hot: their groups
are cut into cells, each a pair of parts of the group, which meet in buckets of
their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import Stages, spread

GRAM, THRESHOLD = 5, 0.8
ROWS, BANDS = 8, 48
#: Texts that the cost of lists is estimated from, and those that hot keys are looked for in with the times that make one.
COST_SAMPLE, HOT_SAMPLE, HOT_TIMES = 400, 4_096, 4
#: Members of a hot key that one cell is meant to hold, keys that a task takes, in how many buckets, and keys that a worker packs at a time.
CELL, KEYS, BUCKETS, FLUSH = 4_096, 500_000, 8, 1_000_000
#: Characters that a worker hashes at a time.
CHARS = 200_000
#: Bits of the sketch that spares most false candidates the comparison of their sets.
PARITY = 512
#: Nanoseconds, as measured, of a key on its way, of an element in one row of the drawn subsets, and of a pair that is held against both texts.
KEY_NS, GRAM_NS, PAIR_NS = 150, 4, 10_000
#: How many times as much as drawn subsets the keys that lose nothing may cost.
WORTH = 4
#: Sizes and places above this count as this and are not held against each other.
TOP = 65_535

_OTHER = regex.compile(r"[^\p{L}\p{N}]+")


def plain(text: str) -> str:
    """Lower case, every run of other characters than letters and digits one space, ends trimmed."""
    return _OTHER.sub(" ", text.lower()).strip(" ")


def article(title: str | None, summary: str | None) -> str:
    return f"{title or ''}\n{summary}" if summary else title or ""


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every substring of GRAM characters, texts in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(cps) < GRAM:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = cps[: len(cps) - GRAM + 1].copy()
    for k in range(1, GRAM):
        h = h * np.uint64(0x1000000000000B3) + cps[k : len(cps) - GRAM + 1 + k]
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[: len(h)] == owner[GRAM - 1 :]
    h, owner = h[inside], owner[: len(inside)][inside]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return owner, h


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's different hashes (of 48 bits), ascending, and how many; for fewer than 65,536 texts."""
    k = np.sort(owner.astype(np.uint64) << np.uint64(48) | h >> np.uint64(16))
    if len(k):
        k = k[np.concatenate([[True], k[1:] != k[:-1]])]
    owner = (k >> np.uint64(48)).astype(np.int64)
    return owner, k & np.uint64(2**48 - 1), np.bincount(owner, minlength=n)


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, ROWS, np.uint64) | np.uint64(1)


def subset_keys(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the subsets: element r of subset b is the least in part b of the r-th random order."""
    none = np.uint64(2**64 - 1)
    key = np.zeros(n * BANDS, np.uint64)
    filled = np.zeros(n * BANDS, bool)
    base = owner * BANDS
    for m in _multipliers():
        x = h * m
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        part = base + ((x >> np.uint64(40)) * np.uint64(BANDS) >> np.uint64(24)).astype(np.int64)
        least = np.full(n * BANDS, none)
        np.minimum.at(least, part, x << np.uint64(24) | h & np.uint64(2**24 - 1))
        filled |= least != none
        key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    key += np.tile(np.arange(BANDS, dtype=np.uint64), n)
    at = np.flatnonzero(filled)
    return at // BANDS, key[at]


def _ranks(owner: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Place of each element in its set; hashes ascend within a text, which is the global order."""
    return np.arange(len(owner)) - (np.cumsum(count) - count)[owner]


def list_keys(owner: np.ndarray, h: np.ndarray, count: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, place) of each set's first elements."""
    rank = _ranks(owner, count)
    take = rank < prefix(count, threshold)[owner]
    return owner[take], h[take] * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(0x5851F42D4C957F2D), rank[take]


def pair_keys(owner: np.ndarray, h: np.ndarray, count: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every subset of two of each set's first elements, one more than the lists take; a set of one is its own subset."""
    rank = _ranks(owner, count)
    first = np.minimum(prefix(count, threshold) + 1, count)
    take = rank < first[owner]
    owner, h, rank = owner[take], h[take], rank[take]
    who, keys = [owner[count[owner] == 1]], [h[count[owner] == 1] * np.uint64(0xA24BAED4963EE407)]
    for d in range(1, int(first.max(initial=0))):
        at = np.flatnonzero(owner[d:] == owner[: len(owner) - d]) if d < len(owner) else np.empty(0, np.int64)
        if not len(at):
            break
        x = h[at] * np.uint64(0x9E3779B97F4A7C15) ^ h[at + d]
        x ^= x >> np.uint64(29)
        who.append(owner[at])
        keys.append(x * np.uint64(0xBF58476D1CE4E5B9))
    return np.concatenate(who), np.concatenate(keys)


def prefix(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def boundaries(sizes: list[tuple[int, int]], meet: float, threshold: float = THRESHOLD, worth: float = WORTH) -> tuple[int, int]:
    """(lo, hi): sets of at most ``lo`` elements enumerate subsets, those of at least ``hi`` stand on lists, others draw subsets.

    ``sizes`` counts sets by size; ``meet`` is the share of pairs of like size
    that lists bring together. Drawn subsets cost their keys and the hashes of
    all elements; the other two their keys and the pairs that they bring
    together, the more the more sets are of like size, and may cost ``worth``
    times as much, for they lose nothing. Sets that a boundary puts on both
    sides count on both.
    """
    none = 1 << 40
    if not sizes:
        return 0, none
    x = np.array(sorted(sizes), np.float64)
    size, n = x[:, 0], x[:, 1]
    total = np.concatenate([[0], np.cumsum(n)])
    near = total[np.searchsorted(size, size / threshold, "right")] - total[np.searchsorted(size, size * threshold, "left")]
    p = prefix(size, threshold)
    drawn = worth * n * (BANDS * KEY_NS + size * ROWS * GRAM_NS)
    first, together = np.minimum(p + 1, size), meet * near / 2 * PAIR_NS
    listed, pairs = n * (p * KEY_NS + together), n * (np.maximum(first * (first - 1) / 2, 1) * KEY_NS + together)

    def least(gain: np.ndarray, both: np.ndarray) -> int:
        """How many sizes from the start take the other way: what they save against what those in reach pay besides."""
        saved = np.concatenate([[0.0], np.cumsum(gain)]) - both
        return int(saved.argmax())

    reach = np.searchsorted(size, size * threshold - 1e-9, "left")
    tail = np.concatenate([[0], np.cumsum(listed)])
    # From the large end: the first k sizes in descending order go by lists, those from threshold times the k-th on stand on lists as well.
    both = np.array([0.0] + [tail[len(size) - k] - tail[reach[len(size) - k]] for k in range(1, len(size) + 1)])
    k = least((drawn - listed)[::-1], both)
    head = np.concatenate([[0], np.cumsum(pairs)])
    up = np.searchsorted(size, size / threshold + 1e-9, "right")
    both = np.array([0.0] + [head[up[i - 1]] - head[i] for i in range(1, len(size) + 1)])
    i = min(least(drawn - pairs, both), len(size) - k)
    return (int(size[i - 1]) if i else 0), (int(size[len(size) - k]) if k else none)


def _blocks(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and (size + len(t) > CHARS or i - start >= 60_000):
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if texts:
        yield slice(start, len(texts))


def keys_of(texts: list[str], lo: int, hi: int, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, size, place) of the keys of some texts, those of a few at a time."""
    n = len(texts)
    owner, h = gram_hashes(texts)
    owner, h, count = _distinct(owner, h, n)
    parts = []
    drawn = (count > lo) & (count < hi)
    if drawn.any():
        of = drawn[owner]
        parts.append((*subset_keys(owner[of], h[of], n), None))
    small = (count > 0) & (count * threshold <= lo)
    if small.any():
        of = small[owner]
        parts.append((*pair_keys(owner[of], h[of], np.where(small, count, 0), threshold), None))
    large = count >= hi * threshold
    if large.any():
        of = large[owner]
        parts.append(list_keys(owner[of], h[of], np.where(large, count, 0), threshold))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none
    who = np.concatenate([x[0] for x in parts])
    place = np.concatenate([np.zeros(len(x[0]), np.int64) if x[2] is None else x[2] for x in parts])
    return who, np.concatenate([x[1] for x in parts]), count[who], place


#: One key of a text as it travels.
_KEY = np.dtype([("key", np.uint64), ("who", np.int64), ("size", np.uint16), ("place", np.uint16)])


#: Its bytes that travel: of the key, the two highest are all but known from the bucket.
_SENT = [0, 1, 2, 3, 4, 5, *range(8, _KEY.itemsize)]


def _pack(k: np.ndarray) -> bytes:
    """Byte by byte through all keys, for like bytes beside each other compress well."""
    return k.view(np.uint8).reshape(len(k), -1)[:, _SENT].T.tobytes()


def _unpack(raw: list[bytes]) -> np.ndarray:
    out = np.zeros(sum(map(len, raw)) // len(_SENT), _KEY)
    at, flat = 0, out.view(np.uint8).reshape(len(out), -1)
    for r in raw:
        b = np.frombuffer(r, np.uint8).reshape(len(_SENT), -1)
        flat[at : at + b.shape[1], _SENT] = b.T
        at += b.shape[1]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def cells(k: np.ndarray, hot: dict[int, int]) -> np.ndarray:
    """The keys, hot ones put into cells: a member goes to the cells of its part of the group with each part, itself included."""
    if not hot or not len(k):
        return k
    keys = np.array(sorted(hot), np.uint64)
    at = np.minimum(np.searchsorted(keys, k["key"]), len(keys) - 1)
    is_hot = keys[at] == k["key"]
    out = [k[~is_hot]]
    for i in np.unique(at[is_hot]).tolist():
        g, parts = k[is_hot & (at == i)], hot[int(keys[i])]
        own = _mixed(g["who"].view(np.uint64)) % np.uint64(parts)
        for other in range(parts):
            cell = g.copy()
            pair = np.minimum(own, np.uint64(other)) * np.uint64(parts) + np.maximum(own, np.uint64(other))
            cell["key"] = _mixed(g["key"] ^ _mixed(pair + np.uint64(1)))
            out.append(cell)
    return np.concatenate(out)


def _packed(lo: int, hi: int, threshold: float, buckets: int, hot: dict[int, int]):
    def flush(waiting: list[np.ndarray]) -> pa.RecordBatch:
        k = cells(np.concatenate(waiting), hot)
        # By the key's upper half: the sort within a bucket finds keys spread evenly.
        bucket = ((k["key"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        k, bucket = k[order], bucket[order]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        raw = [_pack(k[a:b]) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(k)])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[edge]), pa.array(raw, pa.binary())], names=["bucket", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        held = 0
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for s in _blocks(texts):
                who, key, size, place = keys_of(texts[s], lo, hi, threshold)
                k = np.empty(len(who), _KEY)
                k["key"], k["who"], k["size"], k["place"] = key, ids[s][who], np.minimum(size, TOP), np.minimum(place, TOP)
                waiting.append(k)
                held += len(k)
                if held >= FLUSH:
                    yield flush(waiting)
                    waiting, held = [], 0
        if held:
            yield flush(waiting)

    return run


def meeting(k: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b) of members of equal keys whose sizes, and places on lists, let them be similar; all pairs of each distance at once."""
    order = np.argsort(k["key"])
    key = k["key"][order]
    # Only keys that stand beside an equal one.
    same = key[1:] == key[:-1]
    many = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(key) else same
    key, order = key[many], order[many]
    who, size, place = k["who"][order], k["size"][order].astype(np.int64), k["place"][order].astype(np.int64)
    left = np.arange(len(key))
    d = 0
    while len(left):
        d += 1
        left = left[left + d < len(key)]
        left = left[key[left] == key[left + d]]
        x, y = left, left + d
        a, b = size[x], size[y]
        # What two sets can still share at these places, against what the bound asks; a size that is not known passes.
        can = np.minimum(a - place[x], b - place[y])
        fits = (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9) & (can >= threshold / (1 + threshold) * (a + b) - 1e-9)
        ok = fits | (np.maximum(a, b) == TOP)
        u, v = who[x[ok]], who[y[ok]]
        other = u != v
        u, v = u[other], v[other]
        if len(u):
            yield np.minimum(u, v), np.maximum(u, v)


def _met(threshold: float):
    """Pairs of texts that meet under any key of the buckets of a task, each once."""

    def once(us: list[np.ndarray], vs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        u, v = np.concatenate(us), np.concatenate(vs)
        o = np.lexsort((v, u))
        u, v = u[o], v[o]
        first = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) if len(u) else np.empty(0, bool)
        return u[first], v[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for bucket, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(bucket, []).append(raw)
        for bucket in list(by):
            us, vs, held = [], [], 0
            for u, v in meeting(_unpack(by.pop(bucket)), threshold):
                us.append(u)
                vs.append(v)
                held += len(u)
                if held >= FLUSH:
                    u, v = once(us, vs)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])
                    us, vs, held = [], [], 0
            if held:
                u, v = once(us, vs)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])

    return run


def _parities(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bits, size) of each set: PARITY counters modulo 2. Two sets differ in at least as many elements as their bits do."""
    owner, h = gram_hashes(texts)
    owner, h, count = _distinct(owner, h, len(texts))
    n = np.bincount(owner * PARITY + (h & np.uint64(PARITY - 1)).astype(np.int64), minlength=len(texts) * PARITY)
    return np.packbits((n & 1).astype(np.uint8).reshape(len(texts), PARITY), axis=1), count


def _verified(threshold: float):
    grams = lambda t: {t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                b = batch.slice(at, 1_000)
                x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
                number = {t: i for i, t in enumerate(dict.fromkeys(x + y))}
                bits, count = _parities(list(number))
                i, j = np.array([number[t] for t in x]), np.array([number[t] for t in y])
                apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                maybe = apart <= (1 - threshold) / (1 + threshold) * (count[i] + count[j]) + 1e-9
                ok, sim = [], []
                for k in np.flatnonzero(maybe).tolist():
                    p, q = grams(x[k]), grams(y[k])
                    n = len(p & q)
                    if n / (len(p) + len(q) - n) >= threshold - 1e-12:
                        ok.append(k)
                        sim.append(n / (len(p) + len(q) - n))
                take = pa.array(ok, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])

    return run


def similar_texts(texts: DataFrame, stages: Stages, threshold: float = THRESHOLD, bounds: tuple[int, int] | None = None, hot_times: int = HOT_TIMES, cell: int = CELL) -> DataFrame:
    """(a, b, similarity) with a < b for texts ``tid``, ``text``, all different, whose similarity reaches the threshold."""
    n = F.greatest(F.length("text") - (GRAM - 1), F.lit(0))
    sizes = texts.groupBy(F.when(n < 64, n).otherwise(F.floor(F.exp(F.floor(F.log(n) * 40) / 40))).cast("long").alias("n")).count().where("n > 0").collect()
    many = sum(r[1] for r in sizes)
    # By hash of the number, so that tasks send only what is drawn; beyond the sample's size none is sent in any number.
    share = min(1.0, HOT_SAMPLE / max(1, many))
    drawn = [r[0] for r in texts.where(F.pmod(F.xxhash64("tid"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text").collect()]
    if bounds is None:
        bounds = boundaries([(r[0], r[1]) for r in sizes], _meeting(drawn[:COST_SAMPLE], threshold), threshold)
    hot = hot_keys(drawn, many, bounds, threshold, hot_times, cell)
    total = sum(r[1] * (BANDS if r[0] < bounds[1] else int(prefix(np.array([r[0]]), threshold)[0])) for r in sizes)
    parts = max(math.ceil(total / KEYS), texts.sparkSession.sparkContext.defaultParallelism)
    keys = spread(texts.select("tid", "text")).mapInArrow(_packed(*bounds, threshold, BUCKETS * parts, hot), "bucket int, keys binary")
    pairs = keys.repartition(parts, "bucket").mapInArrow(_met(threshold), "a long, b long").distinct()
    # The keys' shuffle goes before the texts' begins.
    pairs = stages.write(pairs, "pairs")
    stages.sweep()
    left, right = texts.select(F.col("tid").alias("a"), F.col("text").alias("ta")), texts.select(F.col("tid").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_verified(threshold), "a long, b long, similarity double")


def hot_keys(sample: list[str], many: int, bounds: tuple[int, int], threshold: float, times: int = HOT_TIMES, cell: int = CELL) -> dict[int, int]:
    """Keys that ``times`` texts of the sample share, with the parts that their group among ``many`` texts is cut into; one part is none."""
    keys = [k for s in _blocks(sample) for k in [keys_of(sample[s], *bounds, threshold)[1]]]
    if not keys:
        return {}
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    at = np.flatnonzero(count >= times)
    parts = np.ceil(2 * count[at] / len(sample) * many / cell).astype(int)
    return {int(k): int(p) for k, p in zip(key[at], parts) if p > 1}


def _meeting(sample: list[str], threshold: float = THRESHOLD) -> float:
    """Share of the sample's pairs of like size that lists bring together."""
    ids, ks, sizes = np.arange(len(sample)), [], []
    for s in _blocks(sample):
        who, key, size, place = keys_of(sample[s], 0, 1, threshold)
        k = np.empty(len(who), _KEY)
        k["key"], k["who"], k["size"], k["place"] = key, ids[s][who], np.minimum(size, TOP), np.minimum(place, TOP)
        ks.append(k)
        sizes.append(size[place == 0])
    if not ks:
        return 0.0
    n = np.sort(np.concatenate(sizes))
    like = int((np.searchsorted(n, n / threshold + 1e-9, "right") - np.arange(len(n)) - 1).sum())
    met = {x for u, v in meeting(np.concatenate(ks), threshold) for x in (u * len(sample) + v).tolist()}
    return len(met) / like if like else 0.0


def normalized(rows: DataFrame, title: str = "title", summary: str = "summary") -> DataFrame:
    """The rows without both columns, with the ``digest`` of their normal text and the ``text``, null where it has fewer than GRAM characters."""
    rest = [c for c in rows.columns if c not in (title, summary)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [plain(article(x, y)) for x, y in zip(b.column(len(rest)).to_pylist(), b.column(len(rest) + 1).to_pylist())]
            digests = [xxhash.xxh3_128_digest(t.encode("utf-8", "replace")) for t in texts]
            kept = [t if len(t) >= GRAM else None for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(digests, pa.binary()), pa.array(kept, pa.string())], names=[*rest, "digest", "text"])

    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest] + ["digest binary", "text string"])
    return spread(rows.select(*rest, title, summary)).mapInArrow(run, schema)


def near_duplicates(texts: DataFrame, members: DataFrame, stages: Stages | None = None, threshold: float = THRESHOLD, bounds: tuple[int, int] | None = None, **hot: int) -> tuple[DataFrame, DataFrame]:
    """(links, members): (a, b, similarity) between different texts, and (key, tid): which key has which text.

    ``texts`` hold ``digest`` and ``text`` as ``normalized`` gives them,
    ``members`` say by (key, digest) who has which. A key without a set, for
    its text has fewer than GRAM characters, takes no part, nor does a null
    key; copies meet in one ``tid`` and are not paired.
    """
    stages = stages or Stages(texts.sparkSession, "neardup")
    members = stages.write(members.where("key IS NOT NULL").select("key", "digest"), "keys")
    one = texts.where("text IS NOT NULL").groupBy("digest").agg(F.first("text").alias("text"))
    # Texts that only rows without a key or repeats hold are nobody's.
    one = one.join(members.select("digest").distinct(), "digest", "left_semi").withColumn("tid", F.monotonically_increasing_id())
    one = stages.write(one, "texts")
    who = stages.write(members.join(one.select("digest", "tid"), "digest").select("key", "tid"), "members")
    stages.sweep()
    return stages.write(similar_texts(one.select("tid", "text"), stages, threshold, bounds, **hot), "links"), who


def pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row (id_a, id_b, similarity) per pair of keys, smaller first: copies of one text, and members of linked texts."""
    m = members.distinct()
    many = m.join(m.groupBy("tid").count().where("count > 1").select("tid"), "tid", "left_semi")
    same = many.select("tid", F.col("key").alias("x")).join(many.select("tid", F.col("key").alias("y")), "tid").where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    linked = m.join(links.select(F.explode(F.array("a", "b")).alias("tid")).distinct(), "tid", "left_semi")
    cross = (
        links.join(linked.select(F.col("tid").alias("a"), F.col("key").alias("x")), "a")
        .join(linked.select(F.col("tid").alias("b"), F.col("key").alias("y")), "b")
        .select("x", "y", "similarity")
    )
    both = same.unionByName(cross).where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity").distinct()


def groups(links: DataFrame, members: DataFrame, rounds: int = 40) -> DataFrame:
    """(key, group, links): connected groups of near-duplicates by their lowest key, and the row's number of linked texts.

    Labels pass along links and then jump to the label's own label, until
    none changes; each round is a written table.
    """
    spark = links.sparkSession
    stages = Stages(spark, "groups")
    edges = stages.write(links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct(), "edges")
    label = stages.write(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).select(F.col("a").alias("v"), "l"), "l0")
    for i in range(1, rounds + 1):
        near = edges.join(label, edges.b == label.v).groupBy("a").agg(F.min("l").alias("n"))
        step = label.join(near, label.v == near.a).select("v", F.least("l", "n").alias("l"), F.col("l").alias("old"))
        jump = step.join(step.select(F.col("v").alias("w"), F.col("l").alias("ll")), F.col("l") == F.col("w")).select("v", F.least("l", "ll").alias("l"), "old")
        new = stages.write(jump, f"l{i}")
        changed = new.where("l <> old").limit(1).count()
        label = new.select("v", "l")
        if i > 1:
            stages.drop(f"l{i - 2}")
        if not changed:
            break
    else:
        raise RuntimeError("groups did not settle")
    # Copies have met in one text already: names are found among texts and go to rows with them.
    lowest = members.groupBy("tid").agg(F.min("key").alias("low"))
    named = lowest.join(label, lowest.tid == label.v, "left").select("tid", "low", F.coalesce("l", "tid").alias("l"))
    named = named.join(named.groupBy("l").agg(F.min("low").alias("group")), "l").select("tid", "group")
    degree = edges.groupBy(F.col("a").alias("tid")).agg(F.count("*").alias("links"))
    texts = stages.write(named.join(degree, "tid", "left").select("tid", "group", F.coalesce("links", F.lit(0)).alias("links")), "named")
    return members.join(texts, "tid").select("key", "group", "links")
