"""Online clustering of articles into stories, one article at a time in log order.

Every decision depends on all decisions before it, so this is one sequential
state machine. It knows nothing of Spark; ``newsloom.streaming.stories`` feeds
it from a batch or a stream. The same inputs give the same events, whatever
the batches they come in and wherever the state was saved and restored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import pickle
from collections import Counter
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np

from newsloom.functions import minhash

MIN, HOUR = 60_000, 3_600_000
#: Tells how the state is laid out; state of another layout is not continued.
LAYOUT = 2
#: Bound of the error of a float32 product of two vectors, as a share of the product of their lengths.
SLACK = 1e-5
#: Vectors compared at once, and inputs looked up at once.
CHUNK, AHEAD = 1024, 256
#: Most alike vectors that are kept of an input looked up ahead.
KEPT = 48
_JSON = json.JSONEncoder(ensure_ascii=False, sort_keys=True)
CREATED, JOINED, NEAR_DUP, EXACT_DUP, LATE_DROPPED, INVALID = "created", "joined", "near_dup", "exact_dup", "late_dropped", "invalid"


@dataclass(frozen=True)
class Config:
    dup_jaccard: float = 0.8
    k: int = 10
    neighbor: float = 0.50
    centroid: float = 0.50
    established: int = 3
    established_votes: int = 2
    cohesion_margin: float = 0.10
    lateness_ms: int | None = 24 * HOUR
    tick_ms: int = 10 * MIN
    idle_ms: int = 48 * HOUR
    dedup_ms: int = 72 * HOUR
    seen_ms: int = 7 * 24 * HOUR
    lineage_every: int = 100
    split_size: int = 8
    split_part: int = 3
    split_below: float = 0.50
    merge_size: int = 3
    merge_anchored: float = 0.72
    merge_alone: float = 0.82
    anchor_share: float = 0.5
    confirm: int = 2
    cooldown: int = 6
    iterations: int = 12

    def fingerprint(self, centering: bytes = b"") -> str:
        """Tells configurations apart: state made under one is not continued under another."""
        return hashlib.sha256(json.dumps([LAYOUT, asdict(self)], sort_keys=True).encode() + centering).hexdigest()[:24]


@dataclass
class Article:
    id: str
    title: str
    source: str
    lang: str
    time: int
    story: int
    original: int | None = None  # the article that it copies
    words: tuple[str, ...] = ()
    vector: np.ndarray | None = None


@dataclass
class Story:
    id: str
    first: int = 0
    last: int = 0
    members: list[int] = field(default_factory=list)
    originals: list[int] = field(default_factory=list)
    total: np.ndarray | None = None
    fits: float = 0.0
    n_fits: int = 0
    headline: int = -1
    parents: list[str] = field(default_factory=list)
    merged_from: list[str] = field(default_factory=list)
    rests_until: int = 0
    sources: set[str] = field(default_factory=set)
    langs: set[str] = field(default_factory=set)
    middle: np.ndarray | None = None  # the centroid, while the total stays

    def centroid(self) -> np.ndarray:
        if self.middle is None:
            self.middle = unit(self.total)
        return self.middle

    def cohesion(self) -> float | None:
        return self.fits / self.n_fits if self.n_fits >= 2 else None


def unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def article_text(title: str, summary: str | None) -> str:
    return f"{title}\n{summary}" if summary else title


def title_words(title: str) -> tuple[str, ...]:
    return tuple(sorted({w for w in minhash.normalize(title).split(" ") if len(w) >= 3 and not w.isnumeric()}))


@dataclass
class Ahead:
    """What was looked up for an input among the vectors that were there before its batch and those of the batch."""

    vector: np.ndarray
    place: int
    sims: list[float]
    at: list[int]  # the article's number, or -1 - its place in the batch
    cut: float | None  # no vector that is left out is more alike than this; None if none is left out
    added: dict[int, int]  # numbers of those of the batch that were taken, by place


class Vectors:
    """Vectors of live originals, compared exactly. Rows of closed stories are dropped when a fifth is dead.

    Products of float32 matrices only tell which rows can reach a bound: the last
    column is the row's length times ``SLACK``, that of a query its length. What
    counts is computed anew from each such row alone, so it is the same however
    many are compared at once.
    """

    def __init__(self):
        self.keys: list[int] = []
        self.rows: np.ndarray | None = None
        self.n = self.dead = 0

    def _room(self, more: int, dim: int) -> None:
        if self.rows is None:
            self.rows = np.zeros((256, dim + 1), np.float32)
        while self.n + more > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])

    @staticmethod
    def _lengths(v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.einsum("ij,ij->i", v, v))

    def add(self, key: int, v: np.ndarray) -> None:
        self._room(1, len(v))
        self.rows[self.n, :-1] = v
        self.rows[self.n, -1] = SLACK * float(np.sqrt(v @ v))
        self.keys.append(key)
        self.n += 1

    def _exact(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The float32 nearest to the product of each row with its vector (or all with one)."""
        x = self.rows[at, :-1].astype(np.float64)
        return np.einsum("ij,ij->i" if v.ndim == 2 else "ij,j->i", x, v.astype(np.float32).astype(np.float64)).astype(np.float32)

    def nearest(self, v: np.ndarray, k: int, least: float, live) -> list[tuple[float, int]]:
        """The k live ones with the highest similarity, of those that reach ``least``; keys ascend, so equal ones come by key."""
        if not self.n:
            return []
        at = np.flatnonzero(self.rows[: self.n] @ np.append(v, np.sqrt(v @ v)).astype(np.float32) >= least)
        sims = self._exact(at, v)
        best: list[tuple[float, int]] = []
        for i in np.argsort(-sims, kind="stable").tolist():
            if sims[i] >= least and live(self.keys[at[i]]):
                best.append((float(sims[i]), self.keys[at[i]]))
                if len(best) == k:
                    break
        return best

    def ahead(self, vs: np.ndarray, least: float) -> list[Ahead]:
        """Looks up a batch of vectors at once, among all rows and those of the batch that come before each."""
        m, n, added = len(vs), self.n, {}
        length = self._lengths(vs)
        self._room(m, vs.shape[1])
        self.rows[n : n + m, :-1], self.rows[n : n + m, -1] = vs, SLACK * length
        q = np.column_stack([vs, length]).astype(np.float32)
        found = []
        for s in range(0, n + m, CHUNK):
            e = min(s + CHUNK, n + m)
            hit = np.flatnonzero((bound := q @ self.rows[s:e].T) >= least)
            who, row = np.divmod(hit, e - s)
            found.append((who, row + s, bound.ravel()[hit]))
        who, row, bound = (np.concatenate(x) for x in zip(*found))
        before = row < n + who
        who, row, bound = who[before], row[before], bound[before]
        order = np.lexsort((-bound, who))
        who, row, bound = who[order], row[order], bound[order]
        start = np.searchsorted(who, np.arange(m + 1))
        rank = np.arange(len(who)) - start[who]
        cut = {int(w): float(b) for w, b in zip(who[rank == KEPT], bound[rank == KEPT])}
        who, row = who[rank < KEPT], row[rank < KEPT]
        sims = self._exact(row, vs[who])
        order = np.lexsort((row, -sims, who))
        order = order[sims[order] >= least]
        who, row, sims = who[order], row[order], sims[order].tolist()
        at = [self.keys[r] if r < n else n - 1 - r for r in row.tolist()]
        start = np.searchsorted(who, np.arange(m + 1)).tolist()
        return [Ahead(vs[i], i, sims[a:b], at[a:b], cut.get(i), added) for i, (a, b) in enumerate(zip(start, start[1:]))]

    def nearest_of(self, known: Ahead, k: int, least: float, live) -> list[tuple[float, int]]:
        """``nearest`` of an input that was looked up ahead."""
        best: list[tuple[float, int]] = []
        for sim, at in zip(known.sims, known.at):
            key = at if at >= 0 else known.added.get(-1 - at, -1)
            if key >= 0 and live(key):
                best.append((sim, key))
                if len(best) == k:
                    break
        if known.cut is not None and (len(best) < k or best[-1][0] <= known.cut):
            return self.nearest(known.vector, k, least, live)
        return best

    def sweep(self, live) -> None:
        if self.dead > 0.2 * max(self.n, 1):
            keep = [i for i, key in enumerate(self.keys) if live(key)]
            self.rows = self.rows[keep] if keep else None
            if self.rows is not None:
                self.rows = np.concatenate([self.rows, np.zeros((256, self.rows.shape[1]), np.float32)])
            self.keys = [self.keys[i] for i in keep]
            self.n, self.dead = len(self.keys), 0


class Copies:
    """MinHash signatures by band: finds the live article most like a text."""

    def __init__(self):
        self.signature: dict[int, np.ndarray] = {}
        self.band: dict[int, int | list[int]] = {}  # one article, or several

    @staticmethod
    def bands(sigs: list[np.ndarray]) -> list[list[int]]:
        """A number for each band; that two bands may share one only means that more signatures are compared."""
        return (minhash.band_keys(np.stack(sigs)) + _BAND).tolist() if sigs else []

    def add(self, key: int, sig: np.ndarray, bands: list[int]) -> None:
        self.signature[key] = sig
        for b in bands:
            old = self.band.get(b)
            if old is None:
                self.band[b] = key
            elif isinstance(old, int):
                self.band[b] = [old, key]
            else:
                old.append(key)

    def find(self, sig: np.ndarray, bands: list[int], least: float) -> tuple[float, int] | None:
        candidates: set[int] = set()
        for b in bands:
            old = self.band.get(b)
            if isinstance(old, int):
                candidates.add(old)
            elif old:
                candidates.update(old)
        if not candidates:
            return None
        keys = sorted(candidates)
        share = (np.stack([self.signature[k] for k in keys]) == sig).mean(axis=1)
        best = int(share.argmax())
        return (float(share[best]), keys[best]) if share[best] >= least else None

    def drop(self, keys: list[int]) -> None:
        keys = [k for k in keys if k in self.signature]
        for key, bands in zip(keys, self.bands([self.signature.pop(k) for k in keys])):
            for b in bands:
                old = self.band.get(b)
                left = [k for k in old if k != key] if isinstance(old, list) else []
                if len(left) > 1:
                    self.band[b] = left
                elif left:
                    self.band[b] = left[0]
                elif old is not None:
                    del self.band[b]


_BAND = np.arange(minhash.BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


class Centres:
    """Centroids of the stories that are large enough to merge, in rows that are used again."""

    def __init__(self):
        self.rows: np.ndarray | None = None
        self.place: dict[int, int] = {}
        self.keys: list[int] = []  # -1 where a row is free
        self.free: list[int] = []

    def put(self, key: int, v: np.ndarray) -> None:
        at = self.place.get(key)
        if at is None:
            if self.free:
                at = self.free.pop()
                self.keys[at] = key
            else:
                at = len(self.keys)
                self.keys.append(key)
            self.place[key] = at
            if self.rows is None:
                self.rows = np.zeros((64, len(v)))
            if at == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = v

    def of(self, key: int) -> np.ndarray:
        return self.rows[self.place[key]]

    def drop(self, key: int) -> None:
        at = self.place.pop(key, None)
        if at is not None:
            self.keys[at] = -1
            self.rows[at] = 0
            self.free.append(at)


class StoryEngine:
    """``process`` takes one input and returns (outcome, late, events); ``process_all`` takes many, with the same results."""

    def __init__(self, config: Config | None = None, centre=None, model: str | None = None, tell: bool = True):
        """``tell``: whether events are made; without them only the outcomes come out."""
        self.c, self.tell = config or Config(), tell
        self.centre, self.model = centre, model
        self.articles: dict[int, Article] = {}
        self.stories: dict[int, Story] = {}
        self.vectors, self.copies, self.centres = Vectors(), Copies(), Centres()
        self.seen: dict[str, int] = {}
        # By time, what may have to go: (time, id) of seen ids, (time, article) of signatures, (time, story) of stories, whose time may be out of date.
        self.seen_by: list[tuple[int, str]] = []
        self.copies_by: list[tuple[int, int]] = []
        self.stories_by: list[tuple[int, int]] = []
        self.word_df: dict[str, int] = {}
        self.next_key = self.inputs = self.checks = 0
        self.dim: int | None = None
        self.max_event: int | None = None
        self.watermark: int | None = None
        self.tick: int | None = None
        self.dirty: set[int] = set()
        self.splits: dict[int, int] = {}
        self.merges: dict[tuple[int, int], int] = {}

    def save(self) -> bytes:
        return pickle.dumps((self.c.fingerprint(), self.__dict__))

    @classmethod
    def restore(cls, data: bytes, config: Config) -> StoryEngine:
        print_, state = pickle.loads(data)
        if print_ != config.fingerprint():
            raise ValueError("the state was made under another configuration")
        e = cls(config)
        e.__dict__.update(state)
        return e

    # One input.

    def process(self, row: dict, offset: int, known: Ahead | None = None) -> tuple[str, bool, list[dict]]:
        self.events: list[dict] = []
        self.offset = offset
        outcome, late = self._article(row, known)
        if outcome != INVALID:
            self.inputs += 1
            if self.inputs % self.c.lineage_every == 0:
                self.now = self.max_event
                self._lineage()
        return outcome, late, self.events

    def process_all(self, rows: Sequence[dict], offsets: Sequence[int]):
        """The same of many inputs, whose neighbours are looked up some hundred at a time. Yields what ``process`` returns."""
        for s in range(0, len(rows), AHEAD):
            part = rows[s : s + AHEAD]
            vectors = [self._vector(r) for r in part]
            dim = self.dim or next((len(v) for v in vectors if v is not None), None)
            fit = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim and np.isfinite(v).all()]
            known = dict(zip(fit, self.vectors.ahead(np.stack([vectors[i] for i in fit]), self.c.neighbor))) if fit else {}
            sketched = [r for r in part if r.get("sketch")]
            for r, bands in zip(sketched, self.copies.bands([self._sketch(r) for r in sketched])):
                r["bands"] = bands
            for i, r in enumerate(part):
                yield self.process(r, offsets[s + i], known.get(i))

    def _emit(self, kind: str, story: str, **payload) -> None:
        if not self.tell:
            return
        seq = len(self.events)
        raw = self.offset.to_bytes(8, "little", signed=True) + seq.to_bytes(4, "little")
        self.events.append(
            {"event_id": hashlib.sha256(raw).hexdigest()[:32], "event_time_ms": self.now, "watermark_ms": self.watermark or 0, "input_offset": self.offset, "seq": seq, "kind": kind, "story_id": story, "payload": _JSON.encode(payload)}
        )

    def _vector(self, r: dict) -> np.ndarray | None:
        v = r.get("vector")
        if not r.get("id") or v is None or not len(v) or (self.model is not None and r.get("model_version") != self.model):
            return None
        v = np.asarray(v, np.float64)
        return v if self.centre is None else self.centre(v, r.get("lang") or "")

    @staticmethod
    def _sketch(r: dict) -> np.ndarray | None:
        if (ready := r.get("sketch")) is None:
            return minhash.sketch(article_text(r.get("title") or "", r.get("summary")))
        return np.frombuffer(ready, np.uint64) if len(ready) else None

    def _article(self, r: dict, known: Ahead | None = None) -> tuple[str, bool]:
        v = self._vector(r) if known is None else known.vector
        if v is None:
            return INVALID, False
        if self.dim is None:
            self.dim = len(v)
        if known is None and (len(v) != self.dim or not np.isfinite(v).all()):
            return INVALID, False
        t = int(r["published_at_ms"] or r["fetched_at_ms"] or 0)
        self._advance(t)
        self.now = t
        late = self.watermark is not None and t < self.watermark
        if r["id"] in self.seen:
            return EXACT_DUP, late
        self.seen[r["id"]] = t
        heapq.heappush(self.seen_by, (t, r["id"]))
        a = Article(r["id"], r.get("title") or "", r.get("source_id") or "", r.get("lang") or "", t, -1)
        sig = self._sketch(r)
        bands = r.get("bands") or ([] if sig is None else self.copies.bands([sig])[0])
        a.words = title_words(a.title) if (words := r.get("words")) is None else tuple(words.split())
        if sig is not None and (hit := self.copies.find(sig, bands, self.c.dup_jaccard)):
            score, original = hit
            a.story, a.original = self.articles[original].story, original
            key = self._take(a, sig, bands)
            grew = self._join(self.stories[a.story], key, None)
            self._added(a, score, late, self.articles[original].id)
            if grew:
                self._updated(a.story)
            return NEAR_DUP, late
        a.vector = v
        for total, at in self._votes(v, known):
            a.story = at
            key = self._take(a, sig, bands, known)
            story = self.stories[at]
            grew = self._join(story, key, float(v @ story.centroid()))
            self._added(a, total, late, "")
            if self._pick_headline(story) or grew:
                self._updated(at)
            return JOINED, late
        if late:
            return LATE_DROPPED, late
        key = a.story = self.next_key
        self._take(a, sig, bands, known)
        story = self.stories[key] = Story("st_" + a.id[:16], t, t, headline=key)
        heapq.heappush(self.stories_by, (t, key))
        self._join(story, key, None)
        self._emit("created", story.id, seed_article_id=a.id, headline=a.title, lang=a.lang, parent_story_ids=[])
        return CREATED, late

    def _votes(self, v: np.ndarray, known: Ahead | None = None) -> list[tuple[float, int]]:
        """The story that the neighbours vote for and that admits the vector: none or one (vote sum, story)."""
        total: dict[int, float] = {}
        count: dict[int, int] = {}
        look = (self.c.k, self.c.neighbor, self.articles.__contains__)
        for sim, key in self.vectors.nearest(v, *look) if known is None else self.vectors.nearest_of(known, *look):
            s = self.articles[key].story
            total[s] = total.get(s, 0.0) + sim
            count[s] = count.get(s, 0) + 1
        for s in sorted(total, key=lambda s: (-total[s], s)):
            story = self.stories[s]
            if len(story.originals) >= self.c.established and count[s] < self.c.established_votes:
                continue
            fit, cohesion = float(v @ story.centroid()), story.cohesion()
            if fit >= self.c.centroid and (cohesion is None or fit >= cohesion - self.c.cohesion_margin):
                return [(total[s], s)]
        return []

    def _take(self, a: Article, sig: np.ndarray | None, bands: list[int], known: Ahead | None = None) -> int:
        """Gives the article its number and puts it where later ones look."""
        key, self.next_key = self.next_key, self.next_key + 1
        self.articles[key] = a
        for w in a.words:
            self.word_df[w] = self.word_df.get(w, 0) + 1
        if sig is not None:
            self.copies.add(key, sig, bands)
            heapq.heappush(self.copies_by, (a.time, key))
        if a.vector is not None:
            self.vectors.add(key, a.vector)
            if known is not None:
                known.added[known.place] = key
        return key

    def _join(self, story: Story, key: int, fit: float | None) -> bool:
        a = self.articles[key]
        self.dirty.add(a.story)
        known = a.source in story.sources and a.lang in story.langs
        story.members.append(key)
        story.first, story.last = min(story.first, a.time), max(story.last, a.time)
        story.sources.add(a.source)
        story.langs.add(a.lang)
        if a.vector is not None:
            story.originals.append(key)
            story.total = a.vector.copy() if story.total is None else story.total + a.vector
            story.middle = None
        if fit is not None:
            story.fits, story.n_fits = story.fits + fit, story.n_fits + 1
        return len(story.members) > 1 and not known

    def _medoid(self, story: Story) -> int:
        centre = story.centroid()
        return max(story.originals, key=lambda k: (float(centre @ self.articles[k].vector), -k))

    def _pick_headline(self, story: Story) -> bool:
        """Only at powers of two; says whether the headline changed."""
        n = len(story.originals)
        if n & (n - 1):
            return False
        old, story.headline = story.headline, self._medoid(story)
        return old != story.headline

    def _added(self, a: Article, score: float, late: bool, copy_of: str) -> None:
        self._emit("article_added", self.stories[a.story].id, article_id=a.id, score=round(score, 6), is_duplicate=bool(copy_of), duplicate_of=copy_of, late=late)

    def _updated(self, key: int) -> None:
        if not self.tell:
            return
        s = self.stories[key]
        head = self.articles[s.headline]
        self._emit(
            "updated", s.id, headline=head.title, headline_article_id=head.id, article_count=len(s.members), source_count=len(s.sources), langs=sorted(s.langs),
            centroid=np.round(s.centroid(), 6).tolist(),
        )

    # Time.

    def _advance(self, t: int) -> None:
        self.max_event = t if self.max_event is None else max(self.max_event, t)
        if self.c.lateness_ms is None:
            return
        mark = self.max_event - self.c.lateness_ms
        self.watermark = mark if self.watermark is None else max(self.watermark, mark)
        tick = self.watermark // self.c.tick_ms
        if self.tick is None or tick > self.tick:
            self.tick, self.now = tick, self.watermark
            self._housekeeping()

    def _housekeeping(self) -> None:
        limit, idle = self.watermark - self.c.idle_ms, set()
        while self.stories_by and self.stories_by[0][0] < limit:
            _, key = heapq.heappop(self.stories_by)
            if (s := self.stories.get(key)) is None:
                continue
            if s.last < limit:
                idle.add(key)
            else:
                heapq.heappush(self.stories_by, (s.last, key))
        for key in sorted(idle):
            s = self.stories.pop(key)
            self.centres.drop(key)
            self._emit("closed", s.id, reason="idle")
            self.copies.drop(s.members)
            for m in s.members:
                for w in self.articles.pop(m).words:
                    if self.word_df[w] > 1:
                        self.word_df[w] -= 1
                    else:
                        del self.word_df[w]
            self.vectors.dead += len(s.originals)
        oldest = self.watermark - self.c.dedup_ms
        aged = []
        while self.copies_by and self.copies_by[0][0] < oldest:
            aged.append(heapq.heappop(self.copies_by)[1])
        self.copies.drop(aged)
        limit = self.watermark - self.c.seen_ms
        while self.seen_by and self.seen_by[0][0] < limit:
            del self.seen[heapq.heappop(self.seen_by)[1]]
        self.vectors.sweep(self.articles.__contains__)

    # Splits and merges.

    def _lineage(self) -> None:
        self.checks += 1
        dirty, self.dirty = self.dirty, set()
        self._split_some(dirty)
        self._merge_some(dirty)

    def _ready(self, key: int, size: int) -> bool:
        s = self.stories.get(key)
        return s is not None and len(s.originals) >= size and s.rests_until <= self.checks

    def two_halves(self, story: Story) -> tuple[list[int], list[int], float] | None:
        """Spherical 2-means over the originals: both halves and how alike their directions are."""
        keys = story.originals
        if len(keys) < 2 * self.c.split_part:
            return None
        x = np.stack([self.articles[k].vector for k in keys])
        by_key = np.array(keys)

        def farthest(sims: np.ndarray) -> int:
            return int(np.lexsort((by_key, sims))[0])

        a = farthest(x @ story.centroid())
        from_a = x @ x[a]
        from_a[a] = np.inf
        b = farthest(from_a)
        centres, side = [x[a], x[b]], None
        for _ in range(self.c.iterations):
            new = x @ centres[1] > x @ centres[0]
            if side is not None and (new == side).all():
                break
            side = new
            if side.all() or not side.any():
                return None
            centres = [unit(x[~side].sum(axis=0)), unit(x[side].sum(axis=0))]
        halves = by_key[~side].tolist(), by_key[side].tolist()
        if min(map(len, halves)) < self.c.split_part:
            return None
        return *halves, float(centres[0] @ centres[1])

    def _split_some(self, dirty: set[int]) -> None:
        count: dict[int, int] = {}
        for key, n in self.splits.items():
            if key not in dirty and self._ready(key, self.c.split_size):
                count[key] = n + 1
        for key in sorted(dirty):
            if self._ready(key, self.c.split_size):
                plan = self.two_halves(self.stories[key])
                if plan and plan[2] < self.c.split_below:
                    count[key] = self.splits.get(key, 0) + 1
        sure = sorted(k for k, n in count.items() if n >= self.c.confirm)
        self.splits = {k: n for k, n in count.items() if n < self.c.confirm}
        for key in sure:
            plan = self.two_halves(self.stories[key])
            if plan:
                self._split(key, plan[0], plan[1])

    def _root(self, key: int) -> int:
        while (up := self.articles[key].original) is not None and up in self.articles:
            key = up
        return key

    def _build(self, id_: str, members: list[int], originals: list[int], parents: list[str], merged_from: list[str]) -> Story:
        arts = [self.articles[m] for m in members]
        s = Story(id_, min(a.time for a in arts), max(a.time for a in arts), list(members), list(originals), parents=parents, merged_from=merged_from, rests_until=self.checks + self.c.cooldown)
        s.sources, s.langs = {a.source for a in arts}, {a.lang for a in arts}
        x = np.stack([self.articles[k].vector for k in originals])
        s.total = x.sum(axis=0)
        s.fits, s.n_fits = float((x @ s.centroid()).sum()), len(originals)
        s.headline = self._medoid(s)
        return s

    def _put(self, key: int, s: Story) -> None:
        """A story that a split or a merge has built."""
        self.stories[key] = s
        heapq.heappush(self.stories_by, (s.last, key))
        if len(s.originals) >= self.c.merge_size:
            self.centres.put(key, s.centroid())

    def _split(self, key: int, left: list[int], right: list[int]) -> None:
        parent = self.stories.pop(key)
        self.centres.drop(key)
        in_right = set(right)
        parts: tuple[list[int], list[int]] = ([], [])
        for m in parent.members:
            parts[self._root(m) in in_right].append(m)
        children = []
        for members, originals in sorted(zip(parts, (left, right)), key=lambda p: min(p[0])):
            child = min(members)
            seed = self.articles[child].id
            id_ = "st_" + hashlib.sha256(f"{parent.id}:{seed}".encode()).hexdigest()[:16]
            story = self._build(id_, members, originals, [parent.id], [])
            for m in members:
                self.articles[m].story = child
            children.append((child, story))
        self._emit("split", parent.id, parent_story_id=parent.id, children=[{"story_id": s.id, "article_ids": [self.articles[m].id for m in s.members]} for _, s in children])
        for child, s in children:
            self._put(child, s)
            head = self.articles[s.headline]
            self._emit("created", s.id, seed_article_id=self.articles[child].id, headline=head.title, lang=head.lang, parent_story_ids=s.parents)
            self._updated(child)
        self._emit("closed", parent.id, reason="split")
        self.merges = {p: n for p, n in self.merges.items() if key not in p}

    def _anchored(self, wa: Counter, wb: Counter) -> bool:
        """Whether a title word that both stories share is mostly theirs."""
        return any(wa[w] + wb[w] >= self.c.anchor_share * self.word_df.get(w, 0) for w in wa.keys() & wb.keys())

    def _merge_some(self, dirty: set[int]) -> None:
        for k in dirty:
            if (s := self.stories.get(k)) is not None and len(s.originals) >= self.c.merge_size:
                self.centres.put(k, s.centroid())
        near = self.centres
        count: dict[tuple[int, int], int] = {}
        for (a, b), n in self.merges.items():
            if a not in dirty and b not in dirty and self._ready(a, self.c.merge_size) and self._ready(b, self.c.merge_size):
                count[a, b] = n + 1
        own = sorted(k for k in dirty if self._ready(k, self.c.merge_size))
        words: dict[int, Counter] = {}

        def of(k: int) -> Counter:
            if k not in words:
                words[k] = Counter(w for m in self.stories[k].members for w in self.articles[m].words)
            return words[k]

        if own:
            mine = np.stack([near.of(k) for k in own])
            sims = mine @ near.rows[: len(near.keys)].T
            who, row = np.nonzero(sims >= self.c.merge_anchored)
            for i, j, sim in zip(who.tolist(), row.tolist(), sims[who, row].tolist()):
                k, other = own[i], near.keys[j]
                pair = (min(k, other), max(k, other))
                if other in (k, -1) or pair in count or not self._ready(other, self.c.merge_size):
                    continue
                if sim >= self.c.merge_alone or self._anchored(of(pair[0]), of(pair[1])):
                    count[pair] = self.merges.get(pair, 0) + 1
        sure = sorted((p for p, n in count.items() if n >= self.c.confirm), key=lambda p: (-float(near.of(p[0]) @ near.of(p[1])), p))
        self.merges = {p: n for p, n in count.items() if n < self.c.confirm}
        used: set[int] = set()
        for a, b in sure:
            if not used & {a, b}:
                used |= {a, b}
                self._merge(a, b)

    def _merge(self, a: int, b: int) -> None:
        into, gone = (a, b) if len(self.stories[a].originals) >= len(self.stories[b].originals) else (b, a)
        target, source = self.stories.pop(into), self.stories.pop(gone)
        self.centres.drop(gone)
        for m in source.members:
            self.articles[m].story = into
        self._put(into, self._build(target.id, target.members + source.members, target.originals + source.originals, target.parents, [*target.merged_from, source.id]))
        self._emit("merged", target.id, source_story_ids=[source.id], target_story_id=target.id)
        self._emit("closed", source.id, reason="merged")
        self._updated(into)
        self.splits.pop(into, None)
        self.splits.pop(gone, None)
        self.merges = {p: n for p, n in self.merges.items() if gone not in p}
