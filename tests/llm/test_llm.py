"""Operators of the subpackage against brute force, on small inputs with every edge case."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.llm import bpe, encoding, knn, language, leakage, neardup, splitting, truncation

FILES = bpe.DEFAULT_FOLDER
needs_files = pytest.mark.skipif(not os.path.exists(f"{FILES}/{bpe.DEFAULT_NAME}.tiktoken"), reason="no tokenizer files")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    import sys

    sys.path.insert(0, os.path.dirname(os.path.realpath(FILES)))
    import public_tokenizers as P

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load().rank, special_tokens={})
    return lambda t: enc.encode_ordinary(t or "")


# Truncation.


def test_cut_values(spark):
    rng = random.Random(1)
    who, what, why = ["The mayor of Bexley", "The union of Rudow", "A court in Lille"], ["approves the plan for a new harbour wall", "questions the sale of old railway wagons"], ["because of rising costs", "after a vote that lasted until midnight"]
    rows = []
    for i in range(400):
        s = f"{rng.choice(who)} {rng.choice(what)} {rng.choice(why)}"
        rows.append((i, "src", s, f"{rng.choice(who)} {rng.choice(what)}. {s}.", "x"))
    whole = rows[0][2]
    cases = {
        1000: ("The mayor of Bexley approves the plan for a", None), 1001: (whole, "The union of Rudow questions the sale of old railw"), 1002: (whole + "…", ""),
        1005: (whole, f'See <a href="https://bexley.example/{"wall/" * 60}" target'), 1006: (whole, f'See <a href="https://bexley.example/{"wall/" * 60}">the plan</a> for the wall. {whole}.'),
        1003: (whole, "A court in Lille approves the plan for a new harbour wall because of [...]"), 1004: (whole, "A court in Lille questions the sale of old railway wagons after a vote &#82"),
    }
    rows += [(k, "src", a, b, "x") for k, (a, b) in cases.items()] + [(2000, None, None, None, None), (2001, "src", "", " ", None), (2002, "src", whole + " (updated)", whole + ". (Bexley, Rudow)", "x")]
    rows += [rows[400]]  # repeated row
    df = spark.createDataFrame(rows, "raw_offset long, source_id string, title string, summary string, cut string")
    got = Counter(tuple(r) for r in truncation.truncated(df).collect())
    assert got == Counter({(1000, "title"): 2, (1001, "summary"): 1, (1002, "title"): 1, (1003, "summary"): 1, (1004, "summary"): 1, (1005, "summary"): 1})
    assert truncation.truncated(df.limit(0)).count() == 0


# Language.

SENTENCES = {
    "en": ["The council of the town approves the plan for the new bridge", "After weeks of silence the farmers will review the rules of the market", "Nobody was hurt but the road stays closed until the morning"],
    "es": ["El ayuntamiento de la ciudad aprueba el plan para el puente nuevo", "Tras semanas de silencio los agricultores revisarán las normas del mercado", "No hubo heridos pero la carretera sigue cortada hasta la mañana"],
    "ru": ["Городской совет одобряет план строительства нового моста", "После недель молчания фермеры пересмотрят правила рынка", "Никто не пострадал но дорога закрыта до утра"],
}


def test_code_lengths_are_those_of_the_trees():
    m = language.train([(k, s) for k, v in SENTENCES.items() for s in v])
    word = "bridges"
    bits = language.code_lengths(m, [word])[0]
    for li in range(len(m.langs)):
        data, total = language.framed(word), 0.0
        for i in range(1, len(data)):
            for k in range(min(i, language.ORDER), -1, -1):
                ctx = int.from_bytes(data[i - k : i], "big")
                e = np.searchsorted(m.escape_keys[k], ctx)
                if e == len(m.escape_keys[k]) or m.escape_keys[k][e] != ctx or np.isnan(m.escape_bits[k][e, li]):
                    continue
                s = np.searchsorted(m.symbol_keys[k], ctx << 8 | data[i])
                if s < len(m.symbol_keys[k]) and m.symbol_keys[k][s] == ctx << 8 | data[i] and not np.isnan(m.symbol_bits[k][s, li]):
                    total += m.symbol_bits[k][s, li]
                    break
                total += m.escape_bits[k][e, li]
            else:
                total += 8.0
        assert abs(total - bits[li]) < 1e-9


def test_mislabelled(spark):
    samples = spark.createDataFrame([(k, s) for k, v in SENTENCES.items() for s in v] + [(None, "x"), ("en", None)], "lang string, text string")
    en, es, ru = SENTENCES["en"], SENTENCES["es"], SENTENCES["ru"]
    rows = [
        (1, "EN-gb", en[0], en[1] + "."), (2, "es", en[0], None), (3, None, es[0], es[2] + "."), (4, "eng", en[0], f"{en[1]}. {es[1]}. {en[2]}."), (5, "ru", ru[0], ""),
        (6, "en", None, None), (7, "en", "Bexley", "(Rudow, Lille)"), (8, "und", ru[1], ru[2]), (8, "und", ru[1], ru[2]), (9, "xx", en[2] * 400, None),
    ]
    df = spark.createDataFrame(rows, "raw_offset long, lang string, title string, summary string").withColumn("segments", F.lit(1))
    got = Counter(tuple(r) for r in language.mislabelled(df, samples).collect())
    assert got == Counter({(2, "en"): 1, (3, "es"): 1, (4, "en"): 1, (4, "es"): 1, (8, "ru"): 2, (9, "en"): 1})
    assert language.mislabelled(df.limit(0), samples).count() == 0
    conf = [r.confidence for r in language.identify(df, samples).select(F.inline("segments")).collect()]
    assert conf and all(0 < c <= 1 for c in conf)


def test_held_out_accuracy(spark, tiny):
    s = [(r.lang, r.text) for r in spark.read.parquet(f"{tiny}/lang_samples.parquet").collect()]
    train, test = [x for i, x in enumerate(s) if i % 4], [x for i, x in enumerate(s) if i % 4 == 0]
    got = language.score(language.train(train), [(t, None) for _, t in test])
    assert np.mean([g[0] == lang for g, (lang, _) in zip(got, test)]) > 0.9


# Neighbours.


def exact(vecs, k=5, least=knn.LEAST):
    keys = sorted(vecs)
    x = np.array([vecs[i] for i in keys], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, knn.DIGITS)
    out = set()
    for i, a in enumerate(keys):
        near = sorted((j for j in range(len(keys)) if j != i and s[i, j] >= least), key=lambda j: (-s[i, j], keys[j]))[:k]
        out |= {(min(a, keys[j]), max(a, keys[j])) for j in near}
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    vecs = {i: base[i % 60] + 0.15 * rng.standard_normal(16) for i in range(900)}
    vecs |= {2000 + i: vecs[7] for i in range(30)}  # copies
    rows = [(i, [float(np.float32(y)) for y in v], "m") for i, v in vecs.items()]
    bad = [(5001, None, "m"), (5002, [], "m"), (5003, [0.0] * 16, "m"), (5004, [1.0] * 15, "m"), (5005, [float("nan")] + [1.0] * 15, "m"), (5006, [None] + [1.0] * 15, "m"), (5007, [float("inf")] * 16, "m"), (None, [1.0] * 16, "m")]
    other = [(6000, rows[0][1], "other"), (6001, rows[0][1], None)]
    df = spark.createDataFrame(rows + bad + other + rows[:1], "o long, v array<float>, g string").withColumn("vec", F.lit(1))
    want = exact({i: v for i, v, _ in rows})
    for block, least_recall in ((10_000, 1.0), (128, 0.9)):
        got = {tuple(r) for r in knn.pairs(knn.Graph(df, "o", "v", "g", 16, block=block).neighbours()).collect()}
        assert len(got & want) >= least_recall * len(want) and len(got - want) <= 0.1 * len(want)
    g = knn.Graph(df, "o", "v", "g", 16)
    found = {(r.key, r.neighbour) for r in g.search(df.where("o % 100 = 0"), "o", "v", "g").collect()}
    assert (100, 100) in found and (6000, 6000) in found and (6000, 0) not in found
    empty = knn.Graph(df.limit(0), "o", "v", "g", 16)
    assert empty.neighbours().count() == 0


def test_neighbours_within_an_oversized_block(spark):
    rng = np.random.default_rng(5)
    centre = 4 * rng.standard_normal(8)
    hot = centre + 0.4 * rng.standard_normal((1000, 8))
    x = np.concatenate([hot, rng.standard_normal((2000, 8))]).astype(np.float32)
    vecs = dict(enumerate(x))
    df = spark.createDataFrame([(i, [float(y) for y in v], None) for i, v in vecs.items()], "o long, v array<float>, g string")
    g = knn.Graph(df, "o", "v", "g", 8, block=64)
    want = exact({i: v for i, v in vecs.items() if i < 1000})
    got = {tuple(r) for r in knn.pairs(g.neighbours()).collect()}
    assert len(got & want) > 0.9 * len(want)
    found = {r.key for r in g.search(df.where("o < 1000"), "o", "v", "g").where("key = neighbour").collect()}
    assert len(found) == 1000


def test_recall_of_small_blocks_and_of_the_search(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((250, 24))
    x = (centres[rng.integers(0, 250, 4000)] + 0.25 * rng.standard_normal((4000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(y) for y in v], "m") for i, v in enumerate(x)], "o long, v array<float>, g string")
    g = knn.Graph(df, "o", "v", "g", 24, block=64)
    assert g.bits >= 5 and g.progress[-1][0] > g.progress[0][0]  # the descent adds to what the blocks give
    want = exact(dict(enumerate(x)))
    got = {tuple(r) for r in knn.pairs(g.neighbours()).collect()}
    assert len(got & want) >= 0.95 * len(want)
    asked = df.where("o % 100 = 0")
    y = x / np.linalg.norm(x, axis=1)[:, None]
    truth = set()
    for i in range(0, 4000, 100):
        s = np.round((y @ y[i]).astype(float), knn.DIGITS)
        truth |= {(i, j) for j in sorted((j for j in range(4000) if s[j] >= knn.LEAST), key=lambda j: (-s[j], j))[:5]}
    found = {(r.key, r.neighbour) for r in g.search(asked, "o", "v", "g").collect()}
    assert len(found & truth) >= 0.9 * len(truth)
    with pytest.raises(ValueError):
        g.neighbours(50)


def test_best_of_a_dense_block():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x = (rng.standard_normal(16) * 4 + 0.3 * rng.standard_normal((600, 16))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[300:310] = x[300]
    yes = pa.array([True] * 600)
    t = pa.table({"nid": np.arange(600)[::-1].copy(), "vec": pa.array([r.tobytes() for r in x], pa.binary()), "asks": yes, "answers": yes})
    got = knn._within_block(16, knn.LEAST, 5)(t)
    s = np.round((x @ x.T).astype(np.float64), knn.DIGITS)
    want = {(599 - i, 599 - j) for i in range(600) for j in sorted((j for j in range(600) if j != i), key=lambda j: (-s[i, j], -j))[:5]}
    assert len(set(zip(got["u"].to_pylist(), got["v"].to_pylist())) & want) >= 0.999 * len(want) and len(got) == 3000


# Near-duplicates.


def norm_py(t):
    import regex

    return regex.sub(r"[^\p{L}\p{N}]+", " ", t.lower()).strip()


@pytest.mark.parametrize("bounds,hot", [(None, {}), ((0, 1 << 40), {}), ((10**6, 10**7), {}), ((0, 1), {}), ((60, 120), {}), ((60, 120), {"hot_times": 2, "cell": 2})])
def test_near_duplicates(spark, bounds, hot):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)]
    texts = []
    for _ in range(60):
        w = rng.choices(words, k=rng.randint(1, 60))
        texts.append(" ".join(w))
        for _ in range(2):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(words)
            texts.append(" ".join(v).upper() + "!")
    texts += ["", "abc", "x" * 30_000, "x" * 30_001, texts[0]]
    rows = [(f"{i:03d}", t, None) for i, t in enumerate(texts)] + [(None, texts[0], None), ("990", None, "s"), ("991", None, None)]
    df = spark.createDataFrame(rows, "id string, title string, summary string").withColumn("text", F.lit("clash"))
    normal = neardup.normalized(df.drop("text"))
    members = normal.select(F.col("id").alias("key"), "digest")
    links, who = neardup.near_duplicates(normal, members, bounds=bounds, **hot)
    got = {(r.id_a, r.id_b) for r in neardup.pairs(links, who).collect()}
    sets = {i: {n[k : k + 5] for k in range(len(n) - 4)} for i, t, _ in rows if i and t and len(n := norm_py(t)) >= 5}
    want = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert got == want and len(want) > 20
    group = {r.key: r.group for r in neardup.groups(links, who).collect()}
    assert all(group[a] == group[b] for a, b in want) and len(group) == len(sets)
    assert neardup.pairs(*neardup.near_duplicates(normal.limit(0), members.limit(0))).count() == 0


def _group(who, key=5):
    k = np.zeros(len(who), neardup._KEY)
    k["key"], k["who"], k["size"] = key, who, 100
    return k


def _met(k):
    return {(x, y) for a, b in neardup.meeting(k, neardup.THRESHOLD) for x, y in zip(a.tolist(), b.tolist())}


def test_members_of_a_key_meet_in_any_order():
    who = np.random.default_rng(8).permutation(1000)
    want = {(min(x, y), max(x, y)) for g in (who[:300].tolist(), who[300:].tolist()) for x in g for y in g if x != y}
    assert _met(_group(who, np.repeat([3, 5], [300, 700]))) == want


def test_hot_keys_are_cut_into_cells():
    k = neardup.cells(np.concatenate([_group(np.arange(1000)), _group(np.arange(3), 7)]), {5: 10})
    sizes = np.unique(k["key"], return_counts=True)[1]
    assert len(sizes) == 56 and sizes.max() < 300  # 55 pairs of ten parts, and the key that is not hot
    assert _met(k) == {(x, y) for x in range(1000) for y in range(x + 1, 1000)}


def test_boundaries_by_cost():
    # Few large sets: lists cost less than hashing all their elements eight times. Few small ones: all subsets of two do.
    sizes = [(n, 1) for n in range(10, 40)] + [(n, 100_000) for n in range(200, 300)] + [(n, 1) for n in range(2_000, 2_030)]
    lo, hi = neardup.boundaries(sizes, 0.3)
    assert 30 < lo < 200 and 300 < hi <= 2_000
    assert neardup.boundaries([], 0.3) == (0, 1 << 40) and neardup.boundaries([(250, 10**6)], 0.3) == (0, 1 << 40)


# Tokens.


@needs_files
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab sTtreVmld'\n\t 　é日本ー1٢²Ⅳ.,!<|>_́​😀\x1c\x85", max_size=24), max_size=5))
def test_ids_equal_the_public_tokenizer(reference, texts):
    e = bpe.load().encode(texts)
    assert [e.ids[e.bounds[i] : e.bounds[i + 1]].tolist() for i in range(len(texts))] == [reference(t) for t in texts]


@needs_files
def test_ids_of_documents(spark, reference):
    texts = [None, "", " ", "Hello world", "<|endoftext|>", "a" * 3000, "日本語" * 2000, "x y  z\n\n\n" * 50, "Hello world"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "Hello world", 2)], "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in encoding.token_ids(df).collect()]
    assert sorted(got, key=str) == sorted([(i, reference(t)) for i, t in enumerate(texts)] + [(None, reference("Hello world"))], key=str)
    assert encoding.token_ids(df.limit(0)).count() == 0


@needs_files
def test_perfect_hash_is_minimal():
    m = bpe.load().mph
    assert sorted(m.slot_key.tolist()) == list(range(m.n)) and (m.find(bpe.load().words[:5000]) == np.arange(5000)).all()


@needs_files
@pytest.mark.parametrize("limit,overlap", [(512, 64), (16, 4), (8, 0)])
def test_pieces(spark, reference, limit, overlap):
    rng = random.Random(limit)
    parts = ["word", " word", ". ", "! ", "\n\n", "\n", "日本語。", "。", "'s", "  ", "😀", "é" * 9, "</p>", "Zq" * 12, " 12345678901234567890 ", "\r\n\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.choice([3, 40, 900]))) for _ in range(25)] + [None, "", "a" * 9000, "😀" * 1500, " " * 3000, "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("piece", F.lit("clash"))
    rows = sorted(splitting.pieces(df, limit=limit, overlap=overlap).collect(), key=lambda r: (r.doc_id, r.piece))
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i for i, t in enumerate(texts) if len(reference(t)) > limit}
    for i, ps in by.items():
        text = texts[i]
        assert [p.piece for p in ps] == list(range(len(ps))) and all(p.n_pieces == len(ps) for p in ps)
        assert "".join(text[(ps[k - 1].stop if k else 0) : p.stop] for k, p in enumerate(ps)) == text
        for k, p in enumerate(ps):
            assert p.piece_text == text[p.start : p.stop] and p.n_tokens <= limit and len(reference(p.piece_text)) <= limit
            if k:
                q = ps[k - 1]
                assert q.start <= p.start <= q.stop and p.overlap_tokens <= overlap and (overlap or p.start == q.stop)
    assert splitting.pieces(df.limit(0)).count() == 0


@needs_files
def test_an_early_paragraph_does_not_make_a_short_piece(spark):
    text = "One line.\n\n" + "A sentence of some words stands here. " * 60
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = splitting.pieces(df, limit=100, overlap=0).orderBy("piece").collect()
    assert got[0].boundary == "sentence" and got[0].n_tokens > 50
    assert splitting.pieces(df, limit=100, overlap=0, fill=0.0).orderBy("piece").first().n_tokens < 10


# Leaks.


def test_leaks(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 60)))) for i in range(20)] + [(98, None), (99, ""), (5, None)]
    docs = []
    for i in range(60):
        w = rng.choices(vocab, k=rng.randint(0, 50))
        for _ in range(rng.randint(0, 2)):
            x = rng.choice(items[:20])[1].split()
            a = rng.randrange(len(x))
            w[len(w) // 2 : len(w) // 2] = x[a : a + rng.randint(8, 30)]
        docs.append((i, " ".join(w).upper().replace(" ", " - ") if i % 2 else " ".join(w)))
    docs += [(100, None), (101, ""), (102, "ｗ1 " * 3 + "w­2"), (103, items[0][1] + " zzz " + items[1][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(-1))
    t = spark.createDataFrame(items, "item_id long, text string")
    words = {k: leakage.words(x) for k, x in items}
    want = {}
    for k, x in docs:
        dw = leakage.words(x)
        for j, iw in words.items():
            best = max((n for a in range(len(iw)) for b in range(len(dw)) for n in [next((n for n in range(min(len(iw) - a, len(dw) - b) + 1) if n == min(len(iw) - a, len(dw) - b) or iw[a + n] != dw[b + n]), 0)]), default=0)
            if best >= 12:
                want[k, j] = best
    for block in (leakage.BLOCK_BYTES, 500):
        rows = leakage.leaks(d, t, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id): r.longest for r in rows} == want and len(want) > 10
        covered = {r.doc_id: (r.covered, r.words) for r in rows}
        if block == leakage.BLOCK_BYTES:
            whole = covered
        assert covered == whole  # however many automata there are
    assert leakage.leaks(d.limit(0), t).count() == 0 == leakage.leaks(d, t.limit(0)).count()
    found = leakage.leaks(d, t)
    left = {r.doc_id for r in leakage.without_leaks(d, found, longest=11).collect()}
    assert left == {k for k, _ in docs} - {k for k, _ in want}


def test_leaked_spans_are_removed(spark):
    rng = random.Random(6)
    w = lambda p, n: [f"{p}{i}" for i in rng.sample(range(10_000), n)]
    long, short, other = w("l", 60), w("s", 15), w("o", 15)
    free = w("f", 400)
    join = lambda *parts: " ".join(x for p in parts for x in p)
    docs = {
        1: (join(free[:200], long, free[200:], short), join(free[:200], [""], free[200:], short), 60),  # the long run goes, the short one stays
        2: (join(free[:20], short, free[20:40]), join(free[:20], [""], free[20:40]), 15),  # 15 of 55 words
        3: (join(free[:200], short), join(free[:200], short), 0),
        4: ("Été, " + ", ".join(x.upper() for x in short[:14]) + ", " + short[14] + "\u0301 — fin", "Été,  — fin", 15),
        5: (join(short, other), "", 30), 6: (None, None, 0), 7: ("", "", 0),
    }
    d = spark.createDataFrame([(k, t) for k, (t, _, _) in docs.items()], "doc_id long, text string")
    t = spark.createDataFrame([(1, join(long)), (2, join(short)), (3, join(other)), (4, None)], "item_id long, text string")
    for block in (leakage.BLOCK_BYTES, 200):
        got = {r.doc_id: (r.text, r.removed) for r in leakage.without_spans(d, t, block_bytes=block).collect()}
        assert {k: (v and " ".join(v.split()), n) for k, (v, n) in got.items()} == {k: (v and " ".join(v.split()), n) for k, (_, v, n) in docs.items()}
    for x in ("Ｔｈｅ ﬁrst café, co­op​erate—IT’S 4²!", "cafe\u0301 ΟΔΟΣ İx", "plain Text"):
        assert [p[0] for p in leakage.placed_words(x)] == leakage.words(x)


def test_words_of_altered_passages():
    assert leakage.words("Ｔｈｅ ﬁrst café, co­op​erate—IT’S 4²!") == ["the", "first", "cafe", "cooperate", "it", "s", "42"]
    assert leakage.words("café") == leakage.words("CAFÉ")
