"""Near-duplicate documents of a small corpus against brute force."""

import random

import numpy as np

from newsloom.functions import minhash as mh
from newsloom.plans import similarity


def test_near_duplicate_documents(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)]
    texts = []
    for _ in range(40):
        w = rng.choices(words, k=rng.randint(20, 200))
        for changes in (0, 1, rng.randint(2, 60)):
            v = list(w)
            for _ in range(changes):
                v[rng.randrange(len(v))] = rng.choice(words)
            texts.append(" ".join(v))
    texts += [texts[0], texts[0].upper() + "!", texts[4], None, "", "?!", "ab", " ".join(rng.choices(words, k=5000))]
    rng.shuffle(texts)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d, sig = str(tmp_path), {i: mh.sketch(t) for i, t in enumerate(texts) if t and mh.normalize(t)}
    counts = {r.doc_id: r.n for r in similarity.document_shingle_counts(spark, d).collect()}
    norm = [mh.normalize(t or "") for t in texts]
    assert counts == {i: len({n[k : k + 5] for k in range(max(1, len(n) - 4))}) if n else 0 for i, n in enumerate(norm)}
    assert {r.doc_id: r.sig for r in similarity.document_signatures(spark, d).collect()} == {i: s.tobytes().hex() for i, s in sig.items()}
    rows = mh.PERMUTATIONS // mh.BANDS
    share = lambda x, y: (x == y).reshape(mh.BANDS, rows).all(axis=1).any()
    want = {(a, b): float(np.mean(sig[a] == sig[b])) for a in sig for b in sig if a < b and share(sig[a], sig[b])}
    assert {(r.a, r.b): r.estimate for r in similarity.document_candidates(spark, d).collect()} == want
    best = {}
    for (a, b), e in sorted(want.items()):
        if e >= 0.8 and e > best.get(b, (0, 0))[1]:
            best[b] = a, e
    assert {r.doc_id: (r.original, r.estimate) for r in similarity.document_near_duplicates(spark, d).collect()} == best and len(best) > 40
    grams = {i: {norm[i][k : k + 5] for k in range(max(1, len(norm[i]) - 4))} for i in sig}
    alike = {(a, b) for a in sig for b in sig if a < b and len(grams[a] & grams[b]) >= 0.9 * len(grams[a] | grams[b])}
    assert len(alike & set(want)) >= 0.95 * len(alike)
