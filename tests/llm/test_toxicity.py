import random
import zlib

import numpy as np

from scopelake.llm import toxicity as T


def corpus(spark, n=600):
    r = random.Random(1)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = [r.choice(words) for _ in range(r.randint(20, 80))]
        if bad:
            for _ in range(4):
                text.insert(r.randrange(len(text)), r.choice(["zorgal", "zorgak", "idiot", "you moron"]))
        docs.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (None, "you idiot", "en", "s", 1), (0, docs[0][1], "en", "s", 1), (n + 2, "word " * 30000, "en", "s", 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score long"),
        spark.createDataFrame([*labels, (1, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int"),
        {i: t for i, _, t in labels},
    )


def test_held_out_accuracy_and_edges(spark):
    docs, labels, truth = corpus(spark)
    rows = T.toxic_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, t, _ in held if t], [s for s, t, _ in held if not t]
    assert np.mean([a > b for a in pos for b in neg]) > 0.98
    assert np.mean([p == t for _, t, p in held]) > 0.95
    kept = T.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 0.7 < kept.count() / docs.count() < 0.85


def test_held_out_labels_are_never_read(spark):
    docs, labels, truth = corpus(spark, 300)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end toxic")
    a, b = (sorted((str(r.doc_id), r.score) for r in T.toxic_documents(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_without_labels_or_rows(spark):
    docs, labels, _ = corpus(spark, 40)
    assert {r.score for r in T.toxic_documents(docs, labels.limit(0)).collect()} == {0.0}
    assert T.toxic_documents(docs.limit(0), labels).count() == 0


def test_isotonic_pools_to_the_least_squares_fit():
    r = np.random.default_rng(0)
    p = np.round(r.random(200), 2)
    y = (r.random(200) < p).astype(float)
    w = r.random(200) + 0.5
    xs, ys = T.isotonic(p, y, w)
    fit = np.interp(p, xs, ys)
    assert (np.diff(ys) >= 0).all() and abs((w * (fit - y)).sum()) < 1e-9
    values = np.unique(p)
    m = np.array([np.average(y[p == v], weights=w[p == v]) for v in values])
    v = np.array([w[p == v].sum() for v in values])
    brute = [max(min(np.average(m[i : j + 1], weights=v[i : j + 1]) for j in range(k, len(m))) for i in range(k + 1)) for k in range(len(m))]
    assert np.allclose(np.interp(values, xs, ys), brute)
