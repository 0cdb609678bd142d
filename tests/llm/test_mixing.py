import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from scopelake.llm import mixing as M


def brute(n, p, want, steps=4000):
    """Plain projected gradient from r = 1 in the metric of n."""
    r = np.ones(len(n))
    a = n[:, None] * p
    g = np.linalg.inv((a.T @ p) + 1e-9 * np.trace(a.T @ p) * np.eye(p.shape[1]))
    for _ in range(steps):
        r = np.maximum(0, r - p @ (g @ (a.T @ r - want)))
    return r


def test_rates_meet_targets(spark):
    r = np.random.default_rng(0)
    p = r.dirichlet([0.3, 0.3, 0.3], 400)
    n = r.integers(0, 500, 400).astype(float)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    domains = ("a", "b", "c")
    for targets in ({"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 1.0, "b": 1.0, "c": 8.0}):
        fit = M.fit_rates(members, targets, domains)
        want = np.array(list(targets.values())) / sum(targets.values()) * n.sum()
        assert np.abs(fit.totals - want).max() < 1e-3 * n.sum()
        got = np.array([x[0] for x in members.select(fit.rate()).collect()])
        assert (got >= 0).all() and np.abs(got - brute(n, p, want)).max() < 0.02
    least = M.fit_rates(members, {"a": 1.0}, domains, steps=60)  # out of reach: other domains cannot vanish
    got = np.array([x[0] for x in members.select(least.rate()).collect()])
    assert (got >= 0).all() and least.totals[0] > 0.85 * n.sum()


def corpus(spark, n=400):
    r = random.Random(2)
    good, bad = [[f"{c}{r.randrange(200)}" for _ in range(150)] for c in ("good", "bad")]
    docs = [(i, " ".join(r.choice(bad if i % 4 == 0 else good) for _ in range(r.randint(30, 60))), "x") for i in range(n)]
    docs += [(n, None, "x"), (n + 1, "", "x"), (None, docs[1][1], "x"), (1, docs[1][1], "x"), (n + 2, "good1 " * 20000, "x")]
    labels = [(i, int(i % 4 > 0), 0) for i in range(0, n, 3)] + [(1, None, None), (5, 1, 0), (5, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, rate string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_documents(spark):
    docs, labels = corpus(spark)
    rows = M.rates(docs, M.quality_domains(labels), M.TARGETS).collect()
    assert len(rows) == docs.count()
    unseen = [x for x in rows if x.doc_id is not None and x.doc_id < 400 and x.doc_id % 3]
    assert sum((x.p_low > 0.5) == (x.doc_id % 4 == 0) for x in unseen) / len(unseen) > 0.97
    total = sum(x.n_tokens for x in rows)
    assert abs(sum(x.rate * x.n_tokens * x.p_low for x in rows) - 0.03 * total) < 0.01 * total
    assert all(x.rate >= 0 and abs(x.p_high + x.p_low - 1) < 1e-9 for x in rows)
    mixed = M.mixed(docs, M.quality_domains(labels), M.TARGETS)
    assert mixed.columns == docs.columns
    drawn = mixed.collect()
    kept = {x.doc_id for x in drawn}
    assert all(i in kept for i in range(400) if i % 4)  # rates of the wanted domain are above 1
    assert sum(x.doc_id is not None and x.doc_id % 4 == 0 for x in drawn) < 60
    assert sorted(map(str, drawn)) == sorted(map(str, M.mixed(docs.repartition(5), M.quality_domains(labels), M.TARGETS).collect()))


def test_without_labels_or_rows(spark):
    docs, labels = corpus(spark, 40)
    rows = M.rates(docs, M.quality_domains(labels.limit(0)), M.TARGETS).collect()
    assert all(abs(x.p_high - 0.5) < 1e-9 for x in rows)
    assert M.rates(docs.limit(0), M.quality_domains(labels), M.TARGETS).count() == 0


def test_words(spark):
    texts = ["foo,bar", "word word, word.", "a\x1cb\u2003c\x85d ...x!?", "\u5317\u4eac,\u4e0a\u6d77" * 20, "f(a);g[b]=c" * 50, "\u0130x I\u0307", "", " "]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = [len(re.findall(r"\w+|[^\w\s]+", t.lower())) for t in texts]
    got = {x.doc_id: x.n_tokens for x in M.feature_rows(docs, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == want and want[:2] == [3, 5]
    word, marked = (M.features(pa.array([t]), M.Hashed()).idx.tolist() for t in ("word", "word,"))
    assert set(word) < set(marked)
    assert M.SAMPLE_ROWS == 8000


def test_features_against_a_plain_count():
    texts = ["The cat, the CAT!", "", "b_2 \u00b2 \u00c4rger\u2014x", "\u5317 \u5317 a", "x"]
    hashed = M.Hashed()
    got = M.features(pa.array(texts), hashed)
    for i, t in enumerate(texts):
        n = Counter(re.findall(r"\w+|[^\w\s]+", t.lower()))
        want = np.zeros(M.BUCKETS + 2)
        if n:
            weight = {w: math.log1p(c) for w, c in n.items()}
            length = math.sqrt(2 * sum(x * x for x in weight.values()))
            for w, x in weight.items():
                want[hashed[w] >> M.BITS] += x / length
                want[hashed[w] & (M.BUCKETS - 1)] += x / length
            want[-2:] += max(n.values()) / n.total(), len(n) / n.total()
        mine = got.row == i
        assert np.allclose(np.bincount(got.idx[mine], got.val[mine], M.BUCKETS + 2), want, atol=1e-6)
        assert got.tokens[i] == n.total()


def test_whether_rates_settled(spark):
    members = spark.createDataFrame([(10, [0.9, 0.1]), (10, [0.1, 0.9])], "n_tokens long, p array<double>")
    assert M.fit_rates(members, {"a": 0.5, "b": 0.5}, ("a", "b")).settled
    assert not M.fit_rates(members, {"a": 1.0, "b": 0.0}, ("a", "b"), steps=1).settled
