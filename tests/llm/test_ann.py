import numpy as np

from scopelake.llm import ann, vectors


def table(seed=0, n=900, dim=16):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)) * r.uniform(0.2, 2, n)[:, None]
    x[100:400] = x[7]  # a third are copies
    return [(i, [float(np.float32(v)) for v in x[i]]) for i in range(n)]


def brute(data, k, every=20):
    out = {}
    for q, v in data:
        if q % every == 0:
            scored = sorted(((-float((np.array(v) * np.array(w)).sum()), i) for i, w in data if i != q))
            out[q] = scored[:k]
    return out


def test_recall_order_and_exact_scores(spark):
    data = table()
    bad = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0]), (None, data[0][1]), (1080, [None] * 16)]
    df = spark.createDataFrame([(*d, "x") for d in data + bad], "vec_id long, embedding array<float>, score string")
    want = brute(data, 20)
    for block, group in ((8192, 4096), (64, 10)):
        got = {}
        for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), block=block, query_group=group).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert set(got) == set(want)
        hit = 0
        for q, rows in got.items():
            rows.sort()
            assert [x[0] for x in rows] == list(range(1, 21))
            assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
            for _, i, s in rows:
                assert s == float((np.array(data[i][1]) * np.array(data[q][1])).sum())
            hit += len({x[1] for x in rows} & {i for _, i in want[q]})
        assert hit / (20 * len(want)) >= 0.93


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, 5.0])], "vec_id long, embedding array<float>")
    rows = [(r["rank"], r.vec_id, r.score) for r in ann.nearest(df, df.filter("vec_id % 20 = 0")).collect()]
    assert sorted(rows) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, -1.0)]
    assert ann.nearest(df.limit(0), df).count() == 0
    assert ann.nearest(df, df.limit(0)).count() == 0


def test_chi_square():
    x = (np.random.default_rng(0).standard_normal((200_000, 8)) ** 2).sum(1)
    assert abs((x < vectors.chi2_quantile(0.9, 8)).mean() - 0.9) < 0.005


def test_repeated_query_rows_ask_once(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [9.0, 0.0]), *((i, [float(i), 1.0]) for i in range(1, 30))], "vec_id long, embedding array<float>")
    rows = [(r["rank"], r.vec_id, r.score) for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), k=3).collect() if r.query_id == 0]
    assert sorted(rows) == [(1, 29, 29.0), (2, 28, 28.0), (3, 27, 27.0)]


def test_recall_on_a_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in df.collect()]
    x, ids = np.array([v for _, v in data]), np.array([i for i, _ in data])
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), block=256).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q, v in data:
        if q % 20 == 0:
            score = np.where(ids == q, -np.inf, x @ v)
            want = set(ids[np.lexsort((ids, -score))[:20]].tolist())
            hit, total = hit + len(want & got[q]), total + 20
    assert hit >= 0.9 * total
