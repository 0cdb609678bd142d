import numpy as np

from scopelake.llm import embed_dedup as E


def rows(seed=0, n=700, dim=32):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    x[50:200] = x[0] + 0.16 * r.standard_normal((150, dim))  # a group around the threshold
    x[200:240] = x[1]  # copies
    x[240:260] = 3 * x[1]
    label = r.integers(0, 3, n)
    label[:260] = 0
    return [(i, [float(v) for v in x[i]], int(label[i])) for i in range(n)]


def brute(data, cosine=0.93):
    ok = [i for i, (k, v, lab) in enumerate(data) if k is not None and lab is not None and v and len(v) == 32 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([data[i][1] for i in ok])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= cosine) & np.equal.outer([data[i][2] for i in ok], [data[i][2] for i in ok])
    np.fill_diagonal(near, False)
    comp = np.arange(len(ok))
    while True:
        new = np.array([min([comp[i], *comp[near[i]]]) for i in range(len(ok))])
        if (new == comp).all():
            break
        comp = new
    out = {k: (0, k) for k, _, _ in data}
    out |= {data[ok[i]][0]: (int(near[i].sum()), data[ok[comp[i]]][0]) for i in range(len(ok))}
    return out


def test_against_brute_force(spark):
    data = rows() + [(1000, None, 0), (1001, [0.0] * 32, 0), (1002, [float("nan")] + [1.0] * 31, 0), (1003, [None] + [1.0] * 31, 0), (1004, rows()[0][1], None), (1005, [1.0, 2.0], 0), (1006, [], 0), (1007, [float("inf")] * 32, 0)]
    df = spark.createDataFrame([(*d, 5) for d in data], "vec_id long, embedding array<float>, label int, n_links int")
    data32 = [(k, [None if c is None else float(np.float32(c)) for c in v] if v is not None else None, lab) for k, v, lab in data]
    want = brute(data32)
    for block in (2048, 40):
        got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df, block=block).collect()}
        assert got == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in E.near_duplicates(df).collect())


def test_repeated_rows_null_ids_and_empty(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, v, 1), (1, v, 1), (2, v, 2), (None, v, 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect())
    assert got == [("1", 1, 1, True), ("1", 1, 1, True), ("2", 0, 2, True), ("None", 0, None, False)]
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_threshold_is_calibrated():
    r = np.random.default_rng(3)
    x = r.standard_normal((4000, 64))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    z = r.standard_normal(u.shape)
    z -= (z * u).sum(1)[:, None] * u
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.931 * u + np.sqrt(1 - 0.931**2) * z
    p, q = u @ (d := E.gaussian(64, E.PROJECTIONS, seed=11)), y @ d
    hits = (np.abs(p - q) <= E.WIDTH * np.sqrt(0.14)).sum(1)
    assert (hits >= E.least_collisions()).mean() > 0.999


def test_one_id_with_two_labels_links_by_each(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    df = spark.createDataFrame([(5, a, 1), (5, a, 2), (6, b, 1), (7, b, 2)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(df).collect()) == [(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5)]


def test_tables_bring_pairs_at_the_threshold_together():
    r = np.random.default_rng(4)
    u = r.standard_normal((3000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    z = r.standard_normal(u.shape)
    z -= (z * u).sum(1)[:, None] * u
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.931 * u + np.sqrt(1 - 0.931**2) * z
    for largest in (100_000, 10_000_000):
        t = E.Tables.plan(64, largest, 8192, 0.93)
        a, b = t.groups(u), t.groups(y)
        assert (a == b).any(1).mean() > 0.999
        assert (a[:-1, 0] == a[1:, 0]).mean() < 3 * 8192 / largest + 0.002  # unrelated ones rarely meet
    assert E.Tables.plan(64, 8192, 8192, 0.93).width == 0


def test_planted_links_in_the_tables(spark):
    """Near copies planted in a driver table, with groups of the size a block allows and much smaller ones."""
    base = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    r, rows = np.random.default_rng(5), [(x.vec_id, list(x.embedding), x.label) for x in base]
    for i, x in enumerate(base[:100]):
        v = np.array(x.embedding)
        noise = r.standard_normal(len(v))
        rows.append((1_000_000 + i, [float(c) for c in v + noise / np.linalg.norm(noise) * np.linalg.norm(v) * 0.3], x.label))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = np.array([[np.float32(c) for c in v] for _, v, _ in rows]).astype(float)
    u, label = x / np.linalg.norm(x, axis=1)[:, None], np.array([k for *_, k in rows])
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    want = {rows[i][0]: int(near[i].sum()) - 1 for i in range(len(rows))}
    assert sum(want.values()) >= 200
    for block in (8192, 20):
        got = {x.vec_id: x.n_links for x in E.near_duplicates(df, block=block).collect()}
        assert got.keys() == want.keys() and sum(got[k] == want[k] for k in want) >= 0.99 * len(want) and sum(got.values()) >= 0.99 * sum(want.values())


def shared_direction(n, dim=64, seed=6, cosine=0.5):
    """Unit vectors that share a direction, so that two of them have this cosine on average, and near copies of the first 50."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    x[:, 0] = 0
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = np.sqrt(1 - cosine) * x
    x[:, 0] = np.sqrt(cosine)
    noise = r.standard_normal((50, dim))
    return np.concatenate([x, x[:50] + 0.25 * noise / np.linalg.norm(noise, axis=1)[:, None]])


def test_vectors_that_share_a_direction(spark):
    """Their likeness is found, groups stay small, rows dealt grow about as the input, and planted links are all there."""
    dealt = []
    for n in (2000, 10_000):
        x = shared_direction(n)
        reps = spark.createDataFrame([("a", [float(c) for c in v]) for v in x], "label string, v array<double>")
        alike = E.likeness(reps, 64, 100)
        assert abs(alike - 0.5) < 0.03 and E.likeness(reps, 64, 1 << 20) == 0
        tables = E.Tables.plan(64, len(x), 400, 0.93, likeness=alike)
        codes = tables.groups(x)
        sizes = np.concatenate([np.unique(c, return_counts=True)[1] for c in codes.T])
        plain = E.Tables.plan(64, len(x), 400, 0.93)
        worst = max(np.unique(c, return_counts=True)[1].max() for c in plain.groups(x).T)
        assert (sizes**2).sum() / sizes.sum() < 1200 and sizes.max() < worst
        dealt.append(sizes[sizes > 1].sum())
    assert dealt[1] / dealt[0] < 5**1.5
    x = shared_direction(2000)
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.93).sum(1) - 1
    got = {r.vec_id: r.n_links for r in E.near_duplicates(df, block=400).collect()}
    assert want.sum() >= 100 and sum(got[i] == want[i] for i in range(len(x))) >= 0.999 * len(x)
