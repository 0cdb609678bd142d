"""Importance resampling against a plain computation of weights, noise and order."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from scopelake.llm import resample
from scopelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(docs, target, percent=10, least=20, seed=2024, buckets=10_000, longest=1):
    """Rows (doc_id, n_features, weight, score, rank) of docs [(doc_id, text)]."""

    def found(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in found(x)[1]) for texts in ([x for _, x in docs], target))
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for at, (d, text) in enumerate(docs):
        n, fs = found(text)
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((n, at, d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[5], (1, 0) if r[2] is None else (0, r[2]), r[1]))
    rank = {r[1]: k + 1 for k, r in enumerate(eligible[: len(eligible) * percent // 100])}
    return sorted(((r[2], r[3], r[4], r[5], rank.get(r[1])) for r in rows), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op12_resampling"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and rows_of(got) == plain(docs, target)


def test_ties_ranges_and_edges(spark, monkeypatch):
    """Equal texts and ids, null ids and texts, small ranges and bins: the same ranks."""
    monkeypatch.setattr(resample, "RANGE_ROWS", 40)
    monkeypatch.setattr(resample, "BINS", 3)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 3, 25, 40]))) for _ in range(40)]
    docs = [(rng.choice([None, *range(60)]), rng.choice([None, *texts])) for _ in range(600)]
    target = texts[:3]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, row int, score string").repartition(7)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for percent, longest in ((50, 1), (100, 2), (1, 1), (0, 1)):
        got = rows_of(resample.draw(df, wanted, percent=percent, longest=longest))
        want = plain(docs, target, percent=percent, longest=longest)
        # Rows of one id and score share a set of ranks.
        assert [r[:4] for r in got] == [r[:4] for r in want]
        assert sorted((r[3], str(r[0]), r[4]) for r in got if r[4]) == sorted((r[3], str(r[0]), r[4]) for r in want if r[4])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([("a b",)], "text string")
    assert resample.draw(docs, target).collect() == []
    one = spark.createDataFrame([(1, "a " * 30), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r["rank"] for r in resample.draw(one, target.limit(0), percent=100).collect()} == {1: 1, 2: None}


def test_tournament():
    rng = random.Random(2)
    for _ in range(300):
        runs = [sorted((rng.randrange(8),) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 9))]
        most = rng.randrange(40)
        got = [(runs[r][i], r) for r, a, b in resample.merged(runs, most) for i in range(a, b)]
        assert got == sorted((k, r) for r, run in enumerate(runs) for k in run)[:most]


def test_resampled(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 50}" for k in range(30)), "s") for i in range(50)], "doc_id long, text string, source string")
    target = spark.createDataFrame([("w1 w2 w3",)], "text string")
    got = resample.resampled(docs, target, percent=20)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 11)) and set(docs.columns) < set(got.columns)
