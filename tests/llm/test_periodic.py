"""Periodic runs against a plain search of every period, and the registered query on a small table."""

import hashlib
import random
import re
import zlib

import numpy as np

from scopelake.llm import periodic
from scopelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(words, least=12):
    """(start, length, period) of all runs: for each period the longest stretches, of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def rest(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def test_runs(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 50)
    rng = random.Random(1)
    for _ in range(300):
        kinds, texts = rng.choice([1, 2, 3, 5]), []
        for _ in range(rng.randint(1, 5)):
            n = rng.choice([0, 1, 5, 12, 30, 60])
            w = [rng.randrange(kinds) for _ in range(n)]
            if n > 6 and rng.random() < 0.5:
                p, a = rng.randint(1, n // 3), rng.randrange(n)
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            texts.append(w)
        least = rng.choice([12, 4, 2])
        got = periodic.find_runs(np.array([x for w in texts for x in w], dtype=np.int64), np.array([len(w) for w in texts]), least)
        assert [tuple(r) for r in got.tolist()] == [(d, *r) for d, w in enumerate(texts) for r in plain(w, least)]


def test_names():
    """Names agree exactly where the stretches do."""
    rng = random.Random(3)
    w = [rng.randrange(2) for _ in range(200)]
    for k, names in enumerate(periodic.name_levels(np.array(w))):
        wide = 1 << k
        at = [i for i in range(len(w) - wide + 1)]
        for i, j in (rng.sample(at, 2) for _ in range(300)):
            assert (names[i] == names[j]) == (w[i : i + wide] == w[j : j + wide])


def test_collapse_edges(spark):
    rows = [(1, None, "r"), (None, "", "r"), (2, "a b " * 20 + "c", "r"), (2, "a b " * 20 + "c", "r"), (3, "x\x0by z\tq", "r"), (4, "one " * 20_000, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.collapse(docs).collect()), key=str)
    want = [(1, [], ""), (None, [], ""), *[(2, [(0, 40, 2)], "a b c")] * 2, (3, [], "x y z q"), (4, [(0, 20_000, 1)], "one")]
    assert got == sorted(want, key=str)
    assert periodic.collapse(docs.limit(0)).collect() == []


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert set(got) == set(docs)
    some = 0
    for d, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        h, n = zlib.crc32(str(d).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain(words) if n < 3000 else None
        if runs is None:
            continue
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2])
        assert (got[d].n_runs, got[d].start, got[d].length, got[d].period, got[d].exponent_milli) == want
        assert got[d].runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert got[d].collapsed_sha256 == hashlib.sha256(" ".join(rest(words, runs)).encode()).hexdigest()
        some += bool(runs)
    assert some > 10
