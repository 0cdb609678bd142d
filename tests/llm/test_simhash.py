import random

import numpy as np
import xxhash

from scopelake.llm import simhash
from scopelake.llm.components import components


def brute_fp(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_matches_the_plain_rule():
    for t in ["", None, " \t\n", "One", "one TWO", "a b c", "a b c d a b c d", "É ÀB straße ümlaut X  y z \x0b q", "w " * 5000, "x" * 100000]:
        assert simhash.fingerprint(t or "") == brute_fp(t)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('abc') h").first().h == np.array([xxhash.xxh64_intdigest(b"abc", 42)], "u8").view("i8")[0]


def groups(spark, fps, **kw):
    df = spark.createDataFrame([(int(np.array([f], "u8").view("i8")[0]),) for f in set(fps.values())], "fp long")
    found = {r.node: r.component for r in components(simhash.links(df, **kw)).collect()}
    sign = {i: int(np.array([f], "u8").view("i8")[0]) for i, f in fps.items()}
    by = {}
    for i, s in sign.items():
        by.setdefault(found.get(s, s), []).append(i)
    return {i: min(g) for g in by.values() for i in g}


def near_words(seed, n, base):
    r = random.Random(seed)
    out = {}
    for i in range(n):
        x = base if r.random() < 0.6 else r.getrandbits(64)
        for _ in range(r.randrange(6)):
            x ^= 1 << r.randrange(64)
        out[i] = x
    return out


def test_links_lose_nothing(spark):
    for seed in range(3):
        fps = near_words(seed, 250, 0x0123456789ABCDEF)
        want = brute_components(fps)
        assert groups(spark, fps) == want
        assert groups(spark, fps, bucket=3) == want  # hot buckets go through shared neighbours


def test_documents(spark):
    rows = [(5, "Some words that are copied in here again and again"), (3, "some WORDS that are copied in here again and again"), (9, None), (8, ""), (7, "other text entirely with nothing the same"), (None, "lone text of no id at all"), (3, "some WORDS that are copied in here again and again")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (7, 7), (None, None)], key=str)
    kept = simhash.kept(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "8", "None"]
    unnamed = spark.createDataFrame([(None, rows[0][1]), (None, rows[0][1]), (5, rows[0][1]), (None, "some text without any id"), (None, "some text without any id"), (2, "a"), (2, "b b b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in simhash.kept(unnamed).collect()) == [("2", "a"), ("2", "b b b"), ("5", rows[0][1]), ("None", "some text without any id")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in range(1, 60))


def test_split_buckets_lose_nothing(spark):
    """Many fingerprints that share a segment: too many for one bucket, few enough for those that the rest splits it into."""
    r = random.Random(8)
    fps = {}
    for i in range(400):
        x = fps[r.randrange(i)] if i and r.random() < 0.5 else r.getrandbits(43) << 21 | 12345
        for _ in range(r.randrange(4)):
            x ^= 1 << r.randrange(21, 64)
        fps[i] = x
    want = brute_components(fps)
    assert groups(spark, fps) == want
    assert groups(spark, fps, bucket=60) == want


def test_kept_takes_any_id(spark):
    rows = [("b", "one two three four five"), ("a", "one two three four five"), (None, "one two three four five"), (None, "other words altogether here"), ("c", "")]
    got = simhash.kept(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "-", r.text) for r in got) == [("-", "other words altogether here"), ("a", "one two three four five"), ("c", "")]
