import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scopelake.llm import token_files as T
from scopelake.llm.common import work_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts(n=300):
    r = random.Random(5)
    pools = ["abcde  \n\t'sd", "".join(map(chr, range(0x300))), "a é ß — “x” € … 北京 ​   ퟿ 😀👍", " \n\r\t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0a1'", "0123456789²³¼½ ªºab"]
    return ["".join(r.choice(r.choice(pools) if r.random() < 0.2 else p) for _ in range(r.randint(0, 60))) for p in pools for _ in range(n // len(pools))]


def test_encoder_equals_the_library():
    texts = ["", " ", "it's we'll I'd  x", "a<|endoftext|>b", "x" * 20000, " " * 3000 + "y", *odd_texts()]
    with open(PATH, encoding="utf-8") as f:
        enc = T.Encoder(f.read(), 0)
    tok = Tokenizer.from_file(PATH)
    for t, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids + [0], repr(t)


def test_perfect_hash():
    for n in (0, 1, 2, 3, 100, 5000):
        keys = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
        table = T.PerfectHash.build(keys)
        assert sorted(table.slots(keys).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        T.PerfectHash.build(np.array([5, 5], dtype=np.uint64))


def test_round_trip(spark):
    rows = [(i * 7 % 501, t) for i, t in enumerate(odd_texts(200))] + [(1000, None), (1001, ""), (-5, "first"), (1000, "copy two"), (1000, None), (None, "no key"), (2000, "long " * 40000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long").repartition(3)
    path = work_path(spark, "t")
    T.write(docs, path, PATH, chunk_ids=500)
    tok = Tokenizer.from_file(PATH)
    want, start = [], 0
    coded = [(d, np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for d, t in rows if d is not None]
    coded.sort(key=lambda x: (x[0], x[1].astype("<u2").tobytes()))
    for d, ids in coded:
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.read(T.keys_of(docs), path).collect())
    assert got == sorted(want)
    one = T.read(spark.createDataFrame([(2000, 0), (77777, 0), (None, 0)], "doc_id long, copy long"), path, whole=True).collect()
    assert [r.doc_id for r in one] == [2000] and one[0].ids == coded[-1][1].tolist()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = work_path(spark, "t")
    T.write(docs, path, PATH)
    assert T.read(T.keys_of(docs), path).count() == 0


def test_wide_ids_are_read_as_written(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    path = work_path(spark, "t")
    T.write(docs, path, PATH, end_id=70_000)
    tok = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.ids for r in T.read(T.keys_of(docs), path, whole=True).collect()}
    assert got == {d: tok.encode(t, add_special_tokens=False).ids + [70_000] for d, t in ((1, "one two"), (2, "three"))}


def test_keys_of_one_hash_stand_aside():
    h = np.array([7, 7, 9, 11, 7], dtype=np.int64)
    keys = pd.DataFrame({"doc_id": [1, 2, 3, 4, 5], "copy": 0, "h": h})
    places = {c: np.arange(5) * 10 + i for i, c in enumerate(T._PLACE)}
    row = T.build_block(keys.assign(**places))
    asked = pd.concat([keys, pd.DataFrame({"doc_id": [6], "copy": [0], "h": np.array([7], dtype=np.int64)})])
    got = T.look_up(asked, row).sort_values("doc_id")
    assert got["doc_id"].tolist() == [1, 2, 3, 4, 5] and got[list(T._PLACE)].to_numpy().tolist() == np.column_stack(list(places.values())).tolist()


def test_one_key_may_span_shards(spark):
    """Half the rows carry one doc_id: they go to several shards, and each copy is found by its own key."""
    docs = spark.createDataFrame([(5 if i % 2 else i, f"text {i} " * 50) for i in range(2000)], "doc_id long, text string").repartition(6)
    path = work_path(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        T.write(docs, path, PATH, chunk_ids=2000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{path}/shards").filter("doc_id = 5").select("shard").distinct().count() > 1
    rows = T.read(T.keys_of(docs), path).orderBy("start").collect()
    assert len(rows) == 2000 and len({(r.doc_id, r.copy) for r in rows}) == 2000
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert [(r.doc_id, r.copy) for r in rows] == sorted((r.doc_id, r.copy) for r in rows)
    tok = Tokenizer.from_file(PATH)
    want = sorted(zlib.crc32(np.array(tok.encode(f"text {i} " * 50, add_special_tokens=False).ids + [0], "<u4").tobytes()) for i in range(2000))
    assert sorted(r.ids_crc32 for r in rows) == want
