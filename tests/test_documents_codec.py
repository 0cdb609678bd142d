"""Lossless values, document logs, attachments, plans of several operations and pushes of several tables."""

import datetime as dt
import json
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scopelake.functions import codec
from scopelake.operators import attachments, documents, push
from scopelake.operators.view import fold
from scopelake.plans.catalog import Manifest, TableDef, by_user, by_workspace
from scopelake.plans.mutations import Mutation, Plan, Step, functions
from scopelake.plans.query import Database, schema
from scopelake.sources.store import CHANGES, LEDGER, Store


def test_codec_round_trip(spark):
    shape = "a bigint, b binary, c double, d float, e string, f boolean, g int, h decimal(20,4), i date, j timestamp, k array<bigint>, l struct<x:binary,y:array<double>>, m map<string,bigint>, n timestamp_ntz"
    rng = random.Random(4)
    odd = [math.nan, math.inf, -math.inf, -0.0, 0.0, 1e308, 5e-324, 0.1, 3.0]
    def one():
        maybe = lambda v: rng.choice([v, v, None])
        number = lambda: rng.choice([-(2**63), 2**63 - 1, 2**53 + 1, -(2**53) - 1, -1, 0, 7, rng.randrange(-(2**63), 2**63)])
        raw = lambda: bytearray(rng.randbytes(rng.choice([0, 1, 3, 100])))
        return (
            maybe(number()), maybe(raw()), maybe(rng.choice(odd)), maybe(rng.choice([math.nan, math.inf, 0.5, -0.0])), maybe(rng.choice(['q"uo\\te', "é\n ", "", "{", '{"$integer":"x"}'])), maybe(True), maybe(-5), maybe(Decimal("1234567890123456.7891")),
            maybe(dt.date(1969, 12, 30)), maybe(dt.datetime(2024, 5, 1, 12, 0, 0, 123456)), maybe([number(), None]), maybe((raw(), [rng.choice(odd), None])), maybe({"a b": number(), '"': None}), maybe(dt.datetime(2024, 3, 31, 2, 30, 0, 7)),
        )

    df = spark.createDataFrame([one() for _ in range(300)], shape)
    texts = codec.encode_rows(df).persist()
    for r in texts.collect():
        json.loads(r.json)
    back = codec.decode_rows(texts, df.schema)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert spark.range(1).select(codec.encode(F.lit(10).cast("bigint"), T.LongType()).alias("x")).first().x == '{"$integer":"CgAAAAAAAAA="}'
    assert spark.range(1).select(codec.decode(F.lit("no json"), T.LongType()).alias("x")).first().x is None
    with pytest.raises(TypeError):
        codec.encode(F.lit(None), T.NullType())


UPDATES = "doc string, id string, update binary, confirmed boolean, covers array<string>"


def test_document_log(spark):
    """Random logs: compaction keeps every update once and in order, whether the second step came or not, and later ones stay."""
    rng = random.Random(2)
    rows = [(f"d{rng.randrange(4)}", f"u{rng.randrange(30):02d}") for _ in range(150)]
    rows = [(d, i, bytearray(f"{d}{i}".encode() * rng.randrange(3)), rng.random() < 0.9, None) for d, i in sorted(set(rows))]
    content = {(d, i): bytes(u) for d, i, u, *_ in rows}
    df = spark.createDataFrame(rows + rng.sample(rows, 20), UPDATES)
    want = lambda d: [content[d, i] for dd, i in sorted(content) if dd == d]
    key = lambda df: sorted(map(tuple, df.collect()))

    def read(df):
        out = {d: [] for d in ("d0", "d1", "d2", "d3")}
        for r in sorted(documents.unfolded(df).collect(), key=lambda r: (r.doc, r.id, r.place)):
            out[r.doc].append(bytes(r.update))
        return out

    assert read(df) == {d: want(d) for d in ("d0", "d1", "d2", "d3")}
    docs = spark.createDataFrame([("d0",), ("d1",)], "doc string")
    made = documents.snapshots(df, docs, F.concat(F.lit("~"), F.md5(F.concat_ws(",", "covers")))).persist()
    crashed = df.unionByName(made)  # not confirmed: nothing goes
    assert documents.prune(crashed).count() == crashed.count()
    confirmed = df.unionByName(made.withColumn("confirmed", F.lit(True)))
    later = confirmed.unionByName(spark.createDataFrame([("d0", "u99", bytearray(b"late"), True, None)], UPDATES))
    for state in (later, documents.prune(later)):
        got = read(state)
        assert all(sorted(got[d]) == sorted(want(d) + ([b"late"] if d == "d0" else [])) for d in got)
    pruned = documents.prune(later).persist()
    unconfirmed = {d: sum(not c for dd, _, _, c, _ in rows if dd == d) for d in ("d0", "d1")}
    left = {r.doc: r["count"] for r in documents.ordered(pruned).groupBy("doc").count().collect()}
    assert left["d0"] == unconfirmed["d0"] + 2 and left["d1"] == unconfirmed["d1"] + 1
    # A snapshot of a snapshot gives everything back too.
    again = documents.snapshots(pruned, docs, F.concat(F.lit("~~"), "doc")).withColumn("confirmed", F.lit(True))
    twice = documents.prune(pruned.unionByName(again))
    got = read(twice)
    assert all(sorted(got[d]) == sorted(want(d) + ([b"late"] if d == "d0" else [])) for d in ("d0", "d1"))
    quiet = spark.createDataFrame([("a", f"{k}", bytearray(b"x"), True, None) for k in range(5)] + [("b", f"{k}", bytearray(b"x"), k > 0, None) for k in range(5)] + [("c", "0", bytearray(b"x" * 50), True, None)], UPDATES)
    assert key(documents.due(quiet, 5, 50)) == [("a",), ("c",)]


FILES = TableDef("files", schema(owner="string", name="string", storageId="string"), by_user("owner"), server_fields=())
SHARED = TableDef("files", schema(ws="string", storageId="string"), by_workspace("ws"))


def test_attachments(spark):
    s = spark.createDataFrame
    rows = s([("a", "u1", "x", None, 1, False), ("b", "u1", "y", "s9", 1, False), ("c", "u2", "z", None, 1, False), ("gone", "u1", "q", None, 2, True)], Store.row_schema(FILES))
    uploads = s([(0, "a", "s1", "u1"), (1, "a", "s1", "u1"), (2, "b", "s9", "u1"), (3, "c", "s2", "u1"), (4, "gone", "s3", "u1"), (5, "none", "s4", "u1"), (6, "a", "s5", "u1")], "seq int, id string, storage_id string, user_id string")
    log = s([], CHANGES)
    answers, changes = attachments.finalize(FILES, "storageId", uploads, rows, log, 3.0, F.concat(F.lit("u:"), "owner"))
    assert {r.seq: r.ok for r in answers.collect()} == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False, 6: True}
    assert [(r.id, r.scope_key, json.loads(r.patch), r.change_id) for r in changes.orderBy("change_id").collect()] == [("a", "u:u1", {"storageId": "s1"}, "000000000001"), ("a", "u:u1", {"storageId": "s5"}, "000000000002")]
    after = fold(FILES, rows, changes)
    assert attachments.finalize(FILES, "storageId", uploads.filter("seq = 6"), after, changes, 4.0, F.lit("w"))[1].count() == 0
    blobs = s([("1", "s1"), ("2", "s5"), ("3", "s9"), ("4", None)], "id string, storage_id string")
    assert [r.storage_id for r in attachments.orphans(blobs, after, "storageId").collect()] == ["s1"]
    attachments.checked(FILES, "storageId", {"add": ("insert", ("name",)), "drop": ("delete", ())})
    for field, fns in (("storageId", {"add": ("insert", ("storageId",))}), ("nothing", {})):
        with pytest.raises(ValueError):
            attachments.checked(FILES, field, fns)
    roles = s([("u1", "w", 1), ("u2", "w", 9)], "user_id string, scope_value string, role int")
    shared = s([("a", "w", None, 1, False)], Store.row_schema(SHARED))
    ask = s([(i, "a", f"s{u}", u) for i, u in enumerate(("u1", "u2", "u3"))], uploads.schema)
    answers, changes = attachments.finalize(SHARED, "storageId", ask, shared, log, 3.0, F.lit("w"), roles, lambda r: r > 5)
    assert {r.seq: r.ok for r in answers.collect()} == {0: False, 1: True, 2: False} and changes.count() == 1


LISTS = TableDef("lists", schema(owner="string", title="string", size="bigint"), by_user("owner"))
ITEMS = TableDef("items", schema(owner="string", list="string", text="string"), by_user("owner"))
WRITES = {"newList": Mutation(LISTS, "insert", ("title",)), "grow": Mutation(LISTS, "patch", ("size",)), "newItem": Mutation(ITEMS, "insert", ("list", "text")), "dropItem": Mutation(ITEMS, "delete")}


def two_items(c):
    item = lambda k: F.concat(c.local_id, F.lit(f"/{k}"))
    return [
        Step("newList", c.local_id, {"title": c.arg("title")}),
        Step("newItem", item(0), {"list": c.local_id, "text": c.arg("first")}),
        Step("newItem", item(1), {"list": c.local_id, "text": c.arg("second")}, when=c.arg("second").isNotNull()),
        Step("grow", c.local_id, {"size": F.lit(2)}),
    ]


def parts(spark, stored=()):
    mine = lambda t: {n: f for n, f in functions(WRITES).items() if WRITES[n].table is t}
    return [push.Part(LISTS, spark.createDataFrame(list(stored), Store.row_schema(LISTS)), mine(LISTS)), push.Part(ITEMS, spark.createDataFrame([], Store.row_schema(ITEMS)), mine(ITEMS))]


def test_plans_become_groups_over_tables(spark):
    calls = spark.createDataFrame([(0, "o0", "u1", "L0", '{"title":"t","first":"a","second":"b"}', 1.0), (1, "o1", "u1", "L1", '{"title":"t","first":"a"}', 1.0), (2, "o2", "u2", "taken", '{"title":"t","first":"a","second":"b"}', 1.0)], "seq int, op_id string, user_id string, local_id string, args string, now double")
    ops = Plan(WRITES, two_items).operations(calls).withColumn("schema_version", F.lit(1))
    assert [(r.op_id, r.function_name, r.id, r.group_index) for r in ops.filter("group_id = 'o1'").orderBy("seq").collect()] == [("o1:0", "newList", "L1", 0), ("o1:1", "newItem", "L1/0", 1), ("o1:2", "grow", "L1", 2)]
    empty = spark.createDataFrame([], CHANGES), spark.createDataFrame([], LEDGER)
    got = push.push_all(parts(spark, [("taken", "u2", "t", None, 1, False)]), ops, *empty, 1, 5.0, F.concat(F.lit("u:"), "user_id"))
    answers = {r.op_id: r.error for r in got.answers.collect()}
    assert {answers[f"o0:{k}"] for k in range(4)} == {None} and {answers[f"o2:{k}"] for k in range(4)} == {"groupRejected: Duplicate localId lists:taken"}
    made = [(r.change_id, r.table, r.id, json.loads(r.value or r.patch)) for r in got.changes.orderBy("change_id").collect()]
    assert made[:4] == [("000000000001", "lists", "L0", {"owner": "u1", "title": "t"}), ("000000000002", "items", "L0/0", {"owner": "u1", "list": "L0", "text": "a"}), ("000000000003", "items", "L0/1", {"owner": "u1", "list": "L0", "text": "b"}), ("000000000004", "lists", "L0", {"size": 2})]
    assert len(made) == 7
    # A group whose last member is of a table that nobody has is rejected whole, others are not.
    odd = ops.withColumn("table", F.when((F.col("group_id") == "o0") & (F.col("group_index") == 3), "nowhere").otherwise(F.col("table")))
    answers = {r.op_id: r.error for r in push.push_all(parts(spark), odd, *empty, 1, 5.0, F.lit("w")).answers.collect()}
    assert {answers[f"o0:{k}"] for k in range(4)} == {"groupRejected: unknownFunction"} and answers["o1:0"] is None
    with pytest.raises(ValueError):
        Plan(WRITES, lambda c: [Step("grow", c.local_id, {"title": F.lit("x")})]).operations(calls)


def test_generated_keys(spark):
    items = TableDef("items", schema(owner="string", list="string", n="bigint"), by_user("owner"), indexes={"byList": ("owner", "list", "n")})
    m = Manifest(1, [items])
    m.indexed_query("mine", "items", "byList", lambda user, args: [user, args["list"]])
    rows = spark.createDataFrame([("a", "u1", "x", 2), ("b", "u1", "x", 1), ("c", "u2", "x", 1), ("d", "u1", "y", 1)], "_id string, owner string, list string, n bigint")
    assert [r._id for r in Database(m, {"items": rows}, "u1").call("mine", list="x").collect()] == ["b", "a"]
    assert Database(m, {"items": rows}).call("mine", list="x").count() == 0
    with pytest.raises(KeyError):
        m.indexed_query("other", "items", "none", lambda user, args: [])
    m.indexed_query("forged", "items", "byList", lambda user, args: ["u2", args["list"]])
    with pytest.raises(PermissionError):
        Database(m, {"items": rows}, "u1").call("forged", list="x")
    assert m.merge(Manifest(1)).keyed.keys() == {"mine", "forged"}
