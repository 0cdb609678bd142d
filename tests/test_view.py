import json
import random

from scopelake.functions import sets
from scopelake.operators import view
from scopelake.plans.catalog import TableDef
from scopelake.plans.query import schema

T = TableDef("t", schema(a="string", n="bigint", labels="array<string>", votes="double"), set_fields=("labels",), counter_fields=("votes",))
FIELDS = ("a", "n", "labels", "votes")
ROW = "_id string, a string, n bigint, labels array<string>, votes double, _version bigint, _deleted boolean"
LOG = "change_id string, id string, kind string, version bigint, op_id string, value string, patch string"
OPS = "op_id string, id string, kind string, status string, created_at double, group_id string, group_index int, error string, value string, patch string"


def brute_fold(rows, log):
    state = {r[0]: dict(zip(FIELDS, r[1:5])) | {"v": r[5], "dead": bool(r[6])} for r in rows}
    for _, i, kind, v, _, value, patch in sorted(log):
        cur = state.get(i)
        if cur and (v < cur["v"] or v == cur["v"] and kind not in ("insert", "replace")):
            continue
        if kind in ("insert", "replace"):
            state[i] = dict.fromkeys(FIELDS) | json.loads(value) | {"v": v, "dead": False}
        elif kind == "delete":
            state[i] = (cur or dict.fromkeys(FIELDS)) | {"v": v, "dead": True}
        else:
            state[i] = (cur or dict.fromkeys(FIELDS)) | json.loads(patch) | {"v": v, "dead": False}
    return state


def test_fold_against_one_by_one(spark):
    r = random.Random(7)
    rows = [(f"r{i}", "base", i, ["x"], 1.0, r.randint(1, 4), r.random() < 0.2) for i in range(10)]
    log = []
    for k in range(400):
        kind = r.choice(["insert", "replace", "patch", "patch", "delete"])
        body = {f: v for f, v in (("a", r.choice([None, "p", "q"])), ("n", r.choice([None, k])), ("labels", r.choice([None, [], ["l"]])), ("votes", float(k))) if r.random() < 0.6}
        log.append((f"{k:012d}", f"r{r.randrange(20)}", kind, r.randint(1, 3 + k // 20), None, json.dumps(body) if kind in ("insert", "replace") else None, json.dumps(body) if kind == "patch" else None))
    got = {x._id: {f: x[f] for f in FIELDS} | {"v": x._version, "dead": x._deleted} for x in view.fold(T, spark.createDataFrame(rows, ROW), spark.createDataFrame(log, LOG)).collect()}
    assert got == brute_fold(rows, log)
    assert view.fold(T, spark.createDataFrame([], ROW), spark.createDataFrame([], LOG)).count() == 0


def op(i, row, kind, at, value=None, patch=None, status="pending", group=None, index=None, error=None):
    return (i, row, kind, status, float(at), group, index, error, value and json.dumps(value), patch and json.dumps(patch))


def test_replay(spark):
    rows = spark.createDataFrame([("r1", "server", 1, ["a", "b"], 2.0, 5, False), ("r2", "x", 1, None, None, 1, True), ("r3", "y", 1, None, None, 1, False)], ROW)
    ops = spark.createDataFrame([
        op("o2", "r1", "patch", 2, patch={"labels": {"__lfSet": {"add": ["c", "a"], "remove": ["b"]}}, "votes": {"__lfCounter": 3}}),
        op("o1", "r1", "patch", 1, patch={"n": None}),
        op("o3", "r1", "patch", 3, patch={"votes": {"__lfCounter": -1}}, status="acked"),
        op("o4", "r2", "patch", 1, patch={"a": "z"}),
        op("o5", "new", "insert", 1, value={"a": "fresh", "labels": ["q"]}),
        op("o6", "new", "patch", 2, patch={"n": 4, "labels": ["w"]}),
        op("o7", "r3", "delete", 1),
        op("o8", "ghost", "delete", 1),
        op("o9", "r3", "patch", 9, patch={"a": "no"}, status="rejected", error="denied"),
    ], OPS)
    got = {r._id: r for r in view.derive_view(T, rows, ops).collect()}
    r1 = got["r1"]
    assert (r1.a, r1.n, r1.labels, r1.votes, r1._version, r1._pending, r1._conflict) == ("server", None, ["a", "c"], 4.0, 5, True, None)
    assert got["r2"]._deleted and got["r2"]._conflict.kind == "mergeFailed" and got["r2"]._conflict.message == "Cannot replay patch over a missing row"
    new = got["new"]
    assert (new.a, new.n, new.labels, new._version, new._deleted, new._pending) == ("fresh", 4, ["w"], None, False, True)
    assert got["r3"]._deleted and got["r3"]._conflict.kind == "serverRejected" and got["r3"]._conflict.message == "denied"
    assert "ghost" not in got  # nothing is made up for a row that never was
    left = view.confirmed(ops, spark.createDataFrame([("o1",), (None,)], "op_id string"))
    assert left.count() == 8


def test_deltas_and_inverses(spark):
    old = spark.createDataFrame([("a", "1", 1, None, None, 1, False), ("b", "2", 1, None, None, 1, False), ("c", "3", 1, None, None, 1, True)], ROW)
    new = spark.createDataFrame([("a", "1", 1, None, None, 1, False), ("b", "2", 1, None, None, 2, True), ("c", "3", 1, None, None, 2, False), ("d", "4", 1, None, None, 1, False)], ROW)
    assert {(r._id, r.kind) for r in view.row_deltas(old, new).collect()} == {("b", "delete"), ("c", "upsert"), ("d", "upsert")}
    ops = spark.createDataFrame([op("o1", "z", "insert", 1, value={"a": "n"}), op("o2", "a", "patch", 2, patch={"a": "new", "labels": ["q"], "n": 9}), op("o3", "a", "delete", 3), op("o4", "c", "patch", 4, patch={"a": "x"})], OPS)
    got = {r.op_id: r for r in view.inverse_operations(T, ops, old).collect()}
    assert set(got) == {"o1", "o2", "o3"} and got["o1"].kind == "delete"
    assert json.loads(got["o2"].patch) == {"a": "1", "n": 1, "labels": None}
    assert json.loads(got["o3"].value) == {"a": "1", "n": 1, "labels": None, "votes": None}


def test_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), (None, ["x"]), (["a", None], [None])], "now array<string>, want array<string>")
    from pyspark.sql import functions as F

    add, remove = sets.set_delta(F.col("now"), F.col("want"))
    got = df.select(add.alias("add"), remove.alias("remove"), sets.apply_set_delta(F.col("now"), add, remove).alias("out")).collect()
    assert [(r.add, r.remove, r.out) for r in got] == [(["c"], ["a"], ["b", "c"]), (["x"], [], ["x"]), ([], ["a"], [None])]


def test_a_patch_revives(spark):
    log = [("000000000001", "r", "insert", 1, None, '{"a":"x","n":1}', None), ("000000000002", "r", "delete", 2, None, None, None), ("000000000003", "r", "patch", 3, None, None, '{"n":2}'), ("000000000004", "r", "delete", 3, None, None, None)]
    row = view.fold(T, spark.createDataFrame([], ROW), spark.createDataFrame(log, LOG)).first()
    assert (row.a, row.n, row._version, row._deleted) == ("x", 2, 3, False)  # the last delete is stale


def test_undo_and_redo(spark):
    rows = spark.createDataFrame([("a", "now", 1, None, None, 1, False), ("gone", "x", 1, None, None, 1, True)], ROW)
    entries = spark.createDataFrame([("u1", 1, "o1", "a", "patch", None, '{"a":"old"}'), ("u1", 2, "o2", "gone", "patch", None, '{"a":"y"}'), ("u2", 1, "o3", "gone", "insert", '{"a":"back"}', None)], "unit string, position int, op_id string, id string, kind string, value string, patch string")
    ops, counter = view.undo(T, entries, rows)
    assert {r.op_id for r in ops.collect()} == {"o1", "o3"}
    got = {r.op_id: (r.unit, r.position, r.kind, r.patch) for r in counter.collect()}
    assert got == {"o1": ("u1", -1, "patch", '{"a":"now"}'), "o3": ("u2", -1, "delete", None)}
    redo = spark.createDataFrame([("s",), ("t",)], "scope_key string")
    assert [r.scope_key for r in view.after_new_action(redo, redo.filter("scope_key = 's'")).collect()] == ["t"]
