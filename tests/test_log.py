import json

import pytest
from pyspark.sql import functions as F

from scopelake.operators import log, push
from scopelake.plans.catalog import TableDef, by_user, by_workspace
from scopelake.plans.query import schema

TODOS = TableDef("todos", schema(ownerId="string", text="string", labels="array<string>", votes="double", seq="double"), by_user("ownerId"), set_fields=("labels",), counter_fields=("votes",), server_fields=("seq",))
FUNCTIONS = {"add": ("insert", ("text", "labels", "votes")), "edit": ("patch", ("text", "labels", "votes")), "drop": ("delete", ())}
OPS = "seq int, op_id string, user_id string, schema_version int, function_name string, id string, value string, patch string, group_id string"
ROWS = "_id string, ownerId string, text string, labels array<string>, votes double, seq double, _version bigint, _deleted boolean"


def send(spark, *ops):
    rows = [(i, f"o{i}", o.get("user", "u1"), o.get("v", 1), o["fn"], o["id"], json.dumps(o["value"]) if "value" in o else None, json.dumps(o["patch"]) if "patch" in o else None, o.get("group")) for i, o in enumerate(ops)]
    have = spark.createDataFrame([("live", "u1", "t", None, None, None, 1, False), ("dead", "u1", "t", None, None, None, 2, True), ("other", "u2", "t", None, None, None, 1, False)], ROWS)
    got = log.validate(TODOS, spark.createDataFrame(rows, OPS), have, FUNCTIONS, 1).collect()
    return {r.seq: (r.reject_reason, r.no_op) for r in got}


def test_validation_chain(spark):
    got = send(
        spark,
        {"fn": "add", "id": "new", "value": {"text": "x"}},
        {"fn": "edit", "id": "new", "patch": {"text": "y"}},
        {"fn": "add", "id": "live", "value": {"text": "x"}},
        {"fn": "add", "id": "dead", "value": {"text": "again"}},
        {"fn": "edit", "id": "ghost", "patch": {"text": "y"}},
        {"fn": "edit", "id": "other", "patch": {"text": "y"}},
        {"fn": "drop", "id": "live"},
        {"fn": "drop", "id": "live"},
        {"fn": "drop", "id": "ghost"},
        {"fn": "nope", "id": "live"},
        {"fn": "edit", "id": "live", "patch": {"secret": 1}},
        {"fn": "edit", "id": "live", "patch": {"seq": 1}},
        {"fn": "edit", "id": "new", "patch": {"labels": "x"}},
        {"fn": "edit", "id": "new", "patch": {"votes": "x"}},
        {"fn": "edit", "id": "new", "patch": {"text": "y"}, "v": 2},
        {"fn": "edit", "id": "new", "patch": {"labels": {"__lfSet": {"add": [], "remove": []}}, "votes": {"__lfCounter": 1}}},
        {"fn": "edit", "id": "new", "patch": {"text": {"__lfSet": {"add": ["x"], "remove": []}}}},
        {"fn": "edit", "id": "new", "patch": {"text": {"__lfCounter": 1}}},
        {"fn": "edit", "id": "new", "patch": {"votes": "5"}},
        {"fn": "edit", "id": "new", "patch": {"labels": "a __lfSet b"}},
        {"fn": "edit", "id": "new", "patch": {"labels": None, "votes": 2.5}},
        {"fn": "drop", "id": "ghost"},
    )
    assert got == {0: (None, False), 1: (None, False), 2: ("Duplicate localId todos:live", False), 3: (None, False), 4: ("Cannot patch todos:ghost", False), 5: ("Cannot patch todos:other", False), 6: (None, False), 7: (None, True), 8: ("Cannot delete todos:ghost", False), 9: ("unknownFunction", False), 10: ("unknownField", False), 11: ("serverOnlyField", False), 12: ('non-array field "labels"', False), 13: ('non-number field "votes"', False), 14: ("schemaMismatch", False), 15: (None, False), 16: ('non-array field "text"', False), 17: ('non-number field "text"', False), 18: ('non-number field "votes"', False), 19: ('non-array field "labels"', False), 20: (None, False), 21: ("Cannot delete todos:ghost", False)}


def test_groups_are_all_or_nothing(spark):
    got = send(
        spark,
        {"fn": "add", "id": "a", "value": {}, "group": "g"},
        {"fn": "edit", "id": "a", "patch": {"text": "1"}, "group": "g"},
        {"fn": "edit", "id": "ghost", "patch": {"text": "1"}, "group": "g"},
        {"fn": "edit", "id": "a", "patch": {"text": "2"}},
        {"fn": "add", "id": "b", "value": {}, "group": "h"},
        {"fn": "edit", "id": "b", "patch": {"text": "2"}, "group": "h"},
    )
    assert [got[i][0] for i in range(3)] == ["groupRejected: Cannot patch todos:ghost"] * 3
    assert got[3][0] == "Cannot patch todos:a" and got[4][0] is None and got[5][0] is None


def changes(spark, rows):
    return spark.createDataFrame(rows, "scope_key string, change_id string, table string, id string, kind string, version bigint, server_time double")


def test_append_pages_and_gaps(spark):
    base = changes(spark, [("w", f"{i:012d}", "t", f"r{i % 2}", "insert", i, float(i)) for i in range(1, 4)])
    new = spark.createDataFrame([("w", "t", "r1", 1), ("w", "t", "r1", 2), ("x", "t", "r9", 3)], "scope_key string, table string, id string, seq int")
    got = sorted((r.scope_key, r.change_id, r.version) for r in log.append(base, new).collect())
    assert got == [("w", "000000000004", 4), ("w", "000000000005", 5), ("x", "000000000001", 1)]
    assert [r.change_id for r in log.changes_after(base, "w", None, 2).collect()] == ["000000000001", "000000000002"]
    pruned = base.filter("change_id > '000000000002'")
    cursors = spark.createDataFrame([("w", "000000000001"), ("n", None), ("e", "000000000000")], "scope_key string, cursor string")
    assert {r.scope_key: (r.gap, r.end_cursor) for r in log.needs_bootstrap(cursors, pruned).collect()} == {"w": (True, "000000000003"), "n": (True, "000000000000"), "e": (False, "000000000000")}
    at_last = spark.createDataFrame([("w", "000000000002")], "scope_key string, cursor string")
    assert not log.needs_bootstrap(at_last, pruned).first().gap
    assert {(r.id, r.version) for r in log.latest_versions(base).collect()} == {("r0", 2), ("r1", 3)}


def test_ledger(spark):
    ops = spark.createDataFrame([(1, "a", "u", "f"), (2, "a", "u", "g"), (3, "b", "u", "f"), (4, "a", "v", "f")], "seq int, op_id string, user_id string, fn string")
    ledger = spark.createDataFrame([("u", "a", 1, "accepted", None), ("u", "b", 0, "accepted", None)], "user_id string, op_id string, schema_version int, status string, error string")
    answered, new = log.replay_or_new(ops, ledger, 1)
    assert {(r.op_id, r.outcome, r.error) for r in answered.collect()} == {("a", "accepted", None), ("b", "rejected", "schemaMismatch")}
    assert [(r.user_id, r.op_id) for r in new.collect()] == [("v", "a")]


def test_visibility_budget_gc(spark):
    base = changes(spark, [("w", f"{i:012d}", "t", f"r{i}", "delete" if i == 3 else "patch", 1, float(i)) for i in range(1, 5)])
    now = spark.createDataFrame([("r1", "x", True), ("r2", "y", False), ("r3", "z", True)], "_id string, a string, ok boolean")
    got = {r.id: (r.kind, r.value) for r in log.visible_changes(base, now, F.col("ok")).collect()}
    assert got["r1"][0] == "insert" and json.loads(got["r1"][1]) == {"a": "x", "ok": True}
    assert got["r2"] == got["r3"] == got["r4"] == ("delete", None)
    both = base.union(changes(spark, [("v", "000000000001", "t", "q", "insert", 1, 1.0)]))
    asked = spark.createDataFrame([("w", "000000000001", 2), ("v", None, 1)], "scope_key string, cursor string, position int")
    pulled = log.pull(both, asked, 3)
    assert sorted((r.scope_key, r.change_id, r.has_more) for r in pulled.collect()) == [("v", "000000000001", False), ("w", "000000000002", True), ("w", "000000000003", True)]
    assert {r.change_id for r in log.collect_garbage(base, 9.0).collect()} == {"000000000004"} and log.collect_garbage(base, 9.0, keep_newest=False).count() == 0
    assert [r.id for r in log.garbage_batch(base, 4.0, 2).collect()] == ["r1", "r2"]
    assert log.configured(base, []).count() == 0 and log.configured(base, ["t"]).count() == 4


def test_small_operators(spark):
    ops = spark.createDataFrame([("s", i, f"o{i}", g) for i, g in enumerate([None, "g", "g", "g", None, "h", "h"])], "scope_key string, seq int, op_id string, group_id string")
    got = {r.op_id: r.chunk for r in log.chunks(ops, 2).collect()}
    assert got["o1"] == got["o2"] == got["o3"] and got["o5"] == got["o6"] and got["o0"] == 0 and got["o4"] > got["o3"]
    maps = spark.createDataFrame([("t", "l", "new", 2.0), ("t", "l", "old", 1.0)], "table string, local_id string, server_id string, created_at double")
    assert log.oldest_ids(maps).first().server_id == "old"
    beats = spark.createDataFrame([("w", "c1", "u", "{}", False, 100.0), ("w", "c1", "u", "{}", True, 200.0), ("w", "c2", "u", "{}", False, 190.0), ("w", "c3", "u", "{}", False, 1.0)], "scope_key string, client_id string, user_id string, data string, leaving boolean, updated_at double")
    assert [r.client_id for r in log.present(beats, 220.0, 50).collect()] == ["c2"]
    docs = spark.createDataFrame([("d", i % 60, "x") for i in range(120)] + [("e", 1, "x" * 2000)], "doc string, id int, update string")
    assert {r.doc for r in log.needs_compaction(docs, 60, 1500).collect()} == {"d", "e"}
    assert log.evict_scopes(ops.withColumn("w", F.lit("s")), "w", spark.createDataFrame([("s",)], "scope_value string")).count() == 0
    rejected = spark.createDataFrame([("o1", "g", 1, "t", 5.0, "rejected", "later"), ("o2", "g", 0, "u", 6.0, "rejected", "first"), ("o3", None, None, "t", 1.0, "rejected", "x"), ("o4", None, None, "t", 1.0, "pending", None)], "op_id string, group_id string, group_index int, table string, created_at double, status string, error string")
    got = {r.unit: (r.op_ids, r.tables, r.created_at, r.error) for r in log.recovery(rejected).collect()}
    assert got == {"g": (["o2", "o1"], ["t", "u"], 5.0, "first"), "o3": (["o3"], ["t"], 1.0, "x")}
    assert log.pending_count(rejected).first().n == 1
    stats = log.storage_stats(spark.createDataFrame([("t",), ("t",)], "_table string"), spark.createDataFrame([(bytearray(b"abc"),)], "data binary"))
    assert {r.name: (r.n, r.bytes) for r in stats.collect()} == {"t": (2, None), "blobs": (1, 3)}
    assert log.mint(ops, "n", 5).agg(F.max("n")).first()[0] == 12 and set(log.own(TODOS, spark.createDataFrame([("x",)], "ownerId string"), "me").first()) == {"me"}
    assert "seq" not in log.project(TODOS, spark.createDataFrame([("r", "me", 1.0, 1)], "_id string, ownerId string, seq double, _version int")).columns


def test_long_chains_settle(spark):
    """Each group builds on a row that the group before inserts, and the first is rejected."""
    ops = [{"fn": "edit", "id": "ghost", "patch": {"text": "x"}, "group": "g0"}, {"fn": "add", "id": "r0", "value": {}, "group": "g0"}]
    for i in range(1, 5):
        ops += [{"fn": "edit", "id": f"r{i - 1}", "patch": {"text": "x"}, "group": f"g{i}"}, {"fn": "add", "id": f"r{i}", "value": {}, "group": f"g{i}"}]
    assert all(r and r.startswith("groupRejected") for r, _ in send(spark, *ops).values())


def test_pull_refuses_too_many_scopes(spark):
    base = changes(spark, [("s0", "000000000001", "t", "r", "insert", 1, 1.0)])
    asked = spark.createDataFrame([(f"s{i}", None, i) for i in range(65)], "scope_key string, cursor string, position int")
    assert log.pull(base, asked.filter("position < 64"), 5).count() == 1
    with pytest.raises(ValueError):
        log.pull(base, asked, 5)
    two = base.union(changes(spark, [("s1", "000000000001", "t", "q", "insert", 1, 1.0)]))
    assert [r.scope_key for r in log.starved(two, asked.filter("position < 2"), 1).collect()] == ["s1"]


def test_ids_pages_and_versions(spark):
    known = spark.createDataFrame([("t", "l1", "s1", 1.0)], "table string, local_id string, server_id string, created_at double")
    new = spark.createDataFrame([("t", "l1", "s1", 2.0), ("t", "l2", "s2", 2.0)], known.schema)
    assert sorted(r.local_id for r in log.put_ids(known, new).collect()) == ["l1", "l2"]
    with pytest.raises(ValueError):
        log.put_ids(known, spark.createDataFrame([("t", "l1", "other", 2.0)], known.schema))
    base = changes(spark, [("w", f"{i:012d}", "t", f"r{i}", "insert", 1, float(i)) for i in range(1, 4)])
    page, end, more = log.bootstrap(base, log.latest_versions(base), "w", 2)
    assert [r.id for r in page.collect()] == ["r1", "r2"] and (end, more) == ("000000000003", True)
    grown = base.union(changes(spark, [("w", "000000000004", "t", "r9", "insert", 1, 4.0)]))
    page, end, more = log.bootstrap(grown, log.latest_versions(base), "w", 2, "t:r2", end)
    assert [r.id for r in page.collect()] == ["r3"] and (end, more) == ("000000000003", True)
    assert log.bootstrap(base, log.latest_versions(base), "none", 2)[1:] == ("000000000000", False)


def test_push_images_and_rules(spark):
    rows = spark.createDataFrame([("a", "u1", "t", ["x"], 3.0, None, 1, False)], ROWS)
    made = [{"fn": "edit", "id": "a", "patch": {"labels": {"__lfSet": {"add": ["b"], "remove": []}}}}, {"fn": "edit", "id": "a", "patch": {"labels": {"__lfSet": {"add": ["c"], "remove": ["x"]}}, "votes": {"__lfCounter": 2}}}, {"fn": "add", "id": "n", "value": {"text": "q"}}, {"fn": "edit", "id": "n", "patch": {"labels": {"__lfSet": {"add": ["b"], "remove": []}}, "votes": {"__lfCounter": 2}}}]
    ops = spark.createDataFrame([(i, f"o{i}", "u1", 1, o["fn"], o["id"], json.dumps(o["value"]) if "value" in o else None, json.dumps(o["patch"]) if "patch" in o else None, None) for i, o in enumerate(made)], OPS)
    empty = spark.createDataFrame([], "scope_key string, change_id string, `table` string, id string, version bigint")
    ledger = spark.createDataFrame([], "user_id string, op_id string, schema_version int, status string, error string")
    got = push.push(TODOS, ops, rows, empty, ledger, FUNCTIONS, 1, 9.0, F.lit("u:u1"))
    assert {r.outcome for r in got.answers.collect()} == {"accepted"}
    patches = {r.op_id: json.loads(r.patch) for r in got.changes.filter("patch is not null").collect()}
    assert patches == {"o0": {"labels": ["x", "b"]}, "o1": {"labels": ["b", "c"], "votes": 5.0}, "o3": {"labels": ["b"], "votes": 2.0}}
    seen = {r.op_id: (r.before and r.before.labels, r.after.labels) for r in push.images(TODOS, rows, got.changes).collect()}
    assert seen == {"o0": (["x"], ["x", "b"]), "o1": (["x", "b"], ["b", "c"]), "o2": (None, None), "o3": (None, ["b"])}
    again = push.push(TODOS, ops, rows, empty, got.ledger, FUNCTIONS, 1, 9.0, F.lit("u:u1"))
    assert again.changes.count() == 0 and again.answers.count() == 4
    delta = push.field_deltas(TODOS, spark.createDataFrame([("o", "a", "patch", '{"labels":["x","z"],"votes":5,"text":"t"}'), ("p", "a", "patch", '{"labels":"odd"}')], "op_id string, id string, kind string, patch string"), rows)
    assert {r.op_id: json.loads(r.patch) for r in delta.collect()} == {"o": {"labels": {"__lfSet": {"add": ["z"], "remove": []}}, "votes": {"__lfCounter": 2.0}, "text": "t"}, "p": {"labels": "odd"}}
    notes = TableDef("notes", schema(w="string"), by_workspace("w"))
    roles = spark.createDataFrame([(None,), (5,), (20,)], "role int")
    rule = {"notes": lambda r: r >= 10}
    assert [x[0] for x in roles.select(push.can(notes, rule, F.col("role"))).collect()] == [False, False, True]
    assert all(x[0] for x in roles.select(push.can(TODOS, {"todos": lambda r: r > 99}, F.col("role"))).collect())
    assert all(x[0] for x in roles.select(push.can(notes, {}, F.col("role"))).collect())


def test_rows_of_one_scope_are_not_brought_together_for_numbering(spark):
    """What is known of a scope is joined to counts, so that no task gets all rows of a scope."""
    import re

    from scopelake.sources.store import CHANGES

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        known = spark.createDataFrame([("w", f"{5:012d}", "t", "r1", "insert", None, None, 3, 0.0, None)], CHANGES)
        new = spark.range(200).selectExpr("if(id < 199, 'w', 'v') as scope_key", "'t' as `table`", "concat('r', id % 50) as id", "id as seq")
        made = log.append(known, new)
        plan = made._jdf.queryExecution().executedPlan().toString().splitlines()
        below = [plan[i + 1] for i, line in enumerate(plan[:-1]) if re.search(r"Exchange hashpartitioning\(scope_key#\d+, ", line)]
        assert below and all("HashAggregate" in line for line in below)
        got = {r.seq: (r.change_id, r.version) for r in made.collect()}
        assert got == {i: (f"{i + 6:012d}" if i < 199 else f"{1:012d}", i // 50 + 1 + 3 * (i % 50 == 1)) for i in range(200)}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
