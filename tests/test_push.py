"""Pushes of several users: decisions in sequence, owners, roles, stamps, and stores that several writers share."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scopelake.operators import log, push
from scopelake.operators.view import fold
from scopelake.plans.catalog import TableDef, by_user, by_workspace
from scopelake.plans.query import schema
from scopelake.sources.store import CHANGES, LEDGER, Conflict, Store
from scopelake.streaming import live

TODOS = TableDef("todos", schema(ownerId="string", text="string", votes="double", seq="double"), by_user("ownerId"), counter_fields=("votes",), server_fields=("seq",))
DOCS = TableDef("docs", schema(ws="string", text="string"), by_workspace("ws"))
FUNCTIONS = {"add": ("insert", ("text", "votes")), "edit": ("patch", ("text", "votes")), "drop": ("delete", ())}
DOC_FUNCTIONS = {"add": ("insert", ("ws", "text")), "edit": ("patch", ("ws", "text")), "drop": ("delete", ())}
OPS = "seq int, op_id string, user_id string, schema_version int, function_name string, id string, value string, patch string, group_id string"
KINDS = {"add": "insert", "edit": "patch", "drop": "delete"}


def serial(ops, stored):
    """Outcomes of operations (seq, user, fn, id, group) one after the other over stored {id: (live, owner)}."""
    units, rows, out = {}, {i: (True, live, owner) for i, (live, owner) in stored.items()}, {}
    for o in ops:
        units.setdefault((o["user"], o["group"]) if o["group"] else o["seq"], []).append(o)
    for unit in sorted(units.values(), key=lambda u: u[0]["seq"]):
        staged, first, seen = dict(rows), None, {}
        for o in unit:
            known, live, owner = staged.get(o["id"], (False, False, None))
            kind, label, why = KINDS[o["fn"]], f"todos:{o['id']}", None
            if o["bad"]:
                why = "unknownField"
            elif kind == "insert":
                why = f"Duplicate localId {label}" if live else None
                staged[o["id"]] = staged.get(o["id"], (False, False, None)) if why else (True, True, o["user"])
            elif owner != o["user"] or not (live if kind == "patch" else known):
                why = f"Cannot {kind} {label}"
            elif kind == "delete":
                staged[o["id"]] = (True, False, owner)
            seen[o["seq"]] = (why, why is None and kind == "delete" and not live)
            first = first or why
        if unit[0]["group"] and first:
            out |= {o["seq"]: (f"groupRejected: {first}", False) for o in unit}
        else:
            out |= seen
            rows = staged if unit[0]["group"] or not first else rows
    return out


def frame(spark, ops):
    rows = [(o["seq"], o.get("op", f"o{o['seq']}"), o["user"], 1, o["fn"], o["id"], json.dumps(o.get("value", {"text": "x"})) if o["fn"] == "add" else None, json.dumps(o.get("patch", {"no": 1} if o.get("bad") else {"text": "y"})) if o["fn"] == "edit" else None, o.get("group")) for o in ops]
    return spark.createDataFrame(rows, OPS)


def stored_rows(spark, table, rows):
    return spark.createDataFrame(rows, Store.row_schema(table))


def test_random_pushes_equal_a_serial_interpreter(spark):
    """A thousand pushes of two users over few rows, most with groups that share rows, side by side in one frame."""
    rng, ops, stored, want = random.Random(7), [], {}, {}
    for n in range(1000):
        ids = [f"{n}:{k}" for k in range(rng.randint(1, 4))]
        have = {i: (rng.random() < 0.7, rng.choice(["u1", "u2", None])) for i in ids if rng.random() < 0.4}
        own = []
        for g in range(rng.randint(1, 5)):
            user, group = rng.choice(["u1", "u2"]), rng.choice([None, f"g{g}"])
            for _ in range(rng.randint(1, 4) if group else 1):
                fn = rng.choice(["add", "edit", "drop"])
                own.append({"seq": len(ops) + len(own), "user": user, "group": group and f"{n}{group}", "fn": fn, "id": rng.choice(ids), "bad": fn == "edit" and rng.random() < 0.1})
        want |= serial(own, have)
        ops += own
        stored |= have
    rows = stored_rows(spark, TODOS, [(i, owner, "t", None, None, 1, not live) for i, (live, owner) in stored.items()])
    got = log.validate(TODOS, frame(spark, ops), rows, FUNCTIONS, 1)
    assert {r.seq: (r.reject_reason, r.no_op) for r in got.collect()} == want
    assert sum(w[0] is None for w in want.values()) > 500


def test_a_rejected_group_hides_nothing(spark):
    """G never happens, so K's insert of the same row is no duplicate; what builds on a group that fails fails too."""
    ops = [
        {"seq": 0, "fn": "add", "id": "A", "group": "G"}, {"seq": 1, "fn": "edit", "id": "X", "group": "G"}, {"seq": 2, "fn": "add", "id": "A", "group": "K"}, {"seq": 3, "fn": "add", "id": "D", "group": "K"},
        {"seq": 4, "fn": "add", "id": "C", "group": "H"}, {"seq": 5, "fn": "add", "id": "D", "group": "H"}, {"seq": 6, "fn": "edit", "id": "C"}, {"seq": 7, "fn": "edit", "id": "A"},
    ]
    got = {r.seq: r.reject_reason for r in log.validate(TODOS, frame(spark, [o | {"user": "u1"} for o in ops]), stored_rows(spark, TODOS, []), FUNCTIONS, 1).collect()}
    assert got == {0: "groupRejected: Cannot patch todos:X", 1: "groupRejected: Cannot patch todos:X", 2: None, 3: None, 4: "groupRejected: Duplicate localId todos:D", 5: "groupRejected: Duplicate localId todos:D", 6: "Cannot patch todos:C", 7: None}


def empty(spark):
    return spark.createDataFrame([], CHANGES), spark.createDataFrame([], LEDGER)


def test_two_users(spark):
    """One op_id of two users, an owner that lies, and writes to another's rows."""
    rows = stored_rows(spark, TODOS, [("r1", "u1", "t", 1.0, None, 1, False), ("r2", "u2", "t", 1.0, None, 1, False)])
    delta = lambda n: {"votes": {"__lfCounter": n}}
    ops = [
        {"seq": 0, "op": "o", "user": "u1", "fn": "edit", "id": "r1", "patch": delta(5)}, {"seq": 1, "op": "o", "user": "u2", "fn": "edit", "id": "r2", "patch": delta(6)}, {"seq": 2, "op": "p", "user": "u1", "fn": "add", "id": "n", "value": {"text": "x", "ownerId": "u2"}},
        {"seq": 3, "op": "p", "user": "u2", "fn": "edit", "id": "n"}, {"seq": 4, "op": "q", "user": "u2", "fn": "drop", "id": "r1"}, {"seq": 5, "op": "q", "user": "u1", "fn": "edit", "id": "n"},
    ]
    got = push.push(TODOS, frame(spark, ops), rows, *empty(spark), FUNCTIONS, 1, 9.0, F.concat(F.lit("u:"), "user_id"), stamps={"seq": 40})
    assert {(r.user_id, r.op_id): (r.outcome, r.error) for r in got.answers.collect()} == {("u1", "o"): ("accepted", None), ("u2", "o"): ("accepted", None), ("u1", "p"): ("accepted", None), ("u2", "p"): ("rejected", "Cannot patch todos:n"), ("u2", "q"): ("rejected", "Cannot delete todos:r1"), ("u1", "q"): ("accepted", None)}
    made = {(r.id, r.kind): json.loads(r.value or r.patch) for r in got.changes.collect()}
    assert made == {("r1", "patch"): {"votes": 6.0}, ("r2", "patch"): {"votes": 7.0}, ("n", "insert"): {"ownerId": "u1", "text": "x", "seq": 41.0}, ("n", "patch"): {"text": "y"}}
    assert {r._id: (r.ownerId, r.seq) for r in fold(TODOS, rows, got.changes).collect()} == {"r1": ("u1", None), "r2": ("u2", None), "n": ("u1", 41.0)}
    later = push.push(TODOS, frame(spark, [{"seq": 0, "user": "u2", "fn": "drop", "id": "n"}]), fold(TODOS, rows, got.changes), got.changes, got.ledger, FUNCTIONS, 1, 9.0, F.lit("w"))
    assert [r.error for r in later.answers.collect()] == ["Cannot delete todos:n"] and later.changes.count() == 0
    with pytest.raises(ValueError):
        push.push(TODOS, frame(spark, ops), rows, *empty(spark), FUNCTIONS, 1, 9.0, F.lit("w"), stamps={"ownerId": 1})


def test_answers_bring_back_their_changes(spark):
    """The second send returns the changes of the first, though the log is gone by then; a no-op has none."""
    ops = frame(spark, [{"seq": 0, "user": "u1", "fn": "add", "id": "a"}, {"seq": 1, "user": "u1", "fn": "drop", "id": "a"}, {"seq": 2, "user": "u1", "fn": "drop", "id": "a"}])
    first = push.push(TODOS, ops, stored_rows(spark, TODOS, []), *empty(spark), FUNCTIONS, 1, 9.0, F.lit("w"))
    rows = fold(TODOS, stored_rows(spark, TODOS, []), first.changes)
    again = push.push(TODOS, ops, rows, empty(spark)[0], first.ledger, FUNCTIONS, 1, 10.0, F.lit("w"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(again.redelivered.select(*first.changes.columns)) == key(first.changes) and first.changes.count() == 2
    assert again.changes.count() == again.ledger.count() == 0 and first.redelivered.count() == 0
    other = push.push(TODOS, ops, rows, empty(spark)[0], first.ledger, FUNCTIONS, 2, 10.0, F.lit("w"))
    assert {r.error for r in other.answers.collect()} == {"schemaMismatch"} and other.redelivered.count() == 0


def test_roles_and_rules(spark):
    """Members write, each by their role in the scope of the row, whichever insert of the push put it there."""
    rows = stored_rows(spark, DOCS, [("d1", "w1", "t", 1, False)])
    roles = spark.createDataFrame([("u1", "w1", 20), ("u2", "w1", 5), ("u2", "w2", 20)], "user_id string, scope_value string, role int")
    ops = [
        {"user": "u1", "fn": "edit", "id": "d1"}, {"user": "u2", "fn": "edit", "id": "d1"}, {"user": "u3", "fn": "edit", "id": "d1"}, {"user": "u1", "fn": "edit", "id": "d1", "patch": {"ws": "w2"}},
        {"user": "u2", "fn": "add", "id": "d2", "value": {"ws": "w2"}}, {"user": "u1", "fn": "edit", "id": "d2"}, {"user": "u2", "fn": "edit", "id": "d2"}, {"user": "u3", "fn": "add", "id": "d3", "value": {"ws": "w1"}},
        {"user": "u2", "fn": "add", "id": "d4", "value": {"ws": "w1"}}, {"user": "u1", "fn": "add", "id": "d5", "value": {"text": "nowhere"}},
    ]
    ops = frame(spark, [o | {"seq": i} for i, o in enumerate(ops)])
    got = push.push(DOCS, ops, rows, *empty(spark), DOC_FUNCTIONS, 1, 9.0, F.lit("w"), roles, {"docs": lambda r: r >= 10})
    assert {int(r.op_id[1:]): r.error for r in got.answers.collect()} == {0: None, 1: "Cannot patch docs:d1", 2: "Cannot patch docs:d1", 3: "Cannot patch docs:d1", 4: None, 5: "Cannot patch docs:d2", 6: None, 7: "Not a member of w1", 8: "Cannot insert docs:d4", 9: "Not a member of None"}
    free = push.push(DOCS, ops, rows, *empty(spark), DOC_FUNCTIONS, 1, 9.0, F.lit("w"))
    assert {int(r.op_id[1:]) for r in free.answers.filter("outcome = 'rejected'").collect()} == {3}


def send(spark, store, ops, **how):
    base = store.version()
    made = push.push(TODOS, frame(spark, ops), store.canonical(TODOS), store.known(), store.ledger(), FUNCTIONS, 1, how.pop("now", 9.0), F.concat(F.lit("u:"), "user_id"))
    return base, made


def data_files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and "/canonical/" not in d}


def test_two_stale_writers(spark, tmp_path):
    """Of two pushes made from one state the second is refused, and can be made again; no part is ever rewritten."""
    s = Store(spark, str(tmp_path), "race", buckets=3)
    base, one = send(spark, s, [{"seq": 0, "op": "a", "user": "u1", "fn": "add", "id": "x"}])
    _, two = send(spark, s, [{"seq": 0, "op": "b", "user": "u2", "fn": "add", "id": "x"}])
    assert s.commit(TODOS, one, base=base)
    with pytest.raises(Conflict):
        s.commit(TODOS, two, base=base)
    assert [(r.user_id, r.op_id) for r in s.ledger().collect()] == [("u1", "a")] and s.log().count() == 1
    before = data_files(tmp_path)
    base, two = send(spark, s, [{"seq": 0, "op": "b", "user": "u2", "fn": "add", "id": "x"}, {"seq": 1, "op": "c", "user": "u2", "fn": "add", "id": "y"}])
    assert s.commit(TODOS, two, base=base)
    assert before.items() <= data_files(tmp_path).items()
    assert sorted((r.scope_key, r.change_id, r.id, r.version) for r in s.log().collect()) == [("u:u1", "000000000001", "x", 1), ("u:u2", "000000000001", "y", 1)]
    with pytest.raises(Conflict):  # the same push once more
        s.commit(TODOS, two)
    # A table that the other writer does not touch is no conflict.
    base = s.version()
    s.advance(spark.createDataFrame([("w", "000000000001")], "scope_key string, cursor string"))
    assert s.replace("other", spark.range(2).toDF("n"), base=base) and s.cursors().count() == 1
    with pytest.raises(Conflict):
        s.replace("cursors", s.cursors(), base=base)


def test_kept_numbers_equal_those_of_the_whole_log(spark, tmp_path, monkeypatch):
    from scopelake.sources import store as module

    monkeypatch.setattr(module, "PARTS", 2)
    s, rng, whole = Store(spark, str(tmp_path), "n", buckets=2), random.Random(3), spark.createDataFrame([], CHANGES)
    for n in range(3):
        ops = [{"seq": i, "op": f"{n}.{i}", "user": rng.choice(["u1", "u2"]), "fn": rng.choice(["add", "edit", "drop"]), "id": f"r{rng.randrange(6)}"} for i in range(12)]
        base, made = send(spark, s, ops, now=float(n))
        plain = push.push(TODOS, frame(spark, ops), s.canonical(TODOS), whole, s.ledger(), FUNCTIONS, 1, float(n), F.concat(F.lit("u:"), "user_id"))
        assert sorted(map(str, made.changes.collect())) == sorted(map(str, plain.changes.collect()))
        assert s.commit(TODOS, made, base=base)
        whole = s.log()
    assert len(s._folders("rows#")) <= 2 and len(s._folders("log#")) == 3
    ends = lambda df: {r.scope_key: r.c for r in df.groupBy("scope_key").agg(F.max("change_id").alias("c")).collect()}
    last, n = ends(s.log()), s.log().count()
    known = sorted(map(str, s.known().rows.collect()))
    assert s.prune(2.0) == 2 and s.log().count() < n and ends(s.log()) == last and sorted(map(str, s.known().rows.collect())) == known


def test_served_stream_tells_each_write_once(spark, tmp_path):
    s, told = Store(spark, str(tmp_path), "srv"), []
    src = str(tmp_path / "ops")

    def serve(ops):
        frame(spark, ops).coalesce(1).write.mode("append").parquet(src)
        stream = live.operation_stream(spark, src, OPS)
        live.serve(stream, s, TODOS, FUNCTIONS, 1, F.concat(F.lit("u:"), "user_id"), str(tmp_path / "cp"), clock=lambda: 5.0, on_write=lambda df: told.append(sorted((r.function_name, r.id, r.before and r.before.text, r.after and r.after.text) for r in df.collect()))).awaitTermination()

    one = {"seq": 0, "op": "a", "user": "u1", "fn": "add", "id": "x"}
    serve([one])
    serve([one, {"seq": 1, "op": "b", "user": "u1", "fn": "edit", "id": "x"}])
    assert told == [[("add", "x", None, "x")], [("edit", "x", "x", "y")]]
    assert sorted(r.op_id for r in s.feed(TODOS).collect()) == ["a", "b"]
    # A batch that comes again after its commit is not pushed twice.
    _, made = send(spark, s, [{"seq": 0, "op": "z", "user": "u1", "fn": "add", "id": "z"}])
    assert not s.commit(TODOS, made, batch="serve-1") and s.log().count() == 2


_BOARD = schema(title="string", tags="array<string>", marks="array<double>", n="bigint", x="double").add("d", T.DecimalType(10, 2))
BOARD = TableDef("board", _BOARD, set_fields=("tags", "marks"), counter_fields=("n", "x", "d"))


def _resolved(rows, ops):
    """materialize() one operation after the other: seq -> patch with plain values, of patches that hold a delta."""
    rows, out = {k: dict(v) for k, v in rows.items()}, {}
    for seq, row, kind, body in ops:
        now = rows.setdefault(row, {})
        if kind in ("insert", "replace"):
            rows[row] = dict(body)
        elif kind == "patch":
            hit = False
            for f, v in body.items():
                if isinstance(v, dict) and "__lfSet" in v:
                    add, gone = v["__lfSet"].get("add") or [], v["__lfSet"].get("remove") or []
                    hit, kept = True, []
                    for e in [*(now.get(f) or []), *add]:
                        if e not in gone and e not in kept:
                            kept.append(e)
                    now[f] = kept
                elif isinstance(v, dict) and "__lfCounter" in v:
                    hit, total = True, (now.get(f) or 0) + v["__lfCounter"]
                    now[f] = int(total) if f == "n" else total
                else:
                    now[f] = v
            if hit:
                out[seq] = {f: now[f] for f in body}
    return out


def test_deltas_equal_a_serial_interpreter(spark):
    """Sets and counters of several types over stored, new, deleted and replaced rows, one of which has most operations."""
    rng = random.Random(4)
    tags, rows = [*"abcdef", None], {f"r{i}": {"title": "t", "tags": rng.choice([None, [], ["a", "b"]]), "marks": [0.5], "n": rng.choice([None, 5]), "x": 1.5, "d": None} for i in range(4)}

    def field(f):
        if f == "title":
            return rng.choice(["u", "v", None])
        pool = tags if f == "tags" else [0.5, 1.25, -2.0, None]
        some = lambda: [rng.choice(pool) for _ in range(rng.randrange(3))]
        if f in ("tags", "marks"):
            return rng.choice([{"__lfSet": {"add": some(), "remove": some()}}, {"__lfSet": {"add": some()}}, some(), None])
        return rng.choice([{"__lfCounter": rng.choice([2, -3, 0.25, -0.75])}, 4, None])

    ops = []
    for seq in range(3000):
        row, kind = rng.choice(["r0", "r0", "r0", "r1", "r2", "new", "z"]), rng.choice(["patch"] * 12 + ["insert", "replace", "delete"])
        names = rng.sample(["title", "tags", "marks", "n", "x", "d"], rng.randrange(1, 4)) if row != "z" else ["title"]
        body = {f: v for f in names if not isinstance(v := field(f), dict)} if kind in ("insert", "replace") else {f: field(f) for f in names} if kind == "patch" else None
        ops.append((seq, row, kind, body))
    frame = spark.createDataFrame([(s, r, k, json.dumps(b) if k in ("insert", "replace") else None, json.dumps(b) if k == "patch" else None) for s, r, k, b in ops], "seq bigint, id string, kind string, value string, patch string")
    canonical = spark.createDataFrame([(k, v["title"], v["tags"], v["marks"], v["n"], v["x"], v["d"], False) for k, v in rows.items()], "_id string, title string, tags array<string>, marks array<double>, n bigint, x double, d decimal(10,2), _deleted boolean")
    got = {r.seq: r for r in push.materialize(BOARD, frame, canonical).collect()}
    want = _resolved(rows, ops)
    assert len(got) == 3000 and len(want) > 1000
    for seq, _, kind, body in ops:
        if seq in want:
            assert json.loads(got[seq].patch) == want[seq], (seq, got[seq].patch, want[seq])
        else:
            assert got[seq].patch == (json.dumps(body) if kind == "patch" else None)
    assert push.materialize(BOARD, frame.limit(0), canonical).count() == 0


def test_long_history_of_one_row(spark):
    """A counter that one push counts up fifty thousand times."""
    n = 50_000
    ops = spark.range(n).selectExpr("id as seq", "'r' as id", "'patch' as kind", "cast(null as string) as value", """'{"n":{"__lfCounter":1}}' as patch""")
    empty = spark.createDataFrame([], "_id string, title string, tags array<string>, marks array<double>, n bigint, x double, d decimal(10,2), _deleted boolean")
    made = push.materialize(BOARD, ops, empty)
    assert made.filter("patch = format_string('{\"n\":%d}', seq + 1)").count() == n
