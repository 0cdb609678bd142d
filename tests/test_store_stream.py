import json

from pyspark.sql import functions as F

from scopelake.plans.catalog import TableDef
from scopelake.plans.query import Query, schema
from scopelake.sources import segments
from scopelake.sources.store import OPERATIONS, Store
from scopelake.streaming import live

T = TableDef("t", schema(status="string", rank="double"), search_fields=("status",))


def change(i, row, kind, version, body=None, op=None):
    return ("w", f"{i:012d}", "t", row, kind, json.dumps(body) if kind in ("insert", "replace") else None, json.dumps(body) if kind == "patch" else None, version, 0.0, op)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path), "n")
    assert s.canonical(T).count() == 0 and s.operations().count() == 0
    op = ("o1", "c", "u", 1, "edit", "t", "patch", "a", None, '{"status":"mine"}', 1.0, "pending", None, None, None)
    s.enqueue(spark.createDataFrame([op, ("o2", *op[1:])], OPERATIONS))
    s.enqueue(spark.createDataFrame([("o1", *op[1:9], '{"status":"late"}', *op[10:])], OPERATIONS))
    assert {r.op_id: r.patch for r in s.operations().collect()} == {"o1": '{"status":"mine"}', "o2": '{"status":"mine"}'}
    s.apply_changes(T, spark.createDataFrame([change(1, "a", "insert", 1, {"status": "open", "rank": 1.0}), change(2, "b", "insert", 1, {"status": "open"}, "o2")], live.CHANGES))
    assert {r._id: (r.status, r._pending) for r in s.live(T).collect()} == {"a": ("mine", True), "b": ("open", False)}
    s.set_status(spark.createDataFrame([("o1", "rejected", "no"), ("zz", "acked", None)], "op_id string, new_status string, new_error string"))
    assert [(r.status, r.error) for r in s.operations().collect()] == [("rejected", "no")]
    s.drop_operations(spark.createDataFrame([("o1",)], "op_id string"))
    assert s.operations().count() == 0
    for c in ("000000000005", "000000000003"):
        s.advance(spark.createDataFrame([("w", c)], "scope_key string, cursor string"))
    assert s.cursors().first().cursor == "000000000005"
    s.forget_cursors(spark.createDataFrame([("w",)], "scope_key string"))
    assert s.cursors().count() == 0
    s.set_roles(spark.createDataFrame([("w", 5)], "scope_key string, role int"))
    s.set_roles(spark.createDataFrame([("w", 20)], "scope_key string, role int"))
    assert [tuple(r) for r in s.roles().collect()] == [("w", 20)]
    s.put_blobs(spark.createDataFrame([("b", "s", bytearray(b"1"))], "id string, storage_id string, data binary"))
    s.put_blobs(spark.createDataFrame([("b", "s2", bytearray(b"2"))], "id string, storage_id string, data binary"))
    assert s.blobs().first().storage_id == "s"
    s.remove_scope_rows(T, "status", "open", spark.createDataFrame([("a",)], "_id string"))
    assert [r._id for r in s.canonical(T).collect()] == ["a"]


def test_stream_equals_batch(spark, tmp_path):
    log = [change(1, "a", "insert", 1, {"status": "open", "rank": 2.0}), change(2, "b", "insert", 1, {"status": "open", "rank": 1.0}), change(3, "a", "patch", 2, {"status": "closed"}), change(4, "b", "delete", 2), change(5, "c", "insert", 1, {"status": "open", "rank": 0.0})]
    store = Store(spark, str(tmp_path), "s")
    view = live.LiveQuery(store, "open", Query(T).filter({"status": "open"}).order("rank").limit(2))
    view.reset(store.live(T))
    seen = []

    def on_deltas(d):
        d = d.persist()
        seen.append(sorted((r._id, r.kind) for r in d.collect()))
        view.apply(d)
        live.reindex(store, T, d)

    src = str(tmp_path / "log")
    for part in (log[:3], log[3:]):
        spark.createDataFrame(part, live.CHANGES).coalesce(1).write.mode("append").parquet(src)
        live.follow(live.change_stream(spark, src), store, T, str(tmp_path / "cp"), on_deltas).awaitTermination()
    assert seen == [[("a", "upsert"), ("b", "upsert")], [("b", "delete"), ("c", "upsert")]]
    whole = Store(spark, str(tmp_path), "batch")
    whole.apply_changes(T, spark.createDataFrame(log, live.CHANGES))
    assert sorted(map(str, store.canonical(T).collect())) == sorted(map(str, whole.canonical(T).collect()))
    assert store.cursors().first().cursor == "000000000005"
    assert [r._id for r in view.result().collect()] == ["c"]
    assert {(r.id, r.token) for r in segments.postings(store, T).collect()} == {("a", "closed"), ("c", "open")}
    # The same batch again changes nothing.
    store.apply_changes(T, spark.createDataFrame(log, live.CHANGES))
    assert sorted(map(str, store.canonical(T).collect())) == sorted(map(str, whole.canonical(T).collect()))


def test_presence(spark, tmp_path):
    src = str(tmp_path / "beats")
    spark.createDataFrame([("w", "a", 1.0, False), ("w", "b", 1.0, False), ("w", "b", 2.0, True)], "scope_key string, client_id string, updated_at double, leaving boolean").coalesce(1).write.parquet(src)
    stream = live.presence(spark.readStream.schema("scope_key string, client_id string, updated_at double, leaving boolean").parquet(src), 3_600_000)
    q = stream.writeStream.format("memory").queryName("who").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    for _ in range(60):  # timeouts keep such a query alive, so it never ends by itself
        q.awaitTermination(1)
        if spark.table("who").count():
            break
    q.stop()
    assert [(r.client_id, r.here) for r in spark.table("who").collect()] == [("a", True)]


def test_epochs_first_rows_and_vacuum(spark, tmp_path):
    s = Store(spark, str(tmp_path), "e")
    first = s.epoch()
    rows = spark.createDataFrame([change(1, "a", "insert", 1, {"status": "open"}), change(2, "b", "insert", 1, {"status": "open"})], live.CHANGES)
    assert s.apply_changes(T, rows, first) and s.canonical(T).count() == 2
    s.apply_changes(T, spark.createDataFrame([change(3, "a", "patch", 2, {"status": "shut"})], live.CHANGES))
    assert {r._id: r.status for r in s.canonical(T).collect()} == {"a": "shut", "b": "open"}
    assert s.vacuum() > 0 and {r._id: r.status for r in s.canonical(T).collect()} == {"a": "shut", "b": "open"}
    s.clear()
    assert s.canonical(T).count() == 0 and not s.apply_changes(T, rows, first) and s.canonical(T).count() == 0
    op = ("o1", "c", "u", 1, "edit", "t", "patch", "a", None)
    s.enqueue(spark.createDataFrame([(*op, "first", 1.0, "pending", None, None, None), (*op, "second", 1.0, "pending", None, None, None)], OPERATIONS).coalesce(1))
    assert s.operations().first().patch == "first"
    s.set_status(spark.createDataFrame([("o1", "pushing", None), ("o1", "acked", None)], "op_id string, new_status string, new_error string").coalesce(1))
    assert s.operations().first().status == "acked"
    s.set_roles(spark.createDataFrame([("w", 5)], "scope_key string, role int"))
    s.remove_roles(spark.createDataFrame([("w",)], "scope_key string"))
    assert s.roles().count() == 0
    s.put_blobs(spark.createDataFrame([("b", None, bytearray(b"1"))], "id string, storage_id string, data binary"))
    for place in ("here", "there"):
        s.finalize_blobs(spark.createDataFrame([("b", place)], "id string, storage_id string"))
    assert s.blobs().first().storage_id == "here"


def test_live_search(spark, tmp_path):
    s, seen = Store(spark, str(tmp_path), "q"), []
    s.apply_changes(T, spark.createDataFrame([change(1, "a", "insert", 1, {"status": "open"})], live.CHANGES))
    found = live.LiveSearch(s, T, "op")
    deltas = lambda: s.live(T).select("_id", F.lit("upsert").alias("kind"), F.struct("_id", "status", "rank", "_version").alias("row"))
    live.reindex(s, T, deltas())
    report = lambda df: seen.append(sorted(r.id for r in df.collect()))
    assert found.refresh(report) and not found.refresh(report)
    s.apply_changes(T, spark.createDataFrame([change(2, "b", "insert", 1, {"status": "opened"})], live.CHANGES))
    live.reindex(s, T, deltas())
    assert found.refresh(report) and seen == [["a"], ["a", "b"]]


def test_parts_of_a_log_come_in_one_step(spark, tmp_path, monkeypatch):
    """However many parts a log has, they are written by one step, and pruned by one."""
    from scopelake.queries import QUERIES

    steps, once = [], Store.replace_all
    monkeypatch.setattr(Store, "replace_all", lambda self, *a, **k: steps.append(1) or once(self, *a, **k))
    rows = [(p * 700 + k, "even" if p % 2 else "odd") for p in range(12) for k in (0, 699)]
    spark.createDataFrame([*rows, (None, "none"), (40_000, "late"), (2_000, "once")], "event_id bigint, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id for r in QUERIES["log_pruned"](spark, str(tmp_path)).collect()}
    assert got == {i for i, _ in rows} | {40_000, 2_000} and len(steps) <= 2
    s = Store(spark, str(tmp_path), "parts")
    log = spark.createDataFrame([(*change(i + 1, str(i), "insert", 1, {})[:8], float(i), None) for i in range(100)], live.CHANGES)
    s.replace_all({"heads#all": log.groupBy("scope_key").agg(F.max(F.col("change_id").cast("bigint")).alias("last"))}, None, lambda: s.stage_parts("log", log, F.floor(F.col("server_time") / 10)))
    assert len(s._folders("log#")) == 10 and s.prune(50.0) == 5 and s.log().count() == 50 and s.vacuum() == 5 and s.log().count() == 50
    assert s.prune(1000.0) == 5 and [r.change_id for r in s.log().collect()] == ["000000000100"]
