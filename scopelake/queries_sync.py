"""Registered queries over change logs, pushes, views and stores, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import json, keys, ranks, sets
from .functions.text import tokenize
from .operators import log, push, relations, search, view
from .plans import mutations
from .plans.catalog import Manifest, TableDef, by_user, by_workspace, one
from .plans.filters import parse_filter
from .plans.query import Database, Query, schema, server_indexed
from .queries import _LOG_SQL, CUSTOMER, LABELLED, LINES, ORDERS, QUERIES, USERS, _event_log, _no_rows, _orders, _query, _read, _rows
from .sources.shared import work_path
from .sources.store import Store

VOTES = TableDef("users", schema(votes="bigint", last_type="string"), counter_fields=("votes",))
FUNCTIONS = {"add": ("insert", ("votes", "last_type")), "vote": ("patch", ("votes",)), "drop": ("delete", ())}
#: events as operations on users: clicks vote, errors drop, all else adds.
_KIND_SQL = "CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'patch' ELSE 'insert' END"
_OPS_SQL = f"(SELECT user_id, event_id, event_type, {_KIND_SQL} AS kind FROM events)"
_STATE_SQL = f"""(SELECT *, coalesce(last_value(CASE kind WHEN 'insert' THEN true WHEN 'delete' THEN false END IGNORE NULLS) OVER w, false) AS live, coalesce(bool_or(kind = 'insert') OVER w, false) AS seen
 FROM {_OPS_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_REASON_SQL = "CASE WHEN kind = 'insert' AND live THEN 'Duplicate localId users:' || user_id WHEN kind = 'patch' AND NOT live THEN 'Cannot patch users:' || user_id WHEN kind = 'delete' AND NOT seen THEN 'Cannot delete users:' || user_id END"


def _vote_ops(spark, sf) -> DataFrame:
    e = _read(spark, sf, "events")
    name = F.when(F.col("event_type") == "error", "drop").when(F.col("event_type") == "click", "vote").otherwise("add")
    return e.select(
        F.col("event_id").alias("seq"), keys.change_id(F.col("event_id")).alias("op_id"), F.lit("u").alias("user_id"), F.lit(1).alias("schema_version"), name.alias("function_name"), F.col("user_id").cast("string").alias("id"),
        F.when(name == "add", F.to_json(F.struct((F.col("event_id") % 7).alias("votes"), F.col("event_type").alias("last_type")))).alias("value"),
        F.when(name == "vote", F.format_string('{"votes":{"__lfCounter":%d}}', F.col("event_id") % 5)).alias("patch"), F.lit(None).cast("string").alias("group_id"), (F.col("event_id") % 2).alias("half"),
    )


def _no_votes(spark) -> DataFrame:
    return spark.createDataFrame([], "_id string, votes bigint, last_type string, _version bigint, _deleted boolean")


def _pushed(spark, sf) -> push.Push:
    empty = spark.createDataFrame([], "scope_key string, change_id string, `table` string, id string, version bigint")
    ledger = spark.createDataFrame([], "user_id string, op_id string, schema_version int, status string, error string")
    return push.push(VOTES, _vote_ops(spark, sf), _no_votes(spark), empty, ledger, FUNCTIONS, 1, 5.0, F.lit("w"))


@_query(f"SELECT event_id, {_REASON_SQL} AS reject_reason, kind = 'delete' AND seen AND NOT live AS no_op FROM {_STATE_SQL}")
def push_validation(spark, sf):
    return log.validate(VOTES, _vote_ops(spark, sf), _no_votes(spark), FUNCTIONS, 1).select(F.col("seq").alias("event_id"), "reject_reason", "no_op")


_LIVES_SQL = f"(SELECT *, sum(CASE WHEN kind = 'insert' AND NOT live THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS life FROM {_STATE_SQL})"
_TAKEN_SQL = f"(SELECT * FROM {_LIVES_SQL} WHERE {_REASON_SQL} IS NULL AND NOT (kind = 'delete' AND NOT live))"


@_query(f"SELECT event_id, CAST(sum(CASE kind WHEN 'insert' THEN event_id % 7 WHEN 'patch' THEN event_id % 5 END) OVER (PARTITION BY user_id, life ORDER BY event_id) AS BIGINT) AS votes FROM {_TAKEN_SQL} QUALIFY kind = 'patch'")
def delta_materialize(spark, sf):
    """Counter deltas of accepted patches, resolved against the row as the operations before leave it."""
    made = _pushed(spark, sf).changes.filter("kind = 'patch'")
    return made.select(F.col("op_id").cast("bigint").alias("event_id"), F.get_json_object("patch", "$.votes").cast("bigint").alias("votes"))


@_query(f"SELECT event_id, lpad(CAST(row_number() OVER (ORDER BY event_id) AS VARCHAR), 12, '0') AS change_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, kind FROM {_TAKEN_SQL}")
def push_changes(spark, sf):
    return _pushed(spark, sf).changes.select(F.col("op_id").cast("bigint").alias("event_id"), "change_id", "version", "kind")


@_query(f"SELECT event_id, CASE WHEN {_REASON_SQL} IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome FROM {_STATE_SQL}")
def push_answers(spark, sf):
    """Ledger and log are committed to a store together; the push is then sent again and answered from the ledger."""
    store, first = Store(spark, work_path(spark, "push")), _pushed(spark, sf)
    store.commit(VOTES, first)
    again = push.push(VOTES, _vote_ops(spark, sf), store.canonical(VOTES), store.log(), store.ledger(), FUNCTIONS, 1, 6.0, F.lit("w"))
    return again.answers.select(F.col("op_id").cast("bigint").alias("event_id"), "outcome")


@_query(
    f"""SELECT event_id, CASE WHEN prev <> 'delete' THEN lag_value END AS before_value, CASE WHEN kind <> 'delete' THEN value END AS after_value, CASE WHEN kind <> 'delete' THEN now_type END AS after_type FROM (SELECT *,
 lag(kind) OVER w AS prev, last_value(CASE WHEN kind <> 'delete' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lag_value,
 last_value(CASE WHEN kind = 'replace' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now_type FROM {_LOG_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY seq))"""
)
def write_images(spark, sf):
    got = push.images(USERS, _no_rows(spark), _event_log(spark, sf))
    return got.select((keys.change_number(F.col("change_id")) - 1).alias("event_id"), F.col("before.value").alias("before_value"), F.col("after.value").alias("after_value"), F.col("after.last_type").alias("after_type"))


@_query("SELECT l_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) FILTER (l_linenumber % 2 = 0), '') AS merged, count(*) FILTER (l_linenumber % 2 = 0 AND l_linenumber > 3) AS added, count(*) FILTER (l_linenumber % 2 = 1 AND l_linenumber <= 3) AS removed FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey")
def field_deltas(spark, sf):
    """Rows hold the lines up to 3; a patch wants the even ones; it becomes a delta, which is merged into the row."""
    table, n = TableDef("orders", schema(labels="array<string>"), set_fields=("labels",)), F.col("l_linenumber").cast("string")
    got = _read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("_id")).agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, n)).alias("labels"), F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, n)).alias("want"))
    ops = got.select(F.col("_id").alias("op_id"), F.col("_id").alias("id"), F.lit("patch").alias("kind"), F.to_json(F.struct(F.col("want").alias("labels"))).alias("patch"))
    made = push.field_deltas(table, ops, got.select("_id", "labels")).select("id", "patch")
    merged = push.merge_patch(table, got.select("_id", "labels").join(made, F.col("_id") == F.col("id")), F.col("patch"))
    size = lambda what: F.size(F.from_json(F.get_json_object("patch", f"$.labels.__lfSet.{what}"), "array<string>")).cast("long")
    return merged.select(F.col("_id").cast("bigint").alias("l_orderkey"), F.array_join(F.sort_array("labels"), ",").alias("merged"), size("add").alias("added"), size("remove").alias("removed"))


@_query("SELECT c_custkey, count(*) FILTER (kind = 1) AS added, count(*) FILTER (kind = 2) AS removed FROM (SELECT c_custkey, unnest([1, 1, 2]) AS kind FROM customer) GROUP BY c_custkey")
def set_delta_parts(spark, sf):
    a, b, c, d = (F.lit(x) for x in "abcd")
    now, want = F.array(F.col("c_name"), a, b), F.array(F.col("c_name"), b, c, d)
    add, remove = sets.set_delta(now, want)
    return _read(spark, sf, "customer").select("c_custkey", F.size(add).cast("long").alias("added"), F.size(remove).cast("long").alias("removed"))


@_query("SELECT c_custkey, coalesce(v, 0) AS version FROM customer LEFT JOIN (SELECT user_id, max(event_id + 1) AS v FROM events GROUP BY user_id) ON user_id = c_custkey")
def version_or_zero(spark, sf):
    rows = _read(spark, sf, "customer").select(F.lit("users").alias("table"), F.col("c_custkey").cast("string").alias("id"))
    return log.version_of(_event_log(spark, sf), rows).select(F.col("id").cast("bigint").alias("c_custkey"), "version")


@_query("SELECT event_type AS scope_key, lpad(CAST(min(event_id + 1) AS VARCHAR), 12, '0') AS first_id, lpad(CAST(max(event_id + 1) AS VARCHAR), 12, '0') AS last_id FROM events GROUP BY 1")
def log_bounds(spark, sf):
    e = _read(spark, sf, "events").select(F.col("event_type").alias("scope_key"), keys.change_id(F.col("event_id") + 1).alias("change_id"))
    return log.bounds(e)


@_query("SELECT l_returnflag AS \"table\", CAST(l_partkey AS VARCHAR) AS local_id, arg_min(CAST(l_orderkey AS VARCHAR), l_extendedprice) AS server_id FROM (SELECT *, count(*) OVER (PARTITION BY l_returnflag, l_partkey, l_extendedprice) AS ties FROM lineitem) WHERE ties = 1 GROUP BY 1, 2")
def id_map_oldest(spark, sf):
    rows = _read(spark, sf, "lineitem")
    lone = rows.groupBy("l_returnflag", "l_partkey", "l_extendedprice").agg(F.count("*").alias("ties"), F.min("l_orderkey").alias("o")).filter("ties = 1")
    return log.oldest_ids(lone.select(F.col("l_returnflag").alias("table"), F.col("l_partkey").cast("string").alias("local_id"), F.col("o").cast("string").alias("server_id"), F.col("l_extendedprice").alias("created_at")))


@_query("SELECT user_id, event_type, CASE WHEN first % 3 = 0 THEN 'rejected' WHEN first % 3 = 1 THEN 'accepted' ELSE 'new' END AS outcome FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2)")
def ledger_replay(spark, sf):
    """A third of the operations are known, a third known under another schema version, a third new."""
    ops = _read(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("op_id"), F.col("event_id").alias("seq"))
    first = log.first_sends(ops)
    ledger = first.filter("seq % 3 <> 2").select("user_id", "op_id", (F.col("seq") % 3).cast("int").alias("schema_version"), F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("error"))
    answered, new = log.replay_or_new(ops, ledger, 1)
    return answered.select("user_id", "op_id", "outcome").union(new.select("user_id", "op_id", F.lit("new"))).select(F.col("user_id").cast("bigint").alias("user_id"), F.col("op_id").alias("event_type"), "outcome")


@_query("SELECT event_type AS scope_key, min(event_id) > 2 AS gap FROM events GROUP BY 1")
def bootstrap_gap(spark, sf):
    e = _read(spark, sf, "events").select(F.col("event_type").alias("scope_key"), keys.change_id(F.col("event_id")).alias("change_id"))
    cursors = e.select("scope_key").distinct().withColumn("cursor", keys.change_id(F.lit(1)))
    return log.needs_bootstrap(cursors, e).select("scope_key", "gap")


@_query("SELECT event_id FROM events WHERE epoch_ms(ts) < epoch_ms(TIMESTAMP '2024-01-20') ORDER BY epoch_ms(ts), event_id LIMIT 32")
def gc_batch(spark, sf):
    return log.garbage_batch(_event_log(spark, sf), 1705708800000.0).select((keys.change_number(F.col("change_id")) - 1).alias("event_id"))


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def scope_denied(spark, sf):
    denied = spark.createDataFrame([("P",)], "scope_value string")
    return log.evict_scopes(_orders(spark, sf), "o_orderstatus", denied).select("o_orderkey", "o_totalprice")


@_query("SELECT event_id, row_number() OVER (ORDER BY event_id) + 100 AS number FROM events WHERE event_type <> 'click'")
def server_stamp(spark, sf):
    rows = _read(spark, sf, "events").filter("event_type <> 'click'").select("event_id", F.col("event_id").alias("seq"))
    return log.mint(rows, "number", 100).select("event_id", F.col("number").cast("long").alias("number"))


@_query("SELECT o_orderkey, lpad(CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS VARCHAR), 12, '0') AS change_id, '{\"o_orderpriority\":\"' || o_orderpriority || '\",\"o_custkey\":' || o_custkey || ',\"made\":7.0,\"changed\":7.0}' AS value FROM orders")
def server_write(spark, sf):
    """Orders written by the server: the price is a server column and does not leave it; both timestamps are stamped."""
    table = TableDef("orders", schema(o_orderpriority="string", o_custkey="bigint", o_totalprice="double"), by_workspace("o_custkey"), server_fields=("o_totalprice",), timestamps=("made", "changed"))
    o = _read(spark, sf, "orders")
    writes = o.select(F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("id"), F.lit("insert").alias("kind"), F.to_json(F.struct("o_orderpriority", "o_custkey", "o_totalprice")).alias("value"), F.lit(None).cast("string").alias("patch"), "o_orderstatus")
    empty = spark.createDataFrame([], "scope_key string, change_id string, `table` string, id string, version bigint")
    return push.server_write(table, writes, empty, 7.0, F.col("o_orderstatus")).select(F.col("id").cast("bigint").alias("o_orderkey"), "change_id", "value")


@_query("SELECT c_custkey, c_nationkey >= 10 AS may_write FROM customer")
def write_rules(spark, sf):
    table = TableDef("notes", schema(wsId="string"), by_workspace("wsId"))
    role = F.when(F.col("c_nationkey") >= 5, F.col("c_nationkey"))
    return _read(spark, sf, "customer").select("c_custkey", push.can(table, {"notes": lambda r: r >= 10}, role).alias("may_write"))


@_query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey > 3)")
def rel_members(spark, sf):
    c = _read(spark, sf, "customer")
    membership = c.select(F.col("c_mktsegment").alias("user_id"), F.col("c_custkey").alias("scope_value"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("role"))
    return relations.members_only(_read(spark, sf, "orders"), "o_custkey", membership, "BUILDING").select("o_orderkey")


@_query("SELECT o_orderkey, c_nationkey AS role FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'")
def rel_with_role(spark, sf):
    c = _read(spark, sf, "customer").select(F.col("c_mktsegment").alias("user_id"), F.col("c_custkey").alias("scope_value"), F.col("c_nationkey").alias("role"))
    return relations.with_role(_read(spark, sf, "orders"), "o_custkey", c, "BUILDING").select("o_orderkey", "role")


@_query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 12 WHERE o_orderstatus = 'P'")
def rel_adhoc(spark, sf):
    """A relation that the table does not declare, to rows that are not all there."""
    customers = _rows(spark, sf, "customer", "c_custkey").withColumn("_deleted", F.col("c_nationkey") >= 12)
    q = Query(ORDERS).scope(o_orderstatus="P").related("owner", one("customer", "customer_id"))
    return q.to_df({"orders": _orders(spark, sf), "customer": customers}).select("o_orderkey", "owner.c_name")


@_query("SELECT o_orderkey, c_name, position FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, CAST(o_orderkey AS VARCHAR)) AS position FROM orders WHERE o_orderstatus = 'O') LEFT JOIN customer ON c_custkey = o_custkey WHERE position <= 40")
def rel_ordered(spark, sf):
    """A limited plan with a relation comes in its order: rows are numbered as they arrive."""
    frames = {"orders": _orders(spark, sf), "customer": _rows(spark, sf, "customer", "c_custkey")}
    got = Query(ORDERS).scope(o_orderstatus="O").order("o_totalprice", "desc").limit(40).with_("customer").to_df(frames)
    return got.select("o_orderkey", "customer.c_name").coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1)


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS _id, CASE WHEN o_orderkey % 5 = 0 THEN 'delete' ELSE 'upsert' END AS kind FROM orders WHERE o_orderkey % 5 IN (0, 1, 2)")
def row_deltas(spark, sf):
    """Old: without remainder 1; new: without remainder 0, and another priority at remainder 2."""
    o = _orders(spark, sf).select("_id", "o_orderkey", "o_orderpriority")
    new = o.filter("o_orderkey % 5 <> 0").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 2, "changed").otherwise(F.col("o_orderpriority")))
    return view.row_deltas(o.filter("o_orderkey % 5 <> 1"), new).select("_id", "kind")


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS op_id, CASE o_orderkey % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'patch' ELSE 'insert' END AS kind, CASE WHEN o_orderkey % 3 = 2 THEN '{\"o_custkey\":' || o_custkey || ',\"o_orderpriority\":\"' || o_orderpriority || '\"}' END AS value, CASE WHEN o_orderkey % 3 = 1 THEN '{\"o_orderpriority\":\"' || o_orderpriority || '\"}' END AS patch FROM orders")
def inverse_operations(spark, sf):
    table = TableDef("orders", schema(o_custkey="bigint", o_orderpriority="string"))
    o = _orders(spark, sf).select("_id", "o_orderkey", "o_custkey", "o_orderpriority", F.lit(False).alias("_deleted"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "insert").when(F.col("o_orderkey") % 3 == 1, "patch").otherwise("delete")
    ops = o.select(F.col("_id").alias("op_id"), F.col("_id").alias("id"), kind.alias("kind"), F.lit(None).cast("string").alias("value"), F.when(kind == "patch", F.lit('{"o_orderpriority":"new"}')).alias("patch"))
    return view.inverse_operations(table, ops, o.filter("o_orderkey % 3 <> 0")).select("op_id", "kind", "value", "patch")


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'insert' ELSE 'patch' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN 'delete' ELSE 'patch' END AS counter FROM orders WHERE o_orderkey % 4 <> 3")
def undo_entries(spark, sf):
    """Entries restore a row (remainder 0, gone now) or a column; at remainder 3 the row to patch is gone and is left alone."""
    table = TableDef("orders", schema(o_orderpriority="string"))
    o = _orders(spark, sf).select("_id", "o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 4).isin(0, 3).alias("_deleted"))
    back = F.col("o_orderkey") % 4 == 0
    entries = o.select(F.col("_id").alias("unit"), F.lit(1).alias("position"), F.col("_id").alias("op_id"), F.col("_id").alias("id"), F.when(back, "insert").otherwise("patch").alias("kind"), F.when(back, F.lit('{"o_orderpriority":"old"}')).alias("value"), F.when(~back, F.lit('{"o_orderpriority":"old"}')).alias("patch"))
    ops, counter = view.undo(table, entries, o)
    both = ops.select("op_id", "kind").join(counter.select("op_id", F.col("kind").alias("counter")), "op_id")
    return both.select(F.col("op_id").cast("bigint").alias("o_orderkey"), "kind", "counter")


@_query("SELECT event_type AS scope_key, event_id FROM events WHERE event_type = 'click'")
def redo_cleared(spark, sf):
    """New actions in all scopes but one clear the redo entries of these."""
    redo = _read(spark, sf, "events").select(F.col("event_type").alias("scope_key"), "event_id")
    return view.after_new_action(redo, redo.filter("scope_key <> 'click'").select("scope_key"))


@_query("SELECT event_id FROM events WHERE event_id % 4 <> 0")
def confirmed_dropped(spark, sf):
    ops = _read(spark, sf, "events").select("event_id", F.concat(F.lit("op"), "event_id").alias("op_id"))
    return view.confirmed(ops, _event_log(spark, sf).filter("(cast(change_id as bigint) - 1) % 4 = 0")).select("event_id")


@_query("SELECT event_id, floor(before / 500) AS chunk FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id) AS lead, user_id FROM events) JOIN (SELECT user_id, sum(n) OVER (ORDER BY lead) - n AS before FROM (SELECT user_id, min(event_id) AS lead, count(*) AS n FROM events GROUP BY user_id)) USING (user_id)")
def push_chunks(spark, sf):
    ops = _read(spark, sf, "events").select(F.lit("w").alias("scope_key"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("op_id"), F.col("user_id").cast("string").alias("group_id"))
    return log.chunks(ops, 500).select(F.col("seq").alias("event_id"), F.col("chunk").cast("double").alias("chunk"))


@_query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND event_id % 3 < 2")
def schema_retired(spark, sf):
    ops = _read(spark, sf, "events").select("event_id", F.when(F.col("event_type").isin("click", "view"), "pending").otherwise("acked").alias("status"), (F.col("event_id") % 3).cast("int").alias("schema_version"))
    return log.retired(ops, 2).select("event_id")


@_query("SELECT count(*) FILTER (event_type IN ('click', 'view')) AS n FROM events")
def pending_operations(spark, sf):
    return log.pending_count(_read(spark, sf, "events").select(F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "pushing").otherwise("acked").alias("status")))


@_query("SELECT event_type AS name, count(*) AS n, CAST(NULL AS BIGINT) AS bytes FROM events GROUP BY 1 UNION ALL SELECT 'blobs', count(*), CAST(sum(strlen(html)) AS BIGINT) FROM pages")
def storage_stats(spark, sf):
    rows = _read(spark, sf, "events").select(F.col("event_type").alias("_table"))
    return log.storage_stats(rows, _read(spark, sf, "pages").select(F.encode("html", "utf-8").alias("data")))


@_query("SELECT CAST(user_id AS VARCHAR) AS doc, count(DISTINCT event_type) AS updates FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 5")
def compaction_due(spark, sf):
    docs = _read(spark, sf, "events").select(F.col("user_id").cast("string").alias("doc"), F.col("event_type").alias("id"), F.col("event_type").alias("update"))
    return log.needs_compaction(docs, 5, 1 << 30).select("doc", "updates")


@_query("SELECT coalesce(s.event_type, t.event_type) AS scope_key, lpad(CAST(s.last AS VARCHAR), 12, '0') AS \"cursor\", t.pending, t.rejected FROM (SELECT event_type, max(event_id) AS last FROM events WHERE event_type <> 'error' GROUP BY 1) s FULL JOIN (SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS pending, count(*) FILTER (event_id % 3 = 1) AS rejected FROM events GROUP BY 1) t USING (event_type)")
def scope_states(spark, sf):
    e = _read(spark, sf, "events").select(F.col("event_type").alias("scope_key"), "event_id")
    cursors = e.filter("scope_key <> 'error'").groupBy("scope_key").agg(keys.change_id(F.max("event_id")).alias("cursor"))
    ops = e.select("scope_key", F.when(F.col("event_id") % 3 == 0, "pending").when(F.col("event_id") % 3 == 1, "rejected").otherwise("acked").alias("status"))
    return log.scope_states(cursors, spark.createDataFrame([], "scope_key string, role int"), ops).select("scope_key", "cursor", "pending", "rejected")


@_query("SELECT event_id, CAST(1000 + row_number() OVER (ORDER BY event_id) AS DOUBLE) AS created_at FROM events WHERE event_type = 'error'")
def monotonic_stamps(spark, sf):
    """The clock is behind the high-water mark."""
    ops = _read(spark, sf, "events").filter("event_type = 'error'").select(F.col("event_id").alias("seq"))
    return log.stamped(ops, 1000.0, 10.0).select(F.col("seq").alias("event_id"), "created_at")


@_query("SELECT event_id, 'c_' || lpad(printf('%x', epoch_us(ts) // 1000), 12, '0') || '_' || lpad(printf('%x', event_id), 8, '0') AS head, true AS sorted FROM events")
def sortable_ids(spark, sf):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    made = log.sortable_ids("c", at, F.col("event_id"), F.col("user_id"))
    head = F.substring_index(made, "_", 3)
    return _read(spark, sf, "events").select("event_id", head.alias("head"), (made > head).alias("sorted"))


@_query("SELECT c_custkey, 'u:' || c_custkey AS owner_key, 'byWorkspace:' || c_name AS scope_key, 'byWorkspace' AS kind, c_name AS value, 'customer:' || c_custkey AS row_key, c_custkey AS number FROM customer")
def key_parts(spark, sf):
    whole = keys.scope_key("byWorkspace", F.col("c_name"))
    number = keys.change_number(keys.change_id(F.col("c_custkey")))
    return _read(spark, sf, "customer").select("c_custkey", keys.scope_key("byUser", F.col("c_custkey").cast("string")).alias("owner_key"), whole.alias("scope_key"), keys.scope_kind(whole).alias("kind"), keys.scope_value(whole).alias("value"), keys.row_key(F.lit("customer"), F.col("c_custkey")).alias("row_key"), number.alias("number"))


@_query("SELECT p_partkey, true AS above, true AS below FROM part")
def rank_between(spark, sf):
    """A rank strictly between two made from the part's key."""
    low, high = F.concat(F.lit("a"), F.format_string("%08d", "p_partkey"), F.lit("1")), F.concat(F.lit("a"), F.format_string("%08d", "p_partkey"), F.lit("2"))
    made = ranks.rank_between_column(low, high)
    rows = _read(spark, sf, "part").select("p_partkey").repartition(spark.sparkContext.defaultParallelism, "p_partkey")  # a small file is one task
    return rows.select("p_partkey", (made > low).alias("above"), (made < high).alias("below"))


@_query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 7 = 3")
def where_function(spark, sf):
    """An opaque Python predicate, and one more as an expression."""
    table = TableDef("part", schema(p_partkey="bigint", p_name="string"))
    rows = _rows(spark, sf, "part", "p_partkey").select("_id", "p_partkey", "p_name")
    return Query(table).where(lambda r: r["p_partkey"] % 7 == 3).where(F.col("p_name").isNotNull()).to_df({"part": rows}).select("p_partkey", "p_name")


@_query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def database_get(spark, sf):
    rows = _orders(spark, sf)
    first = rows.agg(F.min("o_orderkey")).first()[0]
    return Database(Manifest(1, [ORDERS]), {"orders": rows}).get("orders", str(first)).select("o_orderkey", "o_orderpriority")


@_query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def named_query(spark, sf):
    """A registered function over the tables, which sees only the rows of the scope it is called with."""
    m = Manifest(1, [ORDERS])
    m.query("byPriority", lambda held, o_orderstatus: held["orders"].groupBy("o_orderpriority").agg(F.count("*").alias("n")))
    return Database(m, {"orders": _orders(spark, sf)}).call("byPriority", o_orderstatus="F")


@_query("SELECT event_id, value FROM events WHERE user_id = 3 AND event_type = 'click'")
def server_indexed_rows(spark, sf):
    table = TableDef("events", schema(event_id="bigint", user_id="string", event_type="string", value="double"), by_user("user_id"), indexes={"byType": ("user_id", "event_type", "value")})
    rows = _rows(spark, sf, "events", "event_id").withColumn("user_id", F.col("user_id").cast("string"))
    return server_indexed(table, rows, "byType", ["3", "click"], "3").select("event_id", "value")


@_query("SELECT o_orderkey FROM orders WHERE false")
def filter_malformed(spark, sf):
    """Filters from text: a bad one is an error with its place; as a condition it matches nothing."""
    spec, error = parse_filter('{"o_orderpriority": {"like": "x"}}')
    assert spec is None and error.code == "invalid_operator"
    q = Query(ORDERS).scope(o_orderstatus="O").filter({"o_orderpriority": {"like": "x"}})
    return q.to_df({"orders": _orders(spark, sf)}).select("o_orderkey")


@_query("SELECT coalesce(CAST(toxic AS VARCHAR), 'none') AS key, count(*) AS n FROM (SELECT d.doc_id, max(l.toxic) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id) GROUP BY 1")
def counts_null_key(spark, sf):
    from .queries import _labelled

    return Query(LABELLED).group_by("toxic").counts({"documents": _labelled(spark, sf)}, null_key="none")


@_query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '{\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || '}' ELSE '{\"c_name\":\"' || c_name || '\"}' END AS value FROM customer")
def declared_insert(spark, sf):
    """Calls of a declared insert: only arguments that were given, and that a client may set, are in the row."""
    m = mutations.Mutation(CUSTOMER, "insert", ("c_name", "c_nationkey"))
    args = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct("c_name", "c_nationkey", F.lit(1).alias("extra")))).otherwise(F.to_json(F.struct("c_name")))
    calls = _read(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.lit("o").alias("op_id"), F.lit("u").alias("user_id"), F.col("c_custkey").cast("string").alias("local_id"), args.alias("args"), F.lit(1.0).alias("now"))
    return m.operations(calls, "add").select(F.col("id").cast("bigint").alias("c_custkey"), "value")


@_query("SELECT c_custkey, '{\"c_name\":\"' || c_name || '!\"}' AS patch FROM customer")
def declared_patch(spark, sf):
    """Calls of a declared patch whose columns and row a generator makes."""
    m = mutations.Mutation(CUSTOMER, "patch", ("c_name",), patch=lambda c: {"c_name": F.concat(c.arg("c_name"), F.lit("!"))}, row_id=lambda c: c.local_id)
    calls = _read(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.lit("o").alias("op_id"), F.lit("u").alias("user_id"), F.col("c_custkey").cast("string").alias("local_id"), F.to_json(F.struct("c_name")).alias("args"), F.lit(1.0).alias("now"))
    return m.operations(calls, "rename").select(F.col("id").cast("bigint").alias("c_custkey"), "patch")


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0")
def store_live(spark, sf):
    """Rows kept in a store, a third of them deleted by the log since; a cleared store fences an older writer."""
    store, table = Store(spark, work_path(spark, "store")), TableDef("customer", schema(c_custkey="bigint", c_name="string"))
    c = _read(spark, sf, "customer")
    body = c.select(F.lit("w").alias("scope_key"), keys.change_id(F.col("c_custkey")).alias("change_id"), F.lit("customer").alias("table"), F.col("c_custkey").cast("string").alias("id"), F.lit("insert").alias("kind"), F.to_json(F.struct("c_custkey", "c_name")).alias("value"), F.lit(None).cast("string").alias("patch"), F.lit(1).cast("long").alias("version"), F.lit(0.0).alias("server_time"), F.lit(None).cast("string").alias("op_id"))
    old = store.epoch()
    store.clear()
    assert not store.apply_changes(table, body, expected_epoch=old)
    store.apply_changes(table, body)
    gone = body.filter(F.col("id").cast("bigint") % 3 == 0).withColumns({"kind": F.lit("delete"), "value": F.lit(None).cast("string"), "version": F.lit(2).cast("long")})
    store.apply_changes(table, gone)
    return store.live(table).filter("not _deleted").select("c_custkey", "c_name")


@_query("SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens FROM (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_extract_all(lower(CASE WHEN doc_id % 10 = 1 THEN 'changed text' ELSE text END), '[\\p{L}\\p{N}]+')) AS token FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+')) FROM documents WHERE doc_id % 10 <> 0)) GROUP BY doc_id")
def search_index_update(spark, sf):
    """Postings after a tenth of the rows went and a tenth changed."""
    rows = _rows(spark, sf, "documents", "doc_id").select("_id", "doc_id", "text", "source", F.lit(False).alias("_deleted"))
    changed = rows.filter("doc_id % 10 < 2").withColumns({"_deleted": F.col("doc_id") % 10 == 0, "text": F.lit("changed text")})
    got = search.update_index(LABELLED, search.index(LABELLED, rows), changed)
    return got.groupBy(F.col("id").cast("bigint").alias("doc_id")).agg(F.count("*").alias("n_tokens"))


@_query("SELECT source, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) AS rank FROM documents) WHERE rank <= 3")
def search_top_per_scope(spark, sf):
    found = _read(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("id"), F.lit(1).alias("score"), F.col("n_chars").cast("double").alias("recency"))
    return search.top_per_scope(found, "source", 3).select("source", F.col("id").cast("bigint").alias("doc_id"), "rank")


_HTML_SQL = "regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&([a-zA-Z]+|#[0-9]+);', ' ', 'g')"
_HTML_TOKENS_SQL = f"regexp_extract_all(lower(CASE WHEN regexp_matches(html, '<[a-zA-Z!/][^>]*>') THEN {_HTML_SQL} ELSE html END), '[\\p{{L}}\\p{{N}}]+')"


@_query(f"SELECT page_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT page_id, {_HTML_TOKENS_SQL} AS t FROM pages)")
def html_strip_tokens(spark, sf):
    """All tokens of a page, as their number and a digest of them."""
    t = tokenize(F.col("html"))
    return _read(spark, sf, "pages").select("page_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity >= 49")
def explained_plan(spark, sf):
    """A plan whose conditions Spark pushes to the files, as explain() shows."""
    rows = _read(spark, sf, "lineitem").withColumn("_id", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    q = Query(LINES).filter({"l_returnflag": "N", "l_linestatus": "O", "l_quantity": {"gte": 49}})
    assert any("l_quantity" in p for p in q.explain({"lineitem": rows})["pushed"])
    return q.to_df({"lineitem": rows}).select("l_orderkey", "l_linenumber")


@_query("SELECT doc_id, CASE WHEN quality IS NULL THEN '{\"quality\":null}' ELSE '{\"quality\":' || quality || '}' END AS patch FROM (SELECT d.doc_id, max(l.quality) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)")
def json_nulls(spark, sf):
    """A null in a patch is not an absent field."""
    from .queries import _labelled

    return _labelled(spark, sf).select("doc_id", json.json_object([("quality", F.lit(True), json.json_value(F.col("quality"))), ("lang", F.lit(False), F.lit(""))]).alias("patch"))


__all__ = ["QUERIES"]
