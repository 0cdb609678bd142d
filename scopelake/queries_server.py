"""Registered queries over pushes of several users, groups, and stores, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import codec, keys
from .operators import attachments, documents, log, push, search, view
from .plans.catalog import TableDef, by_user, by_workspace
from .plans.mutations import Mutation, Plan, Step, functions
from .plans.query import Query, schema
from .queries import _TOKENS_SQL, ORDERS, _orders, _query, _read, _rows, _search_sql
from .sources import segments
from .sources.shared import work_path
from .sources.store import CHANGES, LEDGER, Store
from .streaming import live

NOTES = TableDef("notes", schema(owner="string", n="bigint"), by_user("owner"), counter_fields=("n",))
NOTE_FUNCTIONS = {"add": ("insert", ("n",)), "edit": ("patch", ("n",)), "drop": ("delete", ())}


def _ops(rows: DataFrame, user, fn, row, n, group=None) -> DataFrame:
    """events as operations: n is the value of inserts, and what counters of patches add."""
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("event_id").alias("seq"), user.alias("user_id"), F.lit(1).alias("schema_version"), fn.alias("function_name"), row.alias("id"), F.when(fn == "add", F.to_json(F.struct(n.alias("n"), F.lit("nobody").alias("owner")))).alias("value"),
        F.when(fn == "edit", F.format_string('{"n":{"__lfCounter":%d}}', n)).alias("patch"), (none if group is None else group).alias("group_id"), *(c for c in rows.columns if c not in ("value", "user_id")),
    )


def _no_rows(spark, table: TableDef) -> DataFrame:
    return spark.createDataFrame([], Store.row_schema(table))


def _pushed(spark, table, ops, scope, **how) -> push.Push:
    return push.push(table, ops, _no_rows(spark, table), spark.createDataFrame([], CHANGES), spark.createDataFrame([], LEDGER), NOTE_FUNCTIONS, 1, 5.0, scope, **how)


#: Pairs of events: the first of a pair inserts a note; the second, of another user and by the same op_id, edits that note or adds its own.
_PAIRS = "(SELECT event_id, event_id // 2 AS pair, event_id % 2 AS user, event_type FROM events)"


@_query(
    f"""SELECT event_id, CASE WHEN user = 1 AND event_type = 'click' THEN 'Cannot patch notes:p' || pair END AS error, CASE WHEN user = 0 OR event_type <> 'click' THEN 'u' || user END AS owner,
 CASE WHEN user = 0 OR event_type <> 'click' THEN event_id END AS n FROM {_PAIRS}"""
)
def push_two_users(spark, sf):
    """Two users share op_ids; inserts belong to their sender though they name another; another's note cannot be edited."""
    e = _read(spark, sf, "events").withColumn("pair", F.floor(F.col("event_id") / 2))
    second = F.col("event_id") % 2 == 1
    edits = second & (F.col("event_type") == "click")
    row = F.concat(F.when(second & ~edits, "q").otherwise("p"), F.col("pair").cast("string"))
    ops = _ops(e, F.concat(F.lit("u"), F.col("event_id") % 2), F.when(edits, "edit").otherwise("add"), row, F.col("event_id")).withColumn("op_id", F.col("pair").cast("string"))
    made = _pushed(spark, NOTES, ops, F.concat(F.lit("u:"), "user_id"))
    row = F.from_json("value", "owner string, n bigint")
    changes = made.done.select("user_id", "op_id", row["owner"].alias("owner"), row["n"].alias("n"))
    got = made.answers.join(changes, ["user_id", "op_id"], "left")
    number = 2 * F.col("op_id").cast("bigint") + F.substring("user_id", 2, 1).cast("bigint")
    return got.select(number.alias("event_id"), "error", "owner", "n")


#: Four events are a group: insert its note; count on it; count on the note of the group before, but for each fifth group; and an error drops what was never there.
_GROUPS = """(SELECT *, coalesce(bool_or(bad) OVER (PARTITION BY g // 5 ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS broken
 FROM (SELECT event_id // 4 AS g, bool_or(event_type = 'error') AS bad, min(CASE WHEN event_type = 'error' THEN event_id END) AS first_bad, count(*) AS size FROM events GROUP BY 1))"""
_GROUP_REASON = "CASE WHEN broken AND size > 2 AND (first_bad IS NULL OR first_bad > 4 * g + 2) THEN 'groupRejected: Cannot patch notes:g' || (g - 1) WHEN bad THEN 'groupRejected: Cannot delete notes:x' || first_bad END"


@_query(f"SELECT e.event_id, {_GROUP_REASON} AS reject_reason FROM events e JOIN {_GROUPS} ON g = e.event_id // 4")
def push_groups(spark, sf):
    """Groups that count on each other's notes: one that is rejected takes those after it along, up to the next fifth."""
    e = _read(spark, sf, "events").withColumn("g", F.floor(F.col("event_id") / 4))
    part, error = F.col("event_id") % 4, F.col("event_type") == "error"
    back = (part == 2) & (F.col("g") % 5 != 0)
    fn = F.when(error, "drop").when(part == 0, "add").otherwise("edit")
    row = F.when(error, F.concat(F.lit("x"), "event_id")).otherwise(F.concat(F.lit("g"), F.when(back, F.col("g") - 1).otherwise(F.col("g")).cast("string")))
    ops = _ops(e, F.lit("u"), fn, row, F.col("event_id"), F.concat(F.lit("G"), F.col("g").cast("string"))).withColumn("op_id", F.col("event_id").cast("string"))
    return log.validate(NOTES, ops, _no_rows(spark, NOTES), NOTE_FUNCTIONS, 1).select("event_id", "reject_reason")


PAGES = TableDef("notes", schema(ws="string", n="bigint"), by_workspace("ws"))


@_query("SELECT event_id, CASE WHEN user_id % 4 = 3 THEN 'Not a member of ' || event_type WHEN user_id % 4 = 2 THEN 'Cannot insert notes:' || event_id END AS error FROM events")
def push_roles(spark, sf):
    """Workspaces by event type: of four users one has no role there and one may only read."""
    e = _read(spark, sf, "events")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    ops = _ops(e, user, F.lit("add"), F.col("event_id").cast("string"), F.col("event_id"))
    ops = ops.withColumns({"op_id": F.col("event_id").cast("string"), "value": F.to_json(F.struct(F.col("event_type").alias("ws"), F.col("event_id").alias("n")))})
    roles = e.filter("user_id % 4 < 3").select(user.alias("user_id"), F.col("event_type").alias("scope_value"), (F.col("user_id") % 4).cast("int").alias("role")).distinct()
    functions = {"add": ("insert", ("ws", "n"))}
    got = log.validate(PAGES, ops, _no_rows(spark, PAGES), functions, 1, roles, lambda r: r < 2)
    return got.select("event_id", F.col("reject_reason").alias("error"))


STAMPED = TableDef("notes", schema(owner="string", n="bigint", number="bigint"), by_user("owner"), server_fields=("number",))


@_query("SELECT event_id, number, 'u' || user_id AS owner FROM (SELECT *, 500 + row_number() OVER (ORDER BY event_id) AS number FROM events)")
def push_stamps(spark, sf):
    """Inserts get the next server-made numbers, in the order of the push."""
    e = _read(spark, sf, "events")
    ops = _ops(e, F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("add"), F.col("event_id").cast("string"), F.col("event_id")).withColumn("op_id", F.col("event_id").cast("string"))
    made = _pushed(spark, STAMPED, ops, F.lit("w"), stamps={"number": 500})
    row = F.from_json("value", "owner string, number bigint")
    return made.changes.select(F.col("id").cast("bigint").alias("event_id"), row["number"].alias("number"), row["owner"].alias("owner"))


def _two_pushes(spark, sf, name: str) -> tuple[Store, push.Push, push.Push, DataFrame]:
    """A store after two pushes by user: events before the middle add or count, then the others do."""
    e = _read(spark, sf, "events")
    e = e.withColumn("half", F.col("event_id") % 2)
    fn = F.when(F.col("event_type") == "error", "drop").when(F.col("event_type") == "click", "edit").otherwise("add")
    ops = _ops(e, F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")), fn, F.col("user_id").cast("string"), F.col("event_id") % 5).withColumn("op_id", F.col("event_id").cast("string"))
    store, made = Store(spark, work_path(spark, name)), []
    for half in range(2):
        base = store.version()
        made.append(push.push(NOTES, ops.filter(F.col("half") == half), store.canonical(NOTES), store.known(), store.ledger(), NOTE_FUNCTIONS, 1, 5.0 + half, F.concat(F.lit("u:"), "user_id")))
        store.commit(NOTES, made[-1], base=base)
    return store, *made, ops


_HALVES = "(SELECT *, event_id % 2 AS half, CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'patch' ELSE 'insert' END AS kind FROM events)"
_HALF_STATE = f"""(SELECT *, coalesce(last_value(CASE kind WHEN 'insert' THEN true WHEN 'delete' THEN false END IGNORE NULLS) OVER w, false) AS live, coalesce(bool_or(kind = 'insert') OVER w, false) AS seen
 FROM {_HALVES} WINDOW w AS (PARTITION BY user_id ORDER BY half, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_HALF_FINE = "(kind = 'insert' AND NOT live) OR (kind = 'patch' AND live) OR (kind = 'delete' AND seen)"
_HALF_TAKEN = f"(SELECT * FROM {_HALF_STATE} WHERE (kind = 'insert' AND NOT live) OR (kind <> 'insert' AND live))"


@_query(f"SELECT event_id, 'u:u' || (user_id % 10) AS scope_key, lpad(CAST(row_number() OVER (PARTITION BY user_id % 10 ORDER BY half, event_id) AS VARCHAR), 12, '0') AS change_id, row_number() OVER (PARTITION BY user_id ORDER BY half, event_id) AS version FROM {_HALF_TAKEN}")
def append_known(spark, sf):
    """Two pushes into one store: the second goes on counting where the kept state of the first ends, and rewrites nothing."""
    store, *_ = _two_pushes(spark, sf, "append")
    return store.log().select(F.col("op_id").cast("bigint").alias("event_id"), "scope_key", "change_id", "version")


@_query(f"SELECT CAST(user_id AS VARCHAR) AS id, max(version) AS version, 'u:u' || (user_id % 10) AS scope_key FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY half, event_id) AS version FROM {_HALF_TAKEN}) GROUP BY user_id")
def row_versions(spark, sf):
    """Version and scope of each row as the store keeps them."""
    store, *_ = _two_pushes(spark, sf, "versions")
    return store.known().rows.select("id", "version", "scope_key")


@_query(f"SELECT event_id, kind, 'u' || (user_id % 10) AS user_id, kind <> 'insert' AS had, kind <> 'delete' AS has FROM {_HALF_TAKEN}")
def write_feed(spark, sf):
    """Everything that accepted pushes wrote, once each though a batch is committed twice."""
    store, first, _, _ = _two_pushes(spark, sf, "feed")
    store.mark("again")
    assert not store.commit(NOTES, first, batch="again")
    return store.feed(NOTES).select(F.col("op_id").cast("bigint").alias("event_id"), "kind", "user_id", F.col("before").isNotNull().alias("had"), F.col("after").isNotNull().alias("has"))


@_query(f"SELECT event_id, CASE WHEN {_HALF_FINE} THEN 'accepted' ELSE 'rejected' END AS outcome, change_id, version FROM {_HALF_STATE} LEFT JOIN (SELECT event_id, lpad(CAST(row_number() OVER (PARTITION BY user_id % 10 ORDER BY half, event_id) AS VARCHAR), 12, '0') AS change_id, row_number() OVER (PARTITION BY user_id ORDER BY half, event_id) AS version FROM {_HALF_TAKEN}) USING (event_id)")
def ledger_changes(spark, sf):
    """All operations sent again after the log was collected: answered as before, with the changes they made then."""
    store, _, _, ops = _two_pushes(spark, sf, "replay")
    store.prune(100.0)
    again = push.push(NOTES, ops, store.canonical(NOTES), store.known(), store.ledger(), NOTE_FUNCTIONS, 1, 9.0, F.lit("w"))
    assert again.changes.limit(1).count() == 0
    changes = again.redelivered.select("op_id", "change_id", "version")
    return again.answers.join(changes, "op_id", "left").select(F.col("op_id").cast("bigint").alias("event_id"), "outcome", "change_id", "version")


@_query("SELECT event_type AS scope_key, event_id FROM (SELECT *, max(event_id) OVER (PARTITION BY event_type) AS last, max(event_id) OVER (PARTITION BY event_id // 4096) AS part_last FROM events) WHERE part_last >= 3000 OR event_id = last")
def log_pruned(spark, sf):
    """A log in parts, the old ones collected but for the newest change of each scope."""
    store = Store(spark, work_path(spark, "prune"))
    e = _read(spark, sf, "events")
    changes = e.select(
        F.col("event_type").alias("scope_key"), keys.change_id(F.col("event_id") + 1).alias("change_id"), F.lit("t").alias("table"), F.col("event_id").cast("string").alias("id"), F.lit("insert").alias("kind"), F.lit("{}").alias("value"), F.lit(None).cast("string").alias("patch"),
        F.lit(1).cast("long").alias("version"), F.col("event_id").cast("double").alias("server_time"), F.lit(None).cast("string").alias("op_id"),
    )
    changes, part = changes.filter("server_time is not null"), F.floor(F.col("server_time") / 4096)
    store.replace_all({"heads#all": log.Known.of(changes).heads}, None, lambda: store.stage_parts("log", changes, part))
    store.prune(3000.0)
    return store.log().select("scope_key", F.col("id").cast("bigint").alias("event_id"))


def _changed_orders(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders before, after and the deltas: a tenth goes, a tenth costs more and has another status, a tenth is new."""
    o = _orders(spark, sf)
    moved = F.col("o_orderkey") % 10 == 1
    after = o.filter("o_orderkey % 10 <> 0").withColumns({"o_totalprice": F.when(moved, F.col("o_totalprice") + 1000).otherwise(F.col("o_totalprice")), "o_orderstatus": F.when(moved, "O").otherwise(F.col("o_orderstatus"))})
    before = o.filter("o_orderkey % 10 <> 2")
    return before, after, view.row_deltas(before, after)


_AFTER_SQL = "(SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 10 = 1 THEN o_totalprice + 1000 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 10 = 1 THEN 'O' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 10 <> 0)"


@_query(f"SELECT o_orderkey, price, position FROM (SELECT *, row_number() OVER (ORDER BY price DESC, CAST(o_orderkey AS VARCHAR)) AS position FROM {_AFTER_SQL} WHERE status = 'O') WHERE position <= 50")
def live_topk(spark, sf):
    """The dearest orders, kept up to date in ranges of the price: places of orders that went are filled."""
    before, _, deltas = _changed_orders(spark, sf)
    held = live.LiveQuery(Store(spark, work_path(spark, "views")), "dear", Query(ORDERS).scope(o_orderstatus="O").order("o_totalprice", "desc").limit(50), range_rows=2000)
    held.reset(before)
    held.apply(deltas)
    return held.result().select("o_orderkey", F.col("o_totalprice").alias("price")).coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1)


@_query(f"SELECT o_orderkey, o_orderpriority AS key, row_number() OVER (PARTITION BY o_orderpriority ORDER BY price, CAST(o_orderkey AS VARCHAR)) AS position FROM {_AFTER_SQL} WHERE status = 'F'")
def live_groups(spark, sf):
    """Orders by priority, in order of price within each group, after deltas."""
    before, _, deltas = _changed_orders(spark, sf)
    held = live.LiveQuery(Store(spark, work_path(spark, "views")), "groups", Query(ORDERS).scope(o_orderstatus="F").group_by("o_orderpriority").order("o_totalprice"), range_rows=2000)
    held.reset(before)
    held.apply(deltas)
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "_id"))
    return held.result().select("o_orderkey", F.col("o_orderpriority").alias("key"), place.alias("position"))


@_query(f"SELECT o_orderpriority AS key, count(*) AS n FROM {_AFTER_SQL} WHERE status = 'O' GROUP BY 1")
def live_counts(spark, sf):
    """Counts by priority: a sum of signed contributions, to which the deltas added theirs."""
    before, _, deltas = _changed_orders(spark, sf)
    held = live.LiveCounts(Store(spark, work_path(spark, "counts")), "orders", Query(ORDERS).scope(o_orderstatus="O").group_by("o_orderpriority"))
    held.reset(before)
    held.apply(deltas)
    return held.result()


def _segmented(spark, sf) -> tuple[Store, DataFrame]:
    """Postings of all documents, then of an eighth that changed and an eighth that went, each in a segment of its own."""
    rows = _rows(spark, sf, "documents", "doc_id").select("_id", "doc_id", "text", "source", F.lit(False).alias("_deleted"))
    store, past = Store(spark, work_path(spark, "segments")), rows
    segments.add_segment(store, _DOCS, search.index(_DOCS, search.sliced(rows)), rows.select(F.col("_id").alias("id")))
    for now in (rows.withColumn("text", F.when(F.col("doc_id") % 8 == 1, "license of the changed text").otherwise(F.col("text"))), rows.filter("doc_id % 8 <> 2").withColumn("text", F.when(F.col("doc_id") % 8 == 1, "license of the changed text").otherwise(F.col("text")))):
        live.reindex(store, _DOCS, view.row_deltas(past, now))
        past = now
    return store, past


_DOCS = TableDef("documents", schema(doc_id="bigint", text="string", source="string"), search_fields=("text", "source"))
_SEGMENT_SQL = _search_sql("licens", ["the"]).replace("FROM documents WHERE true", "FROM (SELECT doc_id, source, CASE WHEN doc_id % 8 = 1 THEN 'license of the changed text' ELSE text END AS text FROM documents WHERE doc_id % 8 <> 2)")


@_query(_SEGMENT_SQL)
def search_segments(spark, sf):
    """A search over three segments: what the latest says of a row holds."""
    store, rows = _segmented(spark, sf)
    found = search.search(_DOCS, rows, segments.postings(store, _DOCS), "the licens")
    return found.select(F.col("id").cast("bigint").alias("doc_id"), F.col("score").cast("long").alias("score"), "total")


@_query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens FROM (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest({_TOKENS_SQL.format('text')}) AS token FROM (SELECT doc_id, CASE WHEN doc_id % 8 = 1 THEN 'license of the changed text' ELSE text END AS text FROM documents WHERE doc_id % 8 <> 2) UNION ALL SELECT doc_id, unnest({_TOKENS_SQL.format('source')}) FROM documents WHERE doc_id % 8 <> 2)) GROUP BY doc_id")
def search_merged(spark, sf):
    """The same segments after they were merged into one."""
    store, _ = _segmented(spark, sf)
    assert segments.merge(store, _DOCS)
    return segments.postings(store, _DOCS).groupBy(F.col("id").cast("bigint").alias("doc_id")).agg(F.count("*").alias("n_tokens"))


@_query("SELECT CAST(user_id AS VARCHAR) AS doc, CAST(event_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN big AND event_id % 7 <> 0 THEN 0 ELSE 1 END, lpad(CAST(event_id AS VARCHAR), 12, '0')) AS position FROM (SELECT *, sum(CASE WHEN event_id % 7 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) > 5 AS big FROM events)")
def document_log(spark, sf):
    """Events as updates of documents by user: those with more than five confirmed ones are put into a snapshot, in the order
    of their log, and what is not confirmed stays behind it."""
    e = _read(spark, sf, "events")
    updates = e.select(F.col("user_id").cast("string").alias("doc"), keys.change_id(F.col("event_id")).alias("id"), F.encode(F.col("event_id").cast("string"), "utf-8").alias("update"), (F.col("event_id") % 7 != 0).alias("confirmed"), F.lit(None).cast("array<string>").alias("covers"))
    big = updates.filter("confirmed").groupBy("doc").count().filter("count > 5")
    made = documents.snapshots(updates, big, F.lit("!"))
    left = documents.prune(updates.unionByName(made.withColumn("confirmed", F.lit(True))))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("id", "place"))
    return documents.unfolded(left).select("doc", F.decode("update", "utf-8").alias("id"), place.alias("position"))


_FILES = TableDef("files", schema(owner="string", storageId="string"), by_user("owner"))


@_query("SELECT event_id, user_id % 5 <> 0 AND event_type <> 'error' AS ok, CASE WHEN user_id % 5 <> 0 AND event_type NOT IN ('error', 'view') THEN 's' || event_id END AS storage_id FROM events")
def attachments_finalized(spark, sf):
    """Uploads of files: of others' files, of those that are gone, of those that carry the id already, and of the rest."""
    e = _read(spark, sf, "events")
    row, place = F.col("event_id").cast("string"), F.concat(F.lit("s"), "event_id")
    rows = e.select(row.alias("_id"), F.when(F.col("user_id") % 5 == 0, "other").otherwise(F.col("user_id").cast("string")).alias("owner"), F.when(F.col("event_type") == "view", place).alias("storageId"), F.lit(1).cast("long").alias("_version"), (F.col("event_type") == "error").alias("_deleted"))
    uploads = e.select(F.col("event_id").alias("seq"), row.alias("id"), place.alias("storage_id"), F.col("user_id").cast("string").alias("user_id"))
    answers, changes = attachments.finalize(_FILES, "storageId", uploads, rows, spark.createDataFrame([], CHANGES), 1.0, F.lit("w"))
    written = changes.select("id", F.get_json_object("patch", "$.storageId").alias("storage_id"))
    return answers.select("id", "ok").join(written, "id", "left").select(F.col("id").cast("bigint").alias("event_id"), "ok", "storage_id")


_LISTS = TableDef("lists", schema(owner="string", n="bigint"), by_user("owner"))
_ITEMS = TableDef("items", schema(owner="string", list="string"), by_user("owner"))
_WRITES = {"open": Mutation(_LISTS, "insert", ("n",)), "grow": Mutation(_LISTS, "patch", ("n",)), "put": Mutation(_ITEMS, "insert", ("list",))}


@_query("SELECT event_id, k AS group_index, CASE WHEN event_type = 'error' THEN 'groupRejected: Cannot patch lists:none' END AS error FROM events, (SELECT unnest([0, 1, 2]) AS k) WHERE k < 2 OR event_type IN ('error', 'click')")
def plan_groups(spark, sf):
    """Calls that open a list, put an item into it and, some of them, grow a list: of two tables, accepted or rejected whole."""

    def steps(c):
        kind = c.arg("kind")
        return [Step("open", c.local_id, {"n": F.lit(1)}), Step("put", F.concat(c.local_id, F.lit("/0")), {"list": c.local_id}), Step("grow", F.when(kind == "error", "none").otherwise(c.local_id), {"n": F.lit(2)}, when=kind.isin("error", "click"))]

    calls = _read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("op_id"), F.lit("u").alias("user_id"), F.concat(F.lit("l"), "event_id").alias("local_id"), F.to_json(F.struct(F.col("event_type").alias("kind"))).alias("args"), F.lit(1.0).alias("now"))
    ops = Plan(_WRITES, steps).operations(calls).withColumn("schema_version", F.lit(1))
    of = lambda t: {n: f for n, f in functions(_WRITES).items() if _WRITES[n].table is t}
    parts = [push.Part(t, _no_rows(spark, t), of(t)) for t in (_LISTS, _ITEMS)]
    made = push.push_all(parts, ops, spark.createDataFrame([], CHANGES), spark.createDataFrame([], LEDGER), 1, 5.0, F.concat(F.lit("u:"), "user_id"))
    name = F.split("op_id", ":")
    return made.answers.select(name[0].cast("bigint").alias("event_id"), name[1].cast("int").alias("group_index"), "error")


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, md5(l_comment) AS digest FROM (SELECT *, l_returnflag || l_linestatus AS l_comment FROM lineitem)")
def lossless_values(spark, sf):
    """Rows to text and back: integers, floats, times and bytes are what they were."""
    rows = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate", F.encode(F.concat("l_returnflag", "l_linestatus"), "utf-8").alias("raw"))
    back = codec.decode_rows(codec.encode_rows(rows), rows.schema)
    return back.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate", F.md5("raw").alias("digest"))
