"""Registered queries over outboxes, small stores, orders, ranks and registries, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import keys, ranks
from .operators import log, relations, search, view
from .plans import mutations
from .plans.catalog import Manifest, TableDef, by_user, many, one
from .plans.filters import parse_filter, serialize_filter
from .plans.query import Database, Query, schema
from .queries import CUSTOMER, LABELLED, LINES, ORDERS, _event_log, _labelled, _orders, _query, _read, _rows
from .sources.shared import work_path
from .sources.store import OPERATIONS, Store


def _outbox(spark, sf) -> DataFrame:
    """events as pending operations; an operation is named by its user and type, so many are sent again."""
    e, none = _read(spark, sf, "events"), F.lit(None).cast("string")
    made = e.select(F.concat_ws(":", "user_id", "event_type").alias("op_id"), F.lit("c").alias("client_id"), F.lit("u").alias("user_id"), F.lit(1).alias("schema_version"), F.lit("f").alias("function_name"), F.lit("t").alias("table"), F.lit("patch").alias("kind"), F.col("user_id").cast("string").alias("id"), none.alias("value"), F.col("event_id").cast("string").alias("patch"), F.col("event_id").cast("double").alias("created_at"), F.lit("pending").alias("status"), none.alias("error"), none.alias("group_id"), F.lit(None).cast("int").alias("group_index"))
    return made.orderBy("created_at")


@_query(
    """SELECT op_id, first AS patch, CASE WHEN user_id % 4 = 1 THEN 'rejected' WHEN user_id % 4 = 2 THEN 'acked' ELSE 'pending' END AS status, CASE WHEN user_id % 4 = 1 THEN 'late' END AS error
 FROM (SELECT user_id, user_id || ':' || event_type AS op_id, CAST(min(event_id) AS VARCHAR) AS first FROM events GROUP BY 1, 2) WHERE user_id % 4 <> 3"""
)
def outbox_states(spark, sf):
    """Operations are queued twice, of which the first stays; some get a status, the last one given holds; some are dropped;
    unknown names change nothing."""
    store, ops = Store(spark, work_path(spark, "outbox")), _outbox(spark, sf)
    store.enqueue(ops)
    store.enqueue(ops.withColumn("patch", F.lit("again")))
    held = store.operations().withColumn("user", F.split("op_id", ":")[0].cast("bigint"))
    rejected = held.filter("user % 4 = 1").select("op_id", F.lit("pushing").alias("new_status"), F.lit(None).cast("string").alias("new_error"))
    late = held.filter("user % 4 in (1, 2)").select("op_id", F.when(F.col("user") % 4 == 1, "rejected").otherwise("acked").alias("new_status"), F.when(F.col("user") % 4 == 1, "late").alias("new_error"))
    store.set_status(rejected)
    store.set_status(late.union(spark.createDataFrame([("none", "acked", None)], "op_id string, new_status string, new_error string")))
    store.drop_operations(held.filter("user % 4 = 3").select("op_id"))
    assert store.operations().columns == [c.split()[0].strip("`") for c in OPERATIONS.split(", ")]
    return store.operations().select("op_id", "patch", "status", "error")


@_query("SELECT CAST(user_id AS VARCHAR) AS scope_key, lpad(CAST(max(event_id) AS VARCHAR), 12, '0') AS \"cursor\" FROM events WHERE user_id % 3 <> 0 GROUP BY 1")
def cursors_kept(spark, sf):
    """Cursors go forward only, whatever comes later; those of left scopes go."""
    store, e = Store(spark, work_path(spark, "cursors")), _read(spark, sf, "events")
    for part in (1, 0):
        own = e.filter(F.col("event_id") % 2 == part).groupBy(F.col("user_id").cast("string").alias("scope_key")).agg(keys.change_id(F.max("event_id")).alias("cursor"))
        store.advance(own)
    store.advance(e.groupBy(F.col("user_id").cast("string").alias("scope_key")).agg(keys.change_id(F.min("event_id")).alias("cursor")))
    store.forget_cursors(e.filter("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("scope_key")).distinct())
    return store.cursors()


@_query("SELECT c_mktsegment || c_nationkey AS scope_key, CAST(CASE WHEN max(c_custkey) % 2 = 0 THEN 20 ELSE 5 END AS INTEGER) AS role FROM customer WHERE c_nationkey <> 7 GROUP BY 1")
def roles_kept(spark, sf):
    """The last role that was heard of holds; a scope that was left has none."""
    store, c = Store(spark, work_path(spark, "roles")), _read(spark, sf, "customer")
    of = c.groupBy(F.concat("c_mktsegment", "c_nationkey").alias("scope_key")).agg(F.max("c_custkey").alias("m"))
    store.set_roles(of.select("scope_key", F.lit(1).alias("role")))
    store.set_roles(of.select("scope_key", F.when(F.col("m") % 2 == 0, 20).otherwise(5).alias("role")))
    store.remove_roles(c.filter("c_nationkey = 7").select(F.concat("c_mktsegment", "c_nationkey").alias("scope_key")).distinct())
    return store.roles()


@_query("SELECT CAST(page_id AS VARCHAR) AS id, CASE WHEN page_id % 2 = 0 THEN 'first' ELSE 'second' END AS storage_id, CAST(strlen(html) AS BIGINT) AS n FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)")
def blobs_kept(spark, sf):
    """Blobs stay as they first came, and keep the first place they are given."""
    store, p = Store(spark, work_path(spark, "blobs")), _read(spark, sf, "pages")
    data = p.select(F.col("page_id").cast("string").alias("id"), F.lit(None).cast("string").alias("storage_id"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("data"))
    store.put_blobs(data)
    store.put_blobs(data.withColumn("data", F.encode(F.lit("other"), "utf-8")))
    store.finalize_blobs(data.filter("cast(id as bigint) % 2 = 0").select("id", F.lit("first").alias("storage_id")))
    store.finalize_blobs(data.select("id", F.lit("second").alias("storage_id")))
    return store.blobs().select("id", "storage_id", F.length("data").cast("long").alias("n"))


_GROUPED = "(SELECT event_id, event_id // 40 AS made, CASE WHEN event_id % 4 < 2 THEN event_id // 8 END AS grp, event_id % 3 AS idx, lpad(CAST((event_id * 7919) % 1000003 AS VARCHAR), 8, '0') AS op FROM events)"


@_query(f"SELECT event_id, row_number() OVER (ORDER BY made, lead, coalesce(CASE WHEN grp IS NOT NULL THEN idx END, 0), op) AS position FROM (SELECT *, CASE WHEN grp IS NULL THEN op ELSE min(op) OVER (PARTITION BY grp, made) END AS lead FROM {_GROUPED})")
def operation_order(spark, sf):
    """Operations by time, groups as units in the order of their members."""
    e = _read(spark, sf, "events")
    ops = e.select("event_id", F.floor(F.col("event_id") / 40).alias("created_at"), F.when(F.col("event_id") % 4 < 2, F.floor(F.col("event_id") / 8).cast("string")).alias("group_id"), F.when(F.col("event_id") % 4 < 2, F.col("event_id") % 3).alias("group_index"), F.lpad(((F.col("event_id") * 7919) % 1000003).cast("string"), 8, "0").alias("op_id"))
    for i, c in enumerate(view.operation_order()):
        ops = ops.withColumn(f"o{i}", c)
    order = F.struct("o0", "o1", "o2", "o3")
    return log.numbered(ops.withColumn("__o", order), [], "__o", "position").select("event_id", "position")


@_query("SELECT o_orderkey, position FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, CAST(o_orderkey AS VARCHAR)) AS position FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') WHERE position <= 30")
def where_and_alias(spark, sf):
    """A column and a value as a condition, and the other name of order()."""
    q = Query(ORDERS).scope(o_orderstatus="F").where("o_orderpriority", "1-URGENT").order_by("o_totalprice").limit(30)
    same = Query(ORDERS).scope(o_orderstatus="F").where("o_orderpriority", "1-URGENT").order("o_totalprice").limit(30)
    assert q.fingerprint == same.fingerprint != same.limit(31).fingerprint and q.with_("customer", "lines").reads == ["orders", "customer", "lineitem"]
    return Database(Manifest(1, [ORDERS]), {"orders": _orders(spark, sf)}).run(q).select("o_orderkey").coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1)


CHAIN = TableDef("events", schema(event_id="bigint", event_type="string"), relations={"before": one("events", "before_id"), "after": many("events", "before_id")})


@_query("SELECT event_id, lag(event_type) OVER w AS before_type, lag(event_id, 2) OVER w AS second FROM events WINDOW w AS (ORDER BY event_id)")
def rel_self(spark, sf):
    """A relation of a table to itself, as deep as it is named."""
    rows = _rows(spark, sf, "events", "event_id").select("_id", "event_id", "event_type", (F.col("event_id") - 1).cast("string").alias("before_id"))
    got = Query(CHAIN).with_("before").to_df({"events": rows})
    deeper = relations.attach(rows, "before", CHAIN.relations["before"], got.select("_id", "event_id", F.col("before.event_id").alias("second")))
    return got.select("_id", "event_id", F.col("before.event_type").alias("before_type")).join(deeper.select("_id", F.col("before.second").alias("second")), "_id").drop("_id")


@_query("SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) AS place FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def rel_flat(spark, sf):
    """The lines of orders as rows of their own: a relation without nesting, for orders with any number of lines."""
    lines = _read(spark, sf, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("_id"), F.col("l_orderkey").cast("string").alias("order_id"), "l_linenumber")
    found = relations.flat(Query(ORDERS).scope(o_orderstatus="P").matching(_orders(spark, sf)), many("lineitem", "order_id"), lines)
    place = F.row_number().over(Window.partitionBy("_base").orderBy("place", "_id"))
    return found.select(F.col("_base").cast("bigint").alias("o_orderkey"), "l_linenumber", place.alias("place"))


@_query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 500 AND NOT (source = 'src1')")
def filter_serialized(spark, sf):
    """A filter written as text, read again and applied; rows are tested by the plan's condition."""
    text = serialize_filter({"lang": {"in": ["en", "de"]}, "n_chars": {"gte": 500}, "NOT": {"source": "src1"}})
    spec, error = parse_filter(text)
    assert error is None and serialize_filter(spec) == text
    return Query(LABELLED).filter(spec).matching(_labelled(spark, sf)).select("doc_id")


_DIGITS_SQL = f"'{ranks.DIGITS}'"


@_query(f"SELECT p_partkey, substr({_DIGITS_SQL}, CAST(p_partkey % 58 + 3 AS INTEGER), 1) AS middle FROM part")
def rank_middle(spark, sf):
    """Between two digits that have one between them stands that digit."""
    digits = F.lit(ranks.DIGITS)
    at = (F.col("p_partkey") % 58).cast("int")
    low, high = digits.substr(at + 2, F.lit(1)), digits.substr(at + 4, F.lit(1))
    return _read(spark, sf, "part").select("p_partkey", ranks.rank_between_column(low, high).alias("middle"))


@_query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS position FROM part")
def ranks_rebalanced(spark, sf):
    """New ranks for the parts of each brand sort as the parts did, by code point."""
    own = Window.partitionBy("p_brand")
    place = F.row_number().over(own.orderBy("p_retailprice", "p_partkey")) - 1
    placed = _read(spark, sf, "part").select("p_partkey", "p_brand", place.alias("i"), F.count("*").over(own).alias("n"))
    ranked = placed.withColumn("rank", ranks.rebalanced_column(F.col("i"), F.col("n")))
    return ranked.select("p_partkey", F.row_number().over(own.orderBy("rank")).alias("position"))


@_query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) AS position FROM documents WHERE source = 'src2'")
def search_recency(spark, sf):
    """Of rows with one score the later updated come first."""
    table = TableDef("documents", schema(doc_id="bigint", source="string", updatedAt="double"), search_fields=("source",))
    rows = _rows(spark, sf, "documents", "doc_id").select("_id", "doc_id", "source", F.col("n_chars").cast("double").alias("updatedAt"))
    found = search.search(table, rows, search.index(table, rows), "src2").coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1)
    assert search.search(table, rows, search.index(table, rows), " . ").limit(1).count() == 0
    return found.select(F.col("id").cast("bigint").alias("doc_id"), "position")


@_query("SELECT event_id FROM events WHERE event_type IN ('click', 'error')")
def log_configured(spark, sf):
    """Changes of tables that are declared no more are not handed out."""
    e = _read(spark, sf, "events").select("event_id", F.col("event_type").alias("table"))
    return log.configured(e, ["click", "error"]).select("event_id")


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_custkey, o_orderpriority FROM orders")
def rows_stripped(spark, sf):
    """Rows as a client may send them back: without system and server columns."""
    table = TableDef("orders", schema(o_custkey="bigint", o_orderpriority="string", o_totalprice="double"), server_fields=("o_totalprice",))
    rows = _orders(spark, sf).select("_id", "o_custkey", "o_orderpriority", "o_totalprice", F.lit(1).alias("_version"), F.lit(False).alias("_deleted"), F.lit(False).alias("_pending"))
    return view.strip(table, rows)


@_query("SELECT p_partkey, position FROM (SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), CAST(p_partkey AS VARCHAR)) AS position FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'a' END || chr(CAST(98 + p_partkey % 20 AS INTEGER)) AS p_name FROM part)) WHERE false OR position > 0")
def collated_order(spark, sf):
    """Strings as people sort them: a small letter beside its capital, not after all capitals."""
    letters = F.array(*(F.lit(chr(98 + i)) for i in range(20)))
    p = _rows(spark, sf, "part", "p_partkey").select("_id", "p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("a"), F.element_at(letters, (F.col("p_partkey") % 20 + 1).cast("int"))).alias("p_name"))
    table = TableDef("part", schema(p_partkey="bigint", p_name="string"))
    got = Query(table).order("p_name").collate("UNICODE_CI").to_df({"part": p})
    return got.select("p_partkey").coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1)


@_query("SELECT c_custkey, '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || '}' AS value, '{\"c_name\":\"' || c_name || '\"}' AS patch FROM customer")
def derived_writes(spark, sf):
    """Writes that follow from a table alone: an insert takes what a client may set, a patch what it was given, a delete names
    its row."""
    table = TableDef("customer", schema(c_custkey="bigint", c_name="string", c_nationkey="int", c_acctbal="double", owner="string"), by_user("owner"), server_fields=("c_acctbal",))
    c = _read(spark, sf, "customer")
    calls = c.select(F.col("c_custkey").alias("seq"), F.lit("o").alias("op_id"), F.lit("u").alias("user_id"), F.col("c_custkey").cast("string").alias("local_id"), F.to_json(F.struct("c_custkey", "c_name", "c_nationkey", "c_acctbal", F.lit("x").alias("owner"))).alias("args"), F.lit(1.0).alias("now"))
    made = mutations.insert_of(table).operations(calls, "add").select("seq", "value")
    given = calls.withColumn("args", F.to_json(F.struct(F.col("local_id").alias("id"), F.get_json_object("args", "$.c_name").alias("c_name"), F.lit(5).alias("c_acctbal"))))
    patched = mutations.patch_of(table).operations(given, "edit").select("seq", "patch")
    gone = mutations.remove_of(table).operations(given, "drop").select("seq", "id")
    return made.join(patched, "seq").join(gone, "seq").filter("cast(id as bigint) = seq").select(F.col("seq").alias("c_custkey"), "value", "patch")


@_query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT c_mktsegment, count(*) FROM customer GROUP BY 1")
def manifest_merged(spark, sf):
    """Two modules, each with a table and a query of its own, as one."""
    a, b = Manifest(1, [LINES]), Manifest(1, [CUSTOMER])
    a.query("flags", lambda held: held["lineitem"].groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n")))
    b.query("segments", lambda held: held["customer"].groupBy(F.col("c_mktsegment").alias("flag")).agg(F.count("*").alias("n")))
    whole = Database(a.merge(b), {"lineitem": _read(spark, sf, "lineitem").withColumn("_id", F.lit("x")), "customer": _rows(spark, sf, "customer", "c_custkey")})
    return whole.call("flags").union(whole.call("segments"))


@_query("SELECT c_custkey, CASE WHEN v THEN 'w' END AS scope_key FROM customer LEFT JOIN (SELECT DISTINCT user_id, true AS v FROM events) ON user_id = c_custkey")
def scope_of_rows(spark, sf):
    """The scope of rows by their newest change; none for a row that was never seen."""
    rows = _read(spark, sf, "customer").select(F.lit("users").alias("table"), F.col("c_custkey").cast("string").alias("id"))
    return log.scope_of(_event_log(spark, sf), rows).select(F.col("id").cast("bigint").alias("c_custkey"), "scope_key")


@_query("SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY value, event_id) AS n FROM events WHERE user_id = 5 AND event_type = 'view') WHERE n > 0")
def keyed_query(spark, sf):
    """A query by an index whose key is made from the signed-in user and the arguments."""
    table = TableDef("events", schema(event_id="bigint", user_id="string", event_type="string", value="double"), by_user("user_id"), indexes={"byType": ("user_id", "event_type", "value")})
    m = Manifest(1, [table])
    m.indexed_query("mine", "events", "byType", lambda user, args: [user, args["kind"]])
    rows = _rows(spark, sf, "events", "event_id").withColumn("user_id", F.col("user_id").cast("string"))
    return Database(m, {"events": rows}, "5").call("mine", kind="view").select("event_id", "value")


