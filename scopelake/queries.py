"""Registered queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys, ranks, sets
from .operators import log, relations, search, view
from .plans.catalog import TableDef, by_user, by_workspace, many, many_to_many, one, via_ids
from .plans.query import Query, indexed, schema
from .sources.shared import work_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rows(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    return _read(spark, sf, name).withColumn("_id", F.col(key).cast("string"))


ORDERS = TableDef(
    "orders",
    schema(o_orderkey="bigint", o_custkey="bigint", o_orderstatus="string", o_totalprice="double", o_orderdate="timestamp", o_orderpriority="string"),
    by_workspace("o_orderstatus"),
    relations={"customer": one("customer", "customer_id"), "lines": many("lineitem", "order_id")},
    indexes={"byStatusPrice": ("o_orderstatus", "o_totalprice")},
)
CUSTOMER = TableDef("customer", schema(c_custkey="bigint", c_name="string", c_nationkey="int", c_acctbal="double", c_mktsegment="string"), relations={"orders": many("orders", "customer_id")})
LINES = TableDef("lineitem", schema(l_orderkey="bigint", l_partkey="bigint", l_suppkey="bigint", l_linenumber="int", l_quantity="double", l_extendedprice="double", l_discount="double", l_tax="double", l_returnflag="string", l_linestatus="string"), indexes={"byFlagStatus": ("l_returnflag", "l_linestatus", "l_quantity", "l_orderkey", "l_linenumber")})
EVENTS = TableDef("events", schema(event_id="bigint", user_id="bigint", event_type="string", value="double", props="string"), by_user("user_id"))
LABELLED = TableDef("documents", schema(doc_id="bigint", text="string", lang="string", source="string", n_chars="bigint", quality="int", toxic="int", tags="array<string>"), search_fields=("text", "source"))
_DOCS_SQL = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) quality, max(toxic) toxic FROM labels GROUP BY doc_id) l USING (doc_id))"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    marks = _read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = _rows(spark, sf, "documents", "doc_id").join(marks, "doc_id", "left")
    return docs.withColumn("tags", F.array("lang", "source", F.when(F.col("toxic") == 1, "toxic")))


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf, "orders", "o_orderkey").withColumn("customer_id", F.col("o_custkey").cast("string"))


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def scope_eq(spark, sf):
    return Query(ORDERS).scope(o_orderstatus="F").to_df({"orders": _orders(spark, sf)}).select("o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE false")
def scope_fail_closed(spark, sf):
    return Query(ORDERS).to_df({"orders": _orders(spark, sf)}).select("o_orderkey", "o_totalprice")


@_query("SELECT event_id, event_type FROM events WHERE user_id = 3")
def scope_owner(spark, sf):
    rows = _rows(spark, sf, "events", "event_id").withColumn("user_id", F.col("user_id").cast("string"))
    owned = TableDef("events", schema(event_id="bigint", user_id="string", event_type="string"), by_user("user_id"))
    return Query(owned).to_df({"events": rows}, user="3").select("event_id", "event_type")


def _filtered(spec):
    return lambda spark, sf: Query(LABELLED).filter(spec).to_df({"documents": _labelled(spark, sf)}).select("doc_id", "lang", "quality", "toxic")


_FILTERS = {
    "filter_eq_null": ({"toxic": None}, "toxic IS NULL"),
    "filter_eq_ne": ({"quality": {"eq": 1}, "toxic": {"ne": 1}}, "quality IS NOT DISTINCT FROM 1 AND toxic IS DISTINCT FROM 1"),
    "filter_in_nin": ({"lang": {"in": ["en", "de"]}, "quality": {"nin": [0, None]}}, "lang IN ('en', 'de') AND NOT (coalesce(quality = 0, false) OR quality IS NULL)"),
    "filter_in_null": ({"toxic": {"in": [1, None]}}, "coalesce(toxic = 1, false) OR toxic IS NULL"),
    "filter_ranges_null": ({"quality": {"lt": 1}, "n_chars": {"gte": 200, "lte": 5000}}, "(quality IS NULL OR quality < 1) AND n_chars >= 200 AND n_chars <= 5000"),
    "filter_range_null_literal": ({"quality": {"gt": None}}, "quality IS NOT NULL"),
    "filter_string_range": ({"source": {"gt": "src12", "lte": "src4"}}, "source > 'src12' AND source <= 'src4'"),
    "filter_contains": ({"tags": {"contains": "toxic"}}, "coalesce(toxic = 1, false)"),
    "filter_contains_null": ({"tags": {"contains": None}}, "NOT coalesce(toxic = 1, false)"),
    "filter_overlaps": ({"tags": {"overlaps": ["fr", "src3"]}}, "lang = 'fr' OR source = 'src3'"),
    "filter_nested_logic": ({"OR": [{"lang": "en", "quality": {"gte": 1}}, {"NOT": {"toxic": {"ne": 1}}}, {"AND": []}], "NOT": {"OR": [{"lang": "es"}, {"n_chars": {"lt": 100}}]}}, "(true) AND NOT (lang IS NOT DISTINCT FROM 'es' OR n_chars < 100)"),
    "filter_type_mismatch": ({"OR": [{"lang": 5}, {"quality": "1"}, {"n_chars": {"gt": 1000}}]}, "n_chars > 1000"),
}
for _name, (_spec, _sql) in _FILTERS.items():
    QUERIES[_name] = _filtered(_spec)
    ORACLES[_name] = f"SELECT doc_id, lang, quality, toxic FROM {_DOCS_SQL} WHERE {_sql}"


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC NULLS LAST, CAST(o_orderkey AS VARCHAR) LIMIT 25")
def order_limit_topk(spark, sf):
    return Query(ORDERS).scope(o_orderstatus="O").order("o_totalprice", "desc").limit(25).to_df({"orders": _orders(spark, sf)}).select("o_orderkey", "o_totalprice")


@_query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' ORDER BY l_quantity, l_orderkey, l_linenumber")
def index_prefix_query(spark, sf):
    rows = _read(spark, sf, "lineitem").withColumn("_id", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    return indexed(LINES, rows, "byFlagStatus", ["R", "F"]).select("l_orderkey", "l_linenumber", "l_quantity")


@_query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def rel_one(spark, sf):
    frames = {"orders": _orders(spark, sf), "customer": _rows(spark, sf, "customer", "c_custkey")}
    return Query(ORDERS).scope(o_orderstatus="P").with_("customer").to_df(frames).select("o_orderkey", "customer.c_name", "customer.c_mktsegment")


@_query("SELECT c_custkey, count(o_orderkey) AS n_orders, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def rel_backref(spark, sf):
    frames = {"orders": _orders(spark, sf).select("_id", "o_orderkey", "customer_id"), "customer": _rows(spark, sf, "customer", "c_custkey").select("_id", "c_custkey")}
    out = Query(CUSTOMER).with_("orders").to_df(frames, target_scope=False)
    at = F.transform("orders", lambda o: o["o_orderkey"])
    return out.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), F.array_min(at).alias("first_order"), F.array_max(at).alias("last_order"))


@_query("SELECT s_suppkey, count(p_partkey) AS n_parts, min(p_partkey) AS first_part, max(p_partkey) AS last_part FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY s_suppkey")
def rel_many_to_many(spark, sf):
    links = _read(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("s"), F.col("l_partkey").cast("string").alias("p"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_id"))
    parts = _rows(spark, sf, "part", "p_partkey").select("_id", "p_partkey")
    out = relations.attach(_rows(spark, sf, "supplier", "s_suppkey").select("_id", "s_suppkey"), "parts", many_to_many("part", "lineitem", "s", "p"), parts, links)
    at = F.transform("parts", lambda x: x["p_partkey"])
    return out.select("s_suppkey", F.size("parts").cast("long").alias("n_parts"), F.array_min(at).alias("first_part"), F.array_max(at).alias("last_part"))


@_query(
    "SELECT c_custkey, array_to_string(list_filter([CASE WHEN EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = c_custkey) THEN CAST(c_custkey AS VARCHAR) END, CASE WHEN EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = c_nationkey) THEN CAST(c_nationkey AS VARCHAR) END, CASE WHEN EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = c_custkey) THEN CAST(c_custkey AS VARCHAR) END], lambda x: x IS NOT NULL), ',') AS suppliers FROM customer"
)
def rel_via_ids(spark, sf):
    base = _rows(spark, sf, "customer", "c_custkey").withColumn("ids", F.array(F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), F.lit("ghost"), F.col("c_custkey").cast("string")))
    out = relations.attach(base, "suppliers", via_ids("supplier", "ids"), _rows(spark, sf, "supplier", "s_suppkey"))
    return out.select("c_custkey", F.array_join(F.transform("suppliers", lambda x: x["_id"]), ",").alias("suppliers"))


@_query("SELECT event_type AS key, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY value DESC NULLS LAST, CAST(event_id AS VARCHAR)) AS ids FROM (SELECT * FROM events ORDER BY value DESC NULLS LAST, CAST(event_id AS VARCHAR) LIMIT 200) GROUP BY event_type")
def group_rows_limited(spark, sf):
    q = Query(EVENTS).order("value", "desc").limit(200).group_by("event_type")
    return q.groups({"events": _rows(spark, sf, "events", "event_id")}).select("key", F.array_join(F.transform("rows", lambda r: r["_id"]), ",").alias("ids"))


@_query("SELECT event_type AS key, event_id FROM events")
def group_rows(spark, sf):
    return Query(EVENTS).order("value").group_by("event_type").group_positions({"events": _rows(spark, sf, "events", "event_id")}).select("key", "event_id")


@_query("SELECT CAST(toxic AS VARCHAR) AS key, count(*) AS n FROM " + _DOCS_SQL + " GROUP BY 1")
def counts_grouped(spark, sf):
    return Query(LABELLED).order("n_chars").limit(3).group_by("toxic").counts({"documents": _labelled(spark, sf)})


@_query("SELECT count(*) AS n FROM events WHERE value > 10")
def counts_scalar(spark, sf):
    return Query(EVENTS).filter({"value": {"gt": 10}}).counts({"events": _rows(spark, sf, "events", "event_id")})


_TOKENS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def _search_sql(last: str, exact: list[str], where: str = "true") -> str:
    toks = " UNION ALL ".join(f"SELECT doc_id, {i} AS field, unnest(list_distinct({_TOKENS_SQL.format(c)})) AS token FROM documents WHERE {where}" for i, c in enumerate(("text", "source")))
    score = f"sum(CASE WHEN starts_with(token, '{last}') THEN (2 - field) * CASE WHEN token = '{last}' THEN 2 ELSE 1 END ELSE 0 END" + "".join(f" + CASE WHEN token = '{w}' THEN (2 - field) * 2 ELSE 0 END" for w in exact) + ")"
    need = " AND ".join([f"bool_or(starts_with(token, '{last}'))", *(f"bool_or(token = '{w}')" for w in exact)])
    return f"SELECT doc_id, CAST({score} AS BIGINT) AS score, count(*) OVER () AS total FROM (SELECT doc_id, token, min(field) AS field FROM ({toks}) GROUP BY doc_id, token) GROUP BY doc_id HAVING {need}"


#: Stored postings by session and folder: an index is built once and asked many times.
_POSTINGS: dict[tuple[str, str], str] = {}


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _POSTINGS:
        path = work_path(spark, "postings")
        rows = search.sliced(_rows(spark, sf, "documents", "doc_id").select("_id", *LABELLED.search_fields))
        search.store(search.index(LABELLED, rows), path)
        _POSTINGS[key] = path
    return spark.read.parquet(_POSTINGS[key])


def _searched(text: str, within=None):
    def run(spark, sf):
        rows = _rows(spark, sf, "documents", "doc_id")
        found = search.search(LABELLED, rows, _postings(spark, sf), text, within=within)
        return found.select(F.col("id").cast("bigint").alias("doc_id"), F.col("score").cast("long").alias("score"), "total")

    return run


for _name, _text, _exact, _last, _within, _where in (
    ("search_single", "license", [], "license", None, "true"),
    ("search_prefix", "licens", [], "licens", None, "true"),
    ("search_two_tokens", "The src1 ", ["the"], "src1", None, "true"),
    ("search_repeated_token", "the the src", ["the", "the"], "src", None, "true"),
):
    QUERIES[_name] = _searched(_text, _within)
    ORACLES[_name] = _search_sql(_last, _exact, _where)


@_query(_search_sql("licens", [], "lang = 'de'"))
def search_scoped(spark, sf):
    return _searched("licens", F.col("lang") == "de")(spark, sf)


@_query(
    "SELECT l_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) FILTER (l_linenumber > 3 OR NOT returned), '') AS merged FROM (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey"
)
def set_delta_apply(spark, sf):
    """Current: lines up to 3; added: lines above 3; removed: returned lines up to 3 (they are never above)."""
    n = F.col("l_linenumber").cast("string")
    low = F.col("l_linenumber") <= 3
    got = _read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(low, n)).alias("now"), F.collect_list(F.when(~low, n)).alias("add"), F.collect_list(F.when(low & (F.col("l_returnflag") == "R"), n)).alias("remove"))
    merged = sets.apply_set_delta(F.col("now"), F.col("add"), F.col("remove"))
    return got.select("l_orderkey", F.array_join(F.sort_array(merged), ",").alias("merged"))


@_query("SELECT user_id, CAST(sum(event_id % 7) - 3 * count(*) AS BIGINT) AS votes FROM events GROUP BY user_id")
def counter_delta_sum(spark, sf):
    delta = sets.counter_delta(F.lit(3).cast("long"), F.col("event_id") % 7)
    return _read(spark, sf, "events").groupBy("user_id").agg(F.sum(delta).alias("votes"))


def _event_log(spark: SparkSession, sf: str) -> DataFrame:
    """events as a change log of users: errors delete, clicks patch the value only, others are full rows."""
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "patch").otherwise("replace")
    row = F.to_json(F.struct("value", F.col("event_type").alias("last_type")))
    e = _read(spark, sf, "events")
    return e.select(F.lit("w").alias("scope_key"), keys.change_id(F.col("event_id") + 1).alias("change_id"), F.lit("users").alias("table"), F.col("user_id").cast("string").alias("id"), kind.alias("kind"), F.when(kind == "replace", row).alias("value"), F.when(kind == "patch", F.to_json(F.struct("value"))).alias("patch"), (F.col("event_id") + 1).alias("version"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("server_time"), F.concat(F.lit("op"), F.col("event_id")).alias("op_id"))


USERS = TableDef("users", schema(value="double", last_type="string"))
_LOG_SQL = "(SELECT *, event_id + 1 AS seq, CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'patch' ELSE 'replace' END AS kind FROM events)"
_FOLD_SQL = f"""WITH log AS {_LOG_SQL}, f AS (SELECT user_id, coalesce(max(seq) FILTER (kind = 'replace'), 0) AS start FROM log GROUP BY user_id),
 t AS (SELECT log.*, f.start FROM log JOIN f USING (user_id) WHERE seq >= f.start)
 SELECT CAST(user_id AS VARCHAR) AS _id, arg_max(value, seq) FILTER (kind <> 'delete') AS value, arg_max(event_type, seq) FILTER (kind = 'replace') AS last_type, max(seq) AS _version, arg_max(kind, seq) = 'delete' AS _deleted FROM t GROUP BY user_id"""


def _no_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "_id string, value double, last_type string, _version bigint, _deleted boolean")


@_query(_FOLD_SQL)
def log_fold_tombstone(spark, sf):
    return view.fold(USERS, _no_rows(spark), _event_log(spark, sf))


@_query(f"SELECT _id, value, last_type FROM ({_FOLD_SQL}) WHERE NOT _deleted")
def log_fold_live(spark, sf):
    return view.fold(USERS, _no_rows(spark), _event_log(spark, sf)).filter("not _deleted").select("_id", "value", "last_type")


@_query("SELECT CAST(user_id AS VARCHAR) AS _id, arg_max(value, event_id) AS value, true AS _pending FROM events GROUP BY user_id")
def derive_view_pending(spark, sf):
    """Every user has a canonical row; every event is a pending patch of its value."""
    e = _read(spark, sf, "events")
    base = e.select(F.col("user_id").cast("string").alias("_id")).distinct().select("_id", F.lit(-1.0).alias("value"), F.lit("none").alias("last_type"), F.lit(1).cast("long").alias("_version"), F.lit(False).alias("_deleted"))
    ops = e.select(keys.change_id(F.col("event_id")).alias("op_id"), F.col("user_id").cast("string").alias("id"), F.lit("patch").alias("kind"), F.lit("pending").alias("status"), F.col("event_id").cast("double").alias("created_at"), F.lit(None).cast("string").alias("group_id"), F.lit(None).cast("int").alias("group_index"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("value"), F.to_json(F.struct("value")).alias("patch"))
    return view.derive_view(USERS, base, ops).select("_id", "value", "_pending")


@_query("SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS op_id, min(event_id) AS first_seq FROM events GROUP BY 1, 2")
def ledger_dedupe(spark, sf):
    sent = _read(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("op_id"), F.col("event_id").alias("seq"))
    return log.first_sends(sent.union(sent)).select("user_id", "op_id", F.col("seq").alias("first_seq"))


@_query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events")
def version_assign(spark, sf):
    changes = _read(spark, sf, "events").select(F.lit("users").alias("table"), F.col("user_id").alias("id"), F.col("event_id").alias("seq"))
    return log.versions_of(changes).select(F.col("seq").alias("event_id"), F.col("version").cast("long").alias("version"))


@_query("SELECT event_type AS scope_key, lpad(CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS VARCHAR), 12, '0') AS change_id, event_id FROM events")
def change_ids(spark, sf):
    e = _read(spark, sf, "events").select(F.col("event_type").alias("scope_key"), F.lit("users").alias("table"), F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"))
    return log.append(_event_log(spark, sf).limit(0), e).select("scope_key", "change_id", F.col("seq").alias("event_id"))


@_query("SELECT lpad(CAST(event_id + 1 AS VARCHAR), 12, '0') AS change_id, CAST(user_id AS VARCHAR) AS id FROM events WHERE event_id + 1 > 100 ORDER BY 1 LIMIT 50")
def cursor_page(spark, sf):
    return log.changes_after(_event_log(spark, sf), "w", "000000000100", 50).select("change_id", "id")


@_query("SELECT 'users:' || CAST(user_id AS VARCHAR) AS row_key, max(event_id + 1) AS version FROM events GROUP BY user_id HAVING 'users:' || CAST(user_id AS VARCHAR) > 'users:2' ORDER BY 1 LIMIT 10")
def bootstrap_page(spark, sf):
    return log.snapshot_page(log.latest_versions(_event_log(spark, sf)), "w", "users:2", 10).select("row_key", "version")


@_query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' AND o_orderkey % 3 <> 0)")
def ghost_eviction(spark, sf):
    rows = _orders(spark, sf)
    return relations.keep_except_ghosts(rows, "o_orderstatus", "O", rows.filter("o_orderkey % 3 = 0")).select("o_orderkey")


@_query(f"SELECT doc_id, CASE WHEN coalesce(toxic = 1, false) THEN 'delete' ELSE 'insert' END AS kind, NOT coalesce(toxic = 1, false) AS has_data FROM {_DOCS_SQL}")
def visibility_filter(spark, sf):
    docs = _labelled(spark, sf).select("_id", "doc_id", "lang", "toxic")
    changes = docs.select(F.lit("w").alias("scope_key"), keys.change_id(F.col("doc_id")).alias("change_id"), F.lit("documents").alias("table"), F.col("_id").alias("id"), F.lit("patch").alias("kind"), F.lit(1).cast("long").alias("version"))
    return log.visible_changes(changes, docs, ~F.coalesce(F.col("toxic") == 1, F.lit(False))).select(F.col("id").cast("bigint").alias("doc_id"), "kind", F.col("value").isNotNull().alias("has_data"))


_BUDGET_SQL = "(SELECT event_type, event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS pos FROM events WHERE event_type IN ('error', 'click', 'view'))"


@_query(f"SELECT scope_key, event_id FROM (SELECT event_type AS scope_key, event_id, row_number() OVER (ORDER BY pos, event_id) AS rn FROM {_BUDGET_SQL}) WHERE rn <= 150")
def scope_budget(spark, sf):
    e = _read(spark, sf, "events").select(F.col("event_type").alias("scope_key"), keys.change_id(F.col("event_id")).alias("change_id"), "event_id")
    asked = spark.createDataFrame([("error", None, 1), ("click", None, 2), ("view", None, 3)], "scope_key string, cursor string, position int")
    return log.pull(e, asked, 150).select("scope_key", "event_id")


@_query("SELECT event_id FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last FROM events) WHERE epoch_ms(ts) >= epoch_ms(TIMESTAMP '2024-01-20') OR event_id = last")
def gc_retention(spark, sf):
    rows = _event_log(spark, sf).withColumn("scope_key", F.col("id"))
    horizon = 1705708800000.0  # 2024-01-20
    return log.collect_garbage(rows, horizon).select((keys.change_number(F.col("change_id")) - 1).alias("event_id"))


@_query("SELECT event_type AS scope_key, CAST(user_id AS VARCHAR) AS client_id FROM (SELECT event_type, user_id, max(epoch_ms(ts)) AS seen_ms FROM events GROUP BY 1, 2) WHERE seen_ms > 1706400000000 - 86400000 * 7")
def presence_ttl(spark, sf):
    beats = _read(spark, sf, "events").select(F.col("event_type").alias("scope_key"), F.col("user_id").cast("string").alias("client_id"), F.col("user_id").cast("string").alias("user_id"), F.col("props").alias("data"), F.lit(False).alias("leaving"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("updated_at"))
    return log.present(beats, 1706400000000.0, 86_400_000 * 7).select("scope_key", "client_id")


@_query("SELECT p_partkey, regexp_full_match(replace(p_brand, '#', ''), '[0-9A-Za-z]*[1-9A-Za-z]') AS valid FROM part")
def rank_valid(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", ranks.is_valid_rank_column(F.regexp_replace("p_brand", "#", "")).alias("valid"))


@_query("SELECT CAST(conv_id AS VARCHAR) AS unit, count(*) AS n_ops, min(turn) AS created_at, arg_min(role, turn) AS error FROM conversations GROUP BY conv_id")
def recovery_groups(spark, sf):
    c = _read(spark, sf, "conversations")
    ops = c.select(F.concat_ws("-", "conv_id", "turn", F.xxhash64("text")).alias("op_id"), F.col("conv_id").cast("string").alias("group_id"), F.col("turn").cast("int").alias("group_index"), F.lit("turns").alias("table"), F.col("turn").cast("long").alias("created_at"), F.lit("rejected").alias("status"), F.col("role").alias("error"))
    return log.recovery(ops).select("unit", F.size("op_ids").cast("long").alias("n_ops"), "created_at", "error")


@_query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 0")
def op_history(spark, sf):
    """Undo units per scope: all of them, as the depth exceeds their number."""
    e = _read(spark, sf, "events").select(F.col("user_id").cast("string").alias("scope_key"), keys.change_id(F.col("event_id")).alias("op_id"), F.col("event_type").alias("group_id"), F.col("event_id").alias("created_at"))
    return view.undo_stack(e).select(F.col("scope_key").cast("bigint").alias("user_id"), F.col("unit").alias("event_type"), F.size("op_ids").cast("long").alias("n"))


from . import queries_sync  # noqa: E402, F401  registers its queries here
from . import queries_more, queries_server  # noqa: E402, F401, I001  these too
