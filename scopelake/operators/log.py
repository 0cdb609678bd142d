"""The server side of synchronisation as batch operators over change logs.

log(scope_key, change_id, table, id, kind, value, patch, version, server_time, op_id)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json import field_kind
from ..functions.keys import EMPTY_CURSOR, change_id, change_number, row_key
from ..functions.values import is_number
from ..plans.catalog import TableDef
from ..sources.shared import cut, numbered, running
from .decide import decide, permissions


#: A change as the log and the ledger keep it.
CHANGE_FIELDS = "scope_key:string,change_id:string,table:string,id:string,kind:string,value:string,patch:string,version:bigint,server_time:double,op_id:string"


def bounds(log: DataFrame) -> DataFrame:
    """First and last change id of each scope."""
    return log.groupBy("scope_key").agg(F.min("change_id").alias("first_id"), F.max("change_id").alias("last_id"))


def latest_versions(log: DataFrame) -> DataFrame:
    """table, id, version, scope_key and row_key of each row by its newest change."""
    newest = F.struct("version", "change_id")
    return log.groupBy("table", "id").agg(F.max("version").alias("version"), F.max_by("scope_key", newest).alias("scope_key"), F.max_by("kind", newest).alias("kind")).withColumn("row_key", row_key(F.col("table"), F.col("id")))


def version_of(log: DataFrame, rows: DataFrame) -> DataFrame:
    """table, id and version of the given rows(table, id); 0 for a row that the log has never seen."""
    known = latest_versions(log).select("table", "id", "version")
    return rows.select("table", "id").join(known, ["table", "id"], "left").withColumn("version", F.coalesce("version", F.lit(0)).cast("long"))


def changes_after(log: DataFrame, scope: str, cursor: str | None, limit: int) -> DataFrame:
    """A page of a scope's changes after a cursor (None: from the start), in order."""
    return log.filter((F.col("scope_key") == scope) & (F.col("change_id") > F.lit(cursor or ""))).orderBy("change_id").limit(max(0, limit))


def snapshot_page(versions: DataFrame, scope: str, after: str | None, limit: int) -> DataFrame:
    """A page of a scope's rows by row key."""
    return versions.filter((F.col("scope_key") == scope) & (F.col("row_key") > F.lit(after or ""))).orderBy("row_key").limit(max(0, limit))


def oldest_ids(id_map: DataFrame) -> DataFrame:
    """table, local_id and server_id; of several mappings the oldest holds."""
    return id_map.groupBy("table", "local_id").agg(F.min_by("server_id", F.struct("created_at", "server_id")).alias("server_id"))


def put_ids(id_map: DataFrame, new: DataFrame) -> DataFrame:
    """The id map with new(table, local_id, server_id, created_at); a local id that already stands for another row is an error."""
    known = oldest_ids(id_map).withColumnRenamed("server_id", "__known")
    clash = new.join(known, ["table", "local_id"]).filter("server_id <> __known").limit(1).collect()
    twice = new.groupBy("table", "local_id").agg(F.count_distinct("server_id").alias("n")).filter("n > 1").limit(1).collect()
    if clash or twice:
        raise ValueError(f"local id {(clash or twice)[0].local_id!r} stands for another row")
    return id_map.unionByName(new.join(id_map.select("table", "local_id"), ["table", "local_id"], "left_anti").dropDuplicates(["table", "local_id"]).select(id_map.columns))


@dataclass
class Known:
    """What numbering needs to know of a log: heads(scope_key, last), the number of each scope's last change, and
    rows(table, id, version, scope_key). A store keeps both as state, so that a batch need not read the log."""

    heads: DataFrame
    rows: DataFrame

    @staticmethod
    def of(log: DataFrame) -> Known:
        last = F.struct("version", "change_id")
        return Known(log.groupBy("scope_key").agg(F.max(change_number(F.col("change_id"))).alias("last")), log.groupBy("table", "id").agg(F.max("version").alias("version"), F.max_by("scope_key", last).alias("scope_key")))

    def after(self, changes: DataFrame) -> Known:
        """What is new or other after appended changes."""
        return Known.of(changes)


def append(log: DataFrame | Known, new: DataFrame) -> DataFrame:
    """The rows of `new` (log columns without change_id and version, and seq for their order, without ties) with the next
    change ids of their scopes and the next versions of their rows. Scopes of any size are numbered in two passes.

    Of a whole log what is known is aggregated; a Known names it, and then only that is joined to the batch."""
    known = log if isinstance(log, Known) else Known.of(log)
    rows = known.rows.select("table", "id", F.col("version").alias("__version"))
    # Versions come first: rows are dealt by table and id before a push asks for this, and need not be dealt so again.
    version = F.row_number().over(Window.partitionBy("table", "id").orderBy("seq")) + F.coalesce("__version", F.lit(0))
    placed = new.join(rows, ["table", "id"], "left").withColumn("version", version.cast("long")).drop("__version")
    numbers = numbered(placed, ["scope_key"], "seq", "__number", known.heads).withColumn("change_id", change_id(F.col("__number")))
    return numbers.select(*(F.col(f"`{c}`") for c in placed.columns if c != "version"), "change_id", "version")


def scope_of(log: DataFrame | Known, rows: DataFrame) -> DataFrame:
    """rows(table, id) with the scope of their newest change; null for a row that was never seen."""
    known = log if isinstance(log, Known) else Known.of(log)
    return rows.join(known.rows.select("table", "id", "scope_key"), ["table", "id"], "left")


def versions_of(changes: DataFrame) -> DataFrame:
    """changes(table, id, seq) with the running version of each row: 1, 2, ..."""
    return changes.withColumn("version", F.row_number().over(Window.partitionBy("table", "id").orderBy("seq")))


def first_sends(operations: DataFrame) -> DataFrame:
    """One row per (user_id, op_id): the one that came first by seq."""
    rest = [c for c in operations.columns if c not in ("user_id", "op_id")]
    return operations.groupBy("user_id", "op_id").agg(F.min_by(F.struct(*rest), "seq").alias("__r")).select("user_id", "op_id", *(F.col("__r")[c].alias(c) for c in rest))


def replay_or_new(operations: DataFrame, ledger: DataFrame, schema_version: int) -> tuple[DataFrame, DataFrame]:
    """(answered, new): operations the ledger knows, with the stored outcome and the change they made then, and the others.
    An operation known under another schema version is rejected."""
    ops = first_sends(operations)
    change = F.col("change") if "change" in ledger.columns else F.lit(None).cast(f"struct<{CHANGE_FIELDS}>")
    stored = ledger.select("user_id", "op_id", F.col("schema_version").alias("__v"), F.col("status").alias("__s"), F.col("error").alias("__e"), change.alias("change"))
    known = ops.join(stored, ["user_id", "op_id"])
    other = F.col("__v") != F.lit(schema_version)
    answered = known.select("user_id", "op_id", F.when(other, "rejected").otherwise(F.col("__s")).alias("outcome"), F.when(other, "schemaMismatch").otherwise(F.col("__e")).alias("error"), "change")
    return answered, ops.join(stored, ["user_id", "op_id"], "left_anti")


def wrong_type(table: TableDef, patch: Column) -> Column:
    """What is wrong with the values of set and counter fields, and with deltas over any field; null if nothing is.

    A delta fits a column of its kind, whether the row has a value there or not; a plain value of a declared set or
    counter field must be an array or a number.
    """
    wrong = F.lit(None).cast("string")
    # A text without the letters of a delta, and without escapes that could stand for them, holds none.
    delta = patch.contains("__lf") | patch.contains("\\")
    for f in reversed(table.shape.fields):
        kind = field_kind(patch, f.name)
        array, number = isinstance(f.dataType, T.ArrayType), is_number(f.dataType)
        no_array = (kind == "SET") & F.lit(not array) | (~kind.isin("SET", "ARRAY", "VOID") & F.lit(f.name in table.set_fields))
        no_number = (kind == "COUNTER") & F.lit(not number) | (~kind.isin("COUNTER", "VOID", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & F.lit(f.name in table.counter_fields))
        look = F.lit(True) if f.name in (*table.set_fields, *table.counter_fields) else delta
        wrong = F.when(look & no_array, f'non-array field "{f.name}"').when(look & no_number, f'non-number field "{f.name}"').otherwise(wrong)
    return wrong


def facts(table: TableDef, operations: DataFrame, canonical: DataFrame, functions: dict[str, tuple[str, tuple[str, ...]]], schema_version: int, roles: DataFrame | None = None, rule: Callable[[Column], Column] | None = None) -> DataFrame:
    """operations of a table with what decide() wants to know of them, and kind__, the kind of their function."""
    body = F.coalesce("patch", "value")
    ops = operations.withColumn("__fields", F.coalesce(F.json_object_keys(body), F.array().cast("array<string>")))
    kind, known, allowed = F.lit(None).cast("string"), F.lit(False), F.array().cast("array<string>")
    for name, (k, fields) in functions.items():
        hit = F.col("function_name") == name
        kind, known = F.when(hit, k).otherwise(kind), known | hit
        allowed = F.when(hit, F.array(*map(F.lit, fields)).cast("array<string>")).otherwise(allowed)
    server = F.array(*map(F.lit, table.server_fields)).cast("array<string>")
    mine = bool(table.scope and table.scope.kind == "byUser")
    scope = table.scope.field if table.scope else None
    none = F.lit(None).cast("string")
    asked = lambda side: F.get_json_object(side, f"$['{scope}']") if scope and not mine else none
    rows = canonical.select(F.col("_id").alias("__i"), (~F.coalesce("_deleted", F.lit(False))).alias("__alive"), (F.col(f"`{scope}`").cast("string") if scope else none).alias("__holder"))
    ops = ops.withColumns({"__kind": kind, "__wrong": wrong_type(table, body)}).join(rows, F.col("id") == F.col("__i"), "left")
    fixed = (
        F.when(F.col("schema_version") != schema_version, "schemaMismatch")
        .when(~known, "unknownFunction")
        .when(F.size(F.array_intersect("__fields", server)) > 0, "serverOnlyField")
        .when(F.size(F.array_except(F.array_remove("__fields", scope), allowed) if mine else F.array_except("__fields", allowed)) > 0, "unknownField")
        .when(F.col("__wrong").isNotNull(), F.col("__wrong"))
    )
    facts = {"__fixed": fixed, "__row": row_key(F.lit(table.name), F.col("id")), "__label": row_key(F.lit(table.name), F.col("id")), "__known": F.col("__i").isNotNull(), "__live": F.coalesce("__alive", F.lit(False)), "__mine": F.lit(mine), "__asked": asked("value"), "__moved": asked("patch")}
    ops = ops.withColumns(facts).drop("__i", "__alive", "__fields", "__wrong").withColumnRenamed("__kind", "kind__").withColumn("__kind", F.col("kind__"))
    if roles is not None and scope and not mine:
        ops = permissions(cut(ops), roles, rule)
    else:
        ops = ops.withColumn("__may", F.lit(None).cast("map<string,int>"))
    return ops


def judged(table: TableDef, operations: DataFrame, canonical: DataFrame, functions: dict[str, tuple[str, tuple[str, ...]]], schema_version: int, roles: DataFrame | None = None, rule: Callable[[Column], Column] | None = None) -> DataFrame:
    """validate() with __kind, the kind of each operation's function, and __lead, the place of its unit in the order."""
    return decide(facts(table, operations, canonical, functions, schema_version, roles, rule)).withColumnRenamed("kind__", "__kind")


def validate(table: TableDef, operations: DataFrame, canonical: DataFrame, functions: dict[str, tuple[str, tuple[str, ...]]], schema_version: int, roles: DataFrame | None = None, rule: Callable[[Column], Column] | None = None) -> DataFrame:
    """operations with reject_reason (null: accepted) and no_op (an accepted delete of a row already gone).

    functions: kind and writable fields by function name. operations have seq (no ties), op_id, user_id, schema_version,
    function_name, id, value, patch and group_id. They are decided in sequence (see decide): each sees what the accepted ones
    before it leave. Whose row is another user's, and what a user has no role for, is rejected in the same words as what
    was never seen; so is a patch that would move a row to another scope. A row without a user is nobody's. A group with a
    rejected member is rejected whole and has no effect on what comes after. An owner that a client sends is ignored.

    roles(user_id, scope_value, role) and rule, a function of the role: who may write in a scope (None: all may).
    """
    done = judged(table, operations, canonical, functions, schema_version, roles, rule)
    return done.select(*(F.col(f"`{c}`") for c in operations.columns), "reject_reason", "no_op")


def own(table: TableDef, rows: DataFrame, user: str | Column) -> DataFrame:
    """Inserted rows with the owner column forced to the user."""
    return rows.withColumn(table.scope.field, user if isinstance(user, Column) else F.lit(user)) if table.scope and table.scope.kind == "byUser" else rows


def mint(rows: DataFrame, column: str, start: int) -> DataFrame:
    """A server-made running number after `start`, by seq."""
    return numbered(rows, [], "seq", column).withColumn(column, F.col(column) + F.lit(start))


def project(table: TableDef, rows: DataFrame) -> DataFrame:
    """Only synced columns (and _id, _version, _deleted) leave the server."""
    return rows.select(*[c for c in rows.columns if c in table.synced_fields or c in ("_id", "_version", "_deleted")])


def needs_bootstrap(cursors: DataFrame, log: DataFrame) -> DataFrame:
    """scope_key, cursor and gap: whether changes after the cursor were collected, so that the scope must start anew.

    cursors(scope_key, cursor); a null cursor always starts anew. A cursor at the last change is no gap.
    """
    joined = cursors.join(bounds(log), "scope_key", "left")
    behind = F.coalesce(change_number(F.col("first_id")) > change_number(F.col("cursor")) + 1, F.lit(False))
    return joined.select("scope_key", "cursor", (F.col("cursor").isNull() | behind).alias("gap"), F.coalesce("last_id", F.lit(EMPTY_CURSOR)).alias("end_cursor"))


def pull(log: DataFrame, cursors: DataFrame, budget: int, scopes: int = 64) -> DataFrame:
    """Changes after each scope's cursor, within one budget that is spent in the order of the request:
    cursors(scope_key, cursor, position). has_more: the scope has changes that did not fit. A request for more than
    `scopes` different scopes is refused. No task keeps more than `budget` changes of a scope."""
    asked = cursors.groupBy("scope_key").agg(F.min("position").alias("position"), F.max("cursor").alias("cursor"))
    if asked.limit(scopes + 1).count() > scopes:
        raise ValueError(f"a pull may name {scopes} scopes at most")
    wanted = log.join(F.broadcast(asked), "scope_key").filter(F.col("change_id") > F.coalesce("cursor", F.lit("")))  # scopes rows at most
    sizes = wanted.groupBy("scope_key", "position").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("position", "scope_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = sizes.withColumn("room", F.greatest(F.lit(0), F.lit(budget) - before)).withColumn("has_more", F.col("n") > F.col("room"))
    at = F.row_number().over(Window.partitionBy("scope_key").orderBy("change_id"))
    first = wanted.withColumn("__at", at).filter(F.col("__at") <= budget)  # a literal bound: Spark cuts each task's rows before the shuffle
    return first.join(F.broadcast(room.select("scope_key", "room", "has_more")), "scope_key").filter(F.col("__at") <= F.col("room")).drop("__at", "room", "cursor")


def starved(log: DataFrame, cursors: DataFrame, budget: int, scopes: int = 64) -> DataFrame:
    """Scopes of a pull that have changes but got none: they must be asked for again from the cursor they had."""
    behind = log.join(F.broadcast(cursors.select("scope_key", "cursor")), "scope_key").filter(F.col("change_id") > F.coalesce("cursor", F.lit(""))).select("scope_key").distinct()
    return behind.join(pull(log, cursors, budget, scopes).select("scope_key").distinct(), "scope_key", "left_anti")


def bootstrap(log: DataFrame, versions: DataFrame, scope: str, limit: int, after: str | None = None, end_cursor: str | None = None) -> tuple[DataFrame, str, bool]:
    """(page, end cursor, has_more) of a scope's rows by row key. The end cursor is the last change when the first page is
    read and is handed back for the others; after the last page has_more says whether the log went on meanwhile."""
    last = log.filter(F.col("scope_key") == scope).agg(F.max("change_id")).first()[0] or EMPTY_CURSOR
    end_cursor = end_cursor or last
    found = cut(snapshot_page(versions, scope, after, limit + 1))  # read once: the page and whether more follows are of one state
    return found.orderBy("row_key").limit(max(0, limit)), end_cursor, found.count() > limit or last > end_cursor


def scope_states(cursors: DataFrame, roles: DataFrame, operations: DataFrame) -> DataFrame:
    """scope_key, cursor, role, pending and rejected of every scope that any of them knows, sorted by key."""
    work = operations.groupBy("scope_key").agg(F.count_if(F.col("status").isin("pending", "pushing")).alias("pending"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    joined = cursors.select("scope_key", "cursor").join(roles.select("scope_key", "role"), "scope_key", "full").join(work, "scope_key", "full")
    return joined.withColumns({"pending": F.coalesce("pending", F.lit(0)), "rejected": F.coalesce("rejected", F.lit(0))}).orderBy("scope_key")


def stamped(operations: DataFrame, high_water: float, now: float) -> DataFrame:
    """operations(seq) with created_at: later than everything before (the high-water mark) and strictly increasing."""
    return numbered(operations, [], "seq", "__n").withColumn("created_at", F.greatest(F.lit(float(now)), F.lit(float(high_water) + 1)) + F.col("__n") - 1).drop("__n")


def sortable_ids(prefix: str, at: Column, counter: Column, salt: Column) -> Column:
    """Ids that sort by time, then by a counter, and end in a hash of their salt: prefix_time_counter_hash."""
    return F.concat_ws("_", F.lit(prefix), F.lpad(F.lower(F.hex(at.cast("bigint"))), 12, "0"), F.lpad(F.lower(F.hex(counter)), 8, "0"), F.lpad(F.lower(F.hex(F.xxhash64(salt, at, counter))), 16, "0"))


def visible_changes(changes: DataFrame, current: DataFrame, visible: Column) -> DataFrame:
    """Changes as a reader may see them, by the current row: an unseen row is a delete without data, any other the whole
    row of now. visible is a Column over current; history never leaves."""
    row = F.struct(*(F.col(f"`{c}`") for c in current.columns if c != "_id"))
    now = current.select(F.col("_id").alias("__i"), F.coalesce(visible, F.lit(False)).alias("__see"), F.to_json(row).alias("__row"))
    joined = changes.join(now, F.col("id") == F.col("__i"), "left")
    see = F.coalesce("__see", F.lit(False)) & (F.col("kind") != "delete")
    return joined.select("scope_key", "change_id", "table", "id", F.when(see, "insert").otherwise("delete").alias("kind"), F.when(see, F.col("__row")).alias("value"), "version")


def collect_garbage(log: DataFrame, horizon, keep_newest: bool = True) -> DataFrame:
    """The log without changes older than the horizon; keep_newest spares the newest change of each scope."""
    if not keep_newest:
        return log.filter(F.col("server_time") >= F.lit(horizon))
    last = log.groupBy("scope_key").agg(F.max("change_id").alias("change_id")).withColumn("__last", F.lit(True))
    return log.join(last, ["scope_key", "change_id"], "left").filter((F.col("server_time") >= F.lit(horizon)) | F.col("__last")).drop("__last")


def garbage_batch(log: DataFrame, horizon, batch: int = 32) -> DataFrame:
    """The next changes that a global collection removes: oldest first, a batch at a time."""
    return log.filter(F.col("server_time") < F.lit(horizon)).orderBy("server_time", "scope_key", "change_id").limit(batch)


def configured(log: DataFrame, tables: list[str]) -> DataFrame:
    return log.filter(F.col("table").isin(*tables)) if tables else log.limit(0)


def evict_scopes(rows: DataFrame, scope_column: str, denied: DataFrame) -> DataFrame:
    """Rows outside the denied scopes; denied(scope_value)."""
    return rows.join(denied.select(F.col("scope_value").alias(scope_column)), scope_column, "left_anti")


def retired(operations: DataFrame, schema_version: int) -> DataFrame:
    """Pending operations made under an older schema: listed, never applied."""
    return operations.filter(F.col("status").isin("pending", "pushing") & (F.col("schema_version") < schema_version))


def chunks(operations: DataFrame, size: int) -> DataFrame:
    """operations(scope_key, seq, op_id, group_id) with chunk numbers of about `size`; a group is never cut. Units are placed
    in two passes, so a scope with most of the operations is spread over many tasks."""
    marked = operations.withColumn("__unit", F.coalesce("group_id", "op_id"))
    units = marked.groupBy("scope_key", "__unit").agg(F.min("seq").alias("__first"), F.count("*").alias("__n"))
    before = running(units, ["scope_key"], "__first", "__n", "__before").select("scope_key", "__unit", "__before")
    return marked.join(before, ["scope_key", "__unit"]).withColumn("chunk", F.floor(F.col("__before") / size).cast("int")).drop("__unit", "__before")


def recovery(operations: DataFrame) -> DataFrame:
    """Rejected work to show a user: single operations, and groups as one."""
    rejected = operations.filter("status = 'rejected'")
    unit = F.coalesce("group_id", "op_id")
    folded = rejected.groupBy(unit.alias("unit")).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("group_index", F.lit(0)).alias("i"), "op_id"))).alias("__o"), F.sort_array(F.collect_set("table")).alias("tables"), F.min("created_at").alias("created_at"), F.min_by("error", F.struct(F.coalesce("group_index", F.lit(0)), "op_id")).alias("error"))
    return folded.select("unit", F.transform("__o", lambda x: x["op_id"]).alias("op_ids"), "tables", "created_at", "error")


def pending_count(operations: DataFrame) -> DataFrame:
    return operations.agg(F.count_if(F.col("status").isin("pending", "pushing")).alias("n"))


def storage_stats(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows per table, and number and bytes of blobs."""
    return rows.groupBy(F.col("_table").alias("name")).agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("bytes")).union(blobs.agg(F.lit("blobs"), F.count("*"), F.coalesce(F.sum(F.length("data")), F.lit(0))))


def present(heartbeats: DataFrame, now: float, ttl_ms: int = 30_000) -> DataFrame:
    """The latest heartbeat of each client of a scope that is not older than the time to live and not a farewell."""
    last = heartbeats.groupBy("scope_key", "client_id").agg(F.max_by(F.struct("user_id", "data", "leaving", "updated_at"), "updated_at").alias("h"))
    return last.select("scope_key", "client_id", "h.*").filter((F.col("updated_at") > F.lit(now - ttl_ms)) & ~F.coalesce("leaving", F.lit(False))).drop("leaving")


def needs_compaction(documents: DataFrame, rows: int = 100, size: int = 1 << 20) -> DataFrame:
    """Documents whose update log has grown to `rows` updates or `size` bytes; of updates sent twice one counts."""
    distinct = documents.groupBy("doc", "id").agg(F.max(F.length("update")).alias("bytes"))
    return distinct.groupBy("doc").agg(F.count("*").alias("updates"), F.sum("bytes").alias("bytes")).filter((F.col("updates") >= rows) | (F.col("bytes") >= size))
