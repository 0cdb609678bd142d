"""Folding change logs into canonical rows, and replaying pending operations on top.

Tables are frames with `_id`, the columns of their shape, `_version` and `_deleted`.

A change log has change_id, id, kind (insert, replace, patch, delete), version, op_id, and the JSON strings value (full
row) and patch (only the fields it sets: absent and null differ). Changes apply in the order of change_id. One is stale
if its version is below the row's, or equal to it and not a full row. A row is deleted if the last change it accepted is
a delete; any other revives it.

The fold needs no list of a row's history: what is stale follows from the running maximum of versions, and each column
is the value of the last change that set it since the last full row. So both steps are a window and an aggregation over
the same partitioning, and a row with a long history costs no more memory than others.

Pending operations have op_id, id, kind, status, created_at, group_id, group_index, error, value and patch. They are few
per row (an outbox), so they are replayed from an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json import json_object, json_value
from ..functions.sets import apply_counter_delta, apply_set_delta
from ..plans.catalog import SYSTEM, TableDef

LIVE = ("pending", "pushing", "acked")


def _columns(table: TableDef) -> list[T.StructField]:
    return list(table.shape.fields)


def _keys(json: Column) -> Column:
    return F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))


def fold(table: TableDef, canonical: DataFrame, changes: DataFrame) -> DataFrame:
    """The canonical rows after the changes, deleted ones kept as tombstones."""
    fields = _columns(table)
    whole = T.StructType(fields)
    base = canonical.select(F.col("_id").alias("id"), F.lit(0).cast("long").alias("seq"), F.lit("base").alias("kind"), F.col("_version").alias("version"), F.struct(*(F.col(f"`{f.name}`") for f in fields)).alias("row"), F.lit(None).cast("array<string>").alias("keys"), F.coalesce("_deleted", F.lit(False)).alias("gone"))
    full = F.col("kind").isin("insert", "replace")
    body = F.when(full, F.col("value")).when(F.col("kind") == "patch", F.col("patch"))
    log = changes.select("id", F.col("change_id").cast("bigint").alias("seq"), "kind", F.col("version").cast("long").alias("version"), F.from_json(body, whole).alias("row"), F.when(F.col("kind") == "patch", _keys(F.col("patch"))).alias("keys"), F.lit(False).alias("gone"))
    order = Window.partitionBy("id").orderBy("seq", "version")
    before = F.max("version").over(order.rowsBetween(Window.unboundedPreceding, -1))
    every = base.union(log).withColumn("__before", before)
    stale = (F.col("version") < F.col("__before")) | ((F.col("version") == F.col("__before")) & ~full)
    taken = every.filter((F.col("kind") == "base") | F.col("__before").isNull() | ~stale)
    # A row arrives whole as base, insert or replace; what was set before the last of these is gone.
    start = F.max(F.when(full | (F.col("kind") == "base"), F.col("seq"))).over(Window.partitionBy("id"))
    taken = taken.withColumn("__start", F.coalesce(start, F.lit(-1))).filter(F.col("seq") >= F.col("__start"))
    grouped = taken.groupBy("id").agg(
        F.max_by(F.when(F.col("kind") == "base", F.col("gone")).otherwise(F.col("kind") == "delete"), F.struct("seq", "version")).alias("_deleted"),
        F.max("version").alias("_version"),
        *(F.max_by(F.struct(F.col("row")[f.name].alias("v")), F.when((F.col("kind") != "delete") & (F.col("keys").isNull() | F.array_contains("keys", f.name)), F.col("seq"))).alias(f"__{f.name}") for f in fields),
    )
    return grouped.select(F.col("id").alias("_id"), *(F.col(f"__{f.name}")["v"].alias(f.name) for f in fields), "_version", "_deleted")


def operation_order() -> list[Column]:
    """created_at; then groups as units, by their smallest op_id; inside a group by index; then op_id."""
    lead = F.coalesce(F.min("op_id").over(Window.partitionBy("group_id", "created_at")), F.col("op_id"))
    return [F.col("created_at"), F.when(F.col("group_id").isNull(), F.col("op_id")).otherwise(lead), F.coalesce(F.col("group_index"), F.lit(0)), F.col("op_id")]


def _patched(table: TableDef, field: T.StructField, row: Column, patch: Column, keys: Column, sets: Column, counts: Column) -> Column:
    name = field.name
    value = patch[name]
    if name in table.set_fields:
        delta = sets[name]
        value = F.when(delta.isNotNull(), apply_set_delta(row[name], delta["add"], delta["remove"])).otherwise(value)
    if name in table.counter_fields:
        value = F.when(counts[name].isNotNull(), apply_counter_delta(row[name], counts[name]).cast(field.dataType)).otherwise(value)
    return F.when(F.array_contains(keys, name), value).otherwise(row[name]).alias(name)


def derive_view(table: TableDef, canonical: DataFrame, operations: DataFrame) -> DataFrame:
    """The live view: canonical rows with operations replayed, `_pending`, and `_conflict` where one could not be or was
    rejected by the server (a later one wins). A row that neither the canonical table nor an insert knows is not made up."""
    fields = _columns(table)
    whole = T.StructType(fields)
    plain = T.StructType([f for f in fields if f.name not in table.set_fields and f.name not in table.counter_fields])
    text = F.col("patch")
    sets = F.struct(*(F.from_json(F.get_json_object(text, f"$.{f.name}.__lfSet"), T.StructType([T.StructField("add", f.dataType), T.StructField("remove", f.dataType)])).alias(f.name) for f in fields if f.name in table.set_fields), F.lit(0).alias("__none"))
    counts = F.struct(*(F.get_json_object(text, f"$.{f.name}.__lfCounter").cast("double").alias(f.name) for f in fields if f.name in table.counter_fields), F.lit(0).alias("__none"))
    lone = F.struct(*(F.from_json(text, T.StructType([f]))[f.name].alias(f.name) if f.name not in plain.fieldNames() else F.from_json(text, plain)[f.name].alias(f.name) for f in fields))
    replay = operations.filter(F.col("status").isin(*LIVE))
    for i, c in enumerate(operation_order()):
        replay = replay.withColumn(f"__o{i}", c)
    entry = F.struct("__o0", "__o1", "__o2", "__o3", "op_id", "kind", F.from_json("value", whole).alias("value"), lone.alias("patch"), _keys(text).alias("keys"), sets.alias("sets"), counts.alias("counts"))
    queue = replay.groupBy(F.col("id").alias("__id")).agg(F.array_sort(F.collect_list(entry)).alias("__ops"))
    struct = F.struct(*(F.col(f"`{f.name}`") for f in fields))
    base = canonical.select("_id", F.struct(struct.alias("row"), (~F.coalesce("_deleted", F.lit(False))).alias("live"), F.lit(True).alias("known"), F.col("_version").alias("version"), F.lit(False).alias("pending"), F.lit(None).cast("string").alias("failed"), F.lit(None).cast("string").alias("failed_op")).alias("__s"))
    joined = base.join(queue, F.col("_id") == F.col("__id"), "full").select(F.coalesce("_id", "__id").alias("_id"), "__s", "__ops")
    nothing = F.struct(F.lit(None).cast(whole).alias("row"), F.lit(False).alias("live"), F.lit(False).alias("known"), F.lit(None).cast("long").alias("version"), F.lit(False).alias("pending"), F.lit(None).cast("string").alias("failed"), F.lit(None).cast("string").alias("failed_op"))

    def step(s: Column, op: Column) -> Column:
        insert, patch, delete = (op["kind"] == k for k in ("insert", "patch", "delete"))
        ok = insert | (patch & s["live"]) | (delete & s["known"])
        changed = F.struct(*(_patched(table, f, s["row"], op["patch"], op["keys"], op["sets"], op["counts"]) for f in fields))
        return F.struct(
            F.when(insert, op["value"]).when(patch & ok, changed).otherwise(s["row"]).alias("row"),
            F.when(insert, True).when(delete & ok, False).otherwise(s["live"]).alias("live"),
            (s["known"] | insert).alias("known"),
            F.when(insert, F.lit(None).cast("long")).otherwise(s["version"]).alias("version"),
            (s["pending"] | ok).alias("pending"),
            F.when(ok, s["failed"]).otherwise(F.concat(F.lit("Cannot replay "), op["kind"], F.lit(" over a missing row"))).alias("failed"),
            F.when(ok, s["failed_op"]).otherwise(op["op_id"]).alias("failed_op"),
        )

    empty_ops = F.filter(F.col("__ops"), lambda x: F.lit(False))
    folded = joined.select("_id", F.aggregate(F.coalesce("__ops", empty_ops, F.array().cast(joined.schema["__ops"].dataType)), F.coalesce("__s", nothing), step).alias("s")).filter("s.known")
    rejected = operations.filter("status = 'rejected'").groupBy(F.col("id").alias("__rid")).agg(F.max_by(F.struct("op_id", "error"), F.struct("created_at", "op_id")).alias("__r"))
    out = folded.join(rejected, F.col("_id") == F.col("__rid"), "left")
    conflict = F.when(F.col("__r").isNotNull(), F.struct(F.lit("serverRejected").alias("kind"), F.col("__r.error").alias("message"), F.col("__r.op_id").alias("opId"), F.col("s.version").alias("serverVersion"))).when(
        F.col("s.failed").isNotNull(), F.struct(F.lit("mergeFailed").alias("kind"), F.col("s.failed").alias("message"), F.col("s.failed_op").alias("opId"), F.col("s.version").alias("serverVersion"))
    )
    return out.select("_id", *(F.col("s.row")[f.name].alias(f.name) for f in fields), F.col("s.version").alias("_version"), (~F.col("s.live")).alias("_deleted"), F.col("s.pending").alias("_pending"), conflict.alias("_conflict"))


def confirmed(operations: DataFrame, changes: DataFrame) -> DataFrame:
    """The operations that no change carries yet, stale or not. Where both sides say whose they are, an operation is only
    confirmed by a change of its own user, who may share op_ids with others."""
    same = ["op_id", *(["user_id"] if "user_id" in operations.columns and "user_id" in changes.columns else [])]
    return operations.join(changes.filter("op_id is not null").select(*same).distinct(), same, "left_anti")


def row_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """_id, kind (upsert, delete), row and `was` (the row before) of every row that came, went or changed; deleted rows count
    as gone."""
    cols = [c for c in new.columns if c in old.columns]
    live = [df.filter(~F.coalesce(F.col("_deleted"), F.lit(False))) if "_deleted" in df.columns else df for df in (old, new)]
    a, b = (df.select(F.col("_id").alias(k), F.struct(*(F.col(f"`{c}`") for c in cols)).alias(r)) for df, k, r in ((live[0], "i", "o"), (live[1], "j", "n")))
    both = a.join(b, F.col("i") == F.col("j"), "full").filter(~F.col("o").eqNullSafe(F.col("n")))
    return both.select(F.coalesce("i", "j").alias("_id"), F.when(F.col("n").isNull(), "delete").otherwise("upsert").alias("kind"), F.col("n").alias("row"), F.col("o").alias("was"))


def inverse_operations(table: TableDef, operations: DataFrame, before: DataFrame) -> DataFrame:
    """What undoes each operation, given the rows before it: op_id, id, kind, value and patch as JSON."""
    own = [f for f in _columns(table) if f.name not in table.server_fields]
    row = F.struct(*(F.col(f"b.`{f.name}`") for f in own))
    joined = operations.alias("o").join(before.alias("b"), F.col("o.id") == F.col("b._id"), "left")
    keys = _keys(F.col("o.patch"))
    touched = json_object([(f.name, F.array_contains(keys, f.name), json_value(F.col(f"b.`{f.name}`"))) for f in own])
    kind = F.when(F.col("o.kind") == "insert", "delete").when((F.col("o.kind") == "delete") & F.col("b._id").isNotNull(), "insert").when((F.col("o.kind") == "patch") & F.col("b._id").isNotNull() & ~F.coalesce(F.col("b._deleted"), F.lit(False)), "patch")
    return joined.select("o.op_id", "o.id", kind.alias("kind"), F.when(kind == "insert", F.to_json(row, {"ignoreNullFields": "false"})).alias("value"), F.when(kind == "patch", touched).alias("patch")).filter("kind is not null")


def undo(table: TableDef, entries: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(operations, counter-entries) of undoing or redoing entries(unit, position, op_id, id, kind, value, patch), which
    inverse_operations made when the unit was done.

    A patch of a row that is gone by now is left out and does not bring it back; an insert does. The operations keep their
    order; the counter-entries, taken from the rows as they are now, come in reverse, as what undoes them again.
    """
    row = current.select(F.col("_id").alias("__i"), (~F.coalesce(F.col("_deleted"), F.lit(False)) if "_deleted" in current.columns else F.lit(True)).alias("__live"))
    joined = entries.join(row, F.col("id") == F.col("__i"), "left")
    valid = joined.filter((F.col("kind") != "patch") | F.coalesce("__live", F.lit(False))).drop("__i", "__live")
    counter = inverse_operations(table, valid, current.filter(F.coalesce(~F.col("_deleted"), F.lit(True))) if "_deleted" in current.columns else current)
    at = valid.select("unit", F.col("op_id").alias("__o"), F.col("position").alias("__at"))
    return valid, counter.join(at, F.col("op_id") == F.col("__o")).withColumn("position", -F.col("__at")).drop("__o", "__at")


def after_new_action(redo: DataFrame, acted: DataFrame) -> DataFrame:
    """The redo entries that are left when new actions were taken in scopes: those of other scopes."""
    return redo.join(acted.select("scope_key").distinct(), "scope_key", "left_anti")


def undo_stack(history: DataFrame, depth: int = 100) -> DataFrame:
    """The latest `depth` undo units per scope (a group is one), newest first: history(scope_key, op_id, group_id, created_at)."""
    unit = F.coalesce("group_id", "op_id")
    units = history.groupBy("scope_key", unit.alias("unit")).agg(F.max("created_at").alias("at"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("scope_key").orderBy(F.desc("at"), F.desc("unit")))
    kept = units.withColumn("position", rank).filter(F.col("position") <= depth)  # the rank cuts each task's rows first
    own = history.withColumn("unit", unit).join(kept.select("scope_key", "unit"), ["scope_key", "unit"], "left_semi")
    ops = own.groupBy("scope_key", "unit").agg(F.sort_array(F.collect_list("op_id"), asc=False).alias("op_ids"))  # one action's operations
    return kept.join(ops, ["scope_key", "unit"]).select("scope_key", "unit", "at", "op_ids", "position")


def strip(table: TableDef, rows: DataFrame) -> DataFrame:
    """Rows without system and server columns."""
    return rows.drop(*[c for c in rows.columns if c in SYSTEM and c != "_id" or c in table.server_fields])
