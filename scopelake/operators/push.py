"""A push: operations of clients are answered once, validated, resolved against the rows as they are, and logged.

Also what surrounds it: patches turned into deltas when they are made, before and after images of what was written, writes
by the server itself, and write rules.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json import field_kind, json_object, json_value
from ..functions.sets import set_delta
from ..functions.values import is_number
from ..plans.catalog import TableDef
from ..sources.shared import cut, numbered
from .decide import decide
from .log import CHANGE_FIELDS, Known, append, facts, judged, replay_or_new, scope_of
from .view import _keys, _patched


def _deltas(table: TableDef, text: Column, kind: str) -> Column:
    """The set or counter deltas of a patch by field, null where the field holds a plain value."""
    out = []
    for f in table.shape.fields:
        if kind == "set" and f.name in table.set_fields:
            shape = T.StructType([T.StructField("add", f.dataType), T.StructField("remove", f.dataType)])
            out.append(F.from_json(F.get_json_object(text, f"$.{f.name}.__lfSet"), shape).alias(f.name))
        elif kind == "counter" and f.name in table.counter_fields:
            out.append(F.get_json_object(text, f"$.{f.name}.__lfCounter").cast("double").alias(f.name))
    return F.struct(*out, F.lit(0).alias("__none"))


def _row(table: TableDef, text: Column) -> Column:
    """The plain values of a JSON row or patch; a field that holds a delta reads null."""

    def plain(f: T.StructField) -> Column:
        value = F.from_json(text, T.StructType([f]))[f.name]
        kinds = [k for k, names, fits in (("__lfSet", table.set_fields, isinstance(f.dataType, T.ArrayType)), ("__lfCounter", table.counter_fields, is_number(f.dataType))) if f.name in names and fits]
        # An object where an array or a number belongs costs Spark's reader an exception, so a delta is looked for first.
        return F.when(F.get_json_object(text, f"$.{f.name}.{kinds[0]}").isNull(), value) if kinds else value

    return F.struct(*(plain(f).alias(f.name) for f in table.shape.fields))


def merge_patch(table: TableDef, rows: DataFrame, patch: Column) -> DataFrame:
    """rows with a JSON patch merged in: set and counter deltas by their kind, other fields overwritten, absent ones kept."""
    fields = list(table.shape.fields)
    row = F.struct(*(F.col(f"`{f.name}`") for f in fields))
    staged = rows.select("*", row.alias("__row"), _row(table, patch).alias("__patch"), _keys(patch).alias("__keys"), _deltas(table, patch, "set").alias("__sets"), _deltas(table, patch, "counter").alias("__counts"))
    parts = (F.col(c) for c in ("__row", "__patch", "__keys", "__sets", "__counts"))
    parts = list(parts)
    return staged.withColumns({f.name: _patched(table, f, *parts) for f in fields}).drop("__row", "__patch", "__keys", "__sets", "__counts")


def _element(x):
    """What stands for an element where elements are compared: null is null, NaN is NaN."""
    return "NaN" if isinstance(x, float) and x != x else repr(x) if isinstance(x, (dict, list)) else x


def _set_after(current: list | None, add: list | None, remove: list | None) -> list | None:
    """sets.apply_set_delta() of plain lists."""
    if current is None and add is None and remove is None:
        return None
    gone, kept = set(map(_element, remove or [])), {}
    for x in [*(current or []), *(add or [])]:
        if (e := _element(x)) not in gone:
            kept.setdefault(e, x)
    return list(kept.values())


def _number(kind: T.DataType, x: float):
    """A sum as a column of the kind holds it, as a cast makes it."""
    if isinstance(kind, T.IntegralType):
        return math.trunc(x)
    if isinstance(kind, T.DecimalType):
        return Decimal(repr(x)).quantize(Decimal(1).scaleb(-kind.scale), ROUND_HALF_UP)
    return float(np.float32(x)) if isinstance(kind, T.FloatType) else x


def _resolver(kinds: list[T.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs down operations sorted by row and seq with the delta fields of one row, and gives them out after each delta."""

    def after(kind: T.DataType, current, delta):
        if isinstance(kind, T.ArrayType):
            return _set_after(current, delta["add"], delta["remove"])
        return _number(kind, float(current or 0) + delta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = range(len(kinds))
        row, state = object(), []
        for batch in batches:
            ids, wanted = batch.column("id").to_pylist(), batch.column("__delta").to_pylist()
            has, plain, deltas = ([batch.column(f"__{c}{j}").to_pylist() for j in fields] for c in "hpd")
            at, out = [], [[] for _ in fields]
            for i, own in enumerate(ids):
                if own != row:
                    row, state = own, [None] * len(kinds)
                for j in fields:
                    if has[j][i]:
                        state[j] = plain[j][i] if deltas[j][i] is None else after(kinds[j], state[j], deltas[j][i])
                if wanted[i]:
                    at.append(i)
                    for j in fields:
                        out[j].append(state[j])
            arrays = [pa.array(values, batch.column(f"__p{j}").type) for j, values in enumerate(out)]
            yield pa.RecordBatch.from_arrays([batch.column("__op").take(pa.array(at, pa.int64())), *arrays], names=["__op", *(f"__p{j}" for j in fields)])

    return run


def materialize(table: TableDef, operations: DataFrame, canonical: DataFrame) -> DataFrame:
    """operations(seq, id, kind, value, patch, ...) whose patches hold plain values: each delta is resolved against the row as
    the operations before it leave it, an absent field counting as empty or zero. seq has no ties.

    Only rows that a delta meets take part. Their operations are sorted by row and read once, holding the set and counter
    fields of one row and no history, so a row with a long history costs no more memory than others.
    """
    fields = [f for f in table.shape.fields if f.name in (*table.set_fields, *table.counter_fields)]
    if not fields:
        return operations
    patch, keys = F.col("patch"), _keys(F.col("patch"))
    kinds = [field_kind(patch, f.name).isin("SET", "COUNTER") for f in fields]
    marked = operations.withColumn("__delta", F.exists(F.array(*kinds), lambda x: F.coalesce(x, F.lit(False))))
    touched = marked.filter("__delta").select(F.col("id").alias("__t")).distinct()
    whole, part = ~F.col("kind").isin("patch", "delete"), F.col("kind") == "patch"
    sets, counts = _deltas(table, patch, "set"), _deltas(table, patch, "counter")
    value, own = _row(table, F.col("value")), _row(table, patch)
    columns = {}
    for j, f in enumerate(fields):
        columns |= {f"__h{j}": whole | (part & F.array_contains(keys, f.name)), f"__p{j}": F.when(whole, value[f.name]).otherwise(own[f.name])}
        columns[f"__d{j}"] = F.when(part, (sets if f.name in table.set_fields else counts)[f.name])
    ops = marked.join(touched, F.col("id") == F.col("__t"), "left_semi").withColumns(columns).select("id", F.lit(1).alias("__turn"), F.col("seq").alias("__op"), "__delta", *columns)
    types = {f.name: f.dataType for f in ops.schema.fields}
    base = canonical.join(touched, F.col("_id") == F.col("__t"), "left_semi").select(
        F.col("_id").alias("id"), F.lit(0).alias("__turn"), F.lit(None).cast(types["__op"]).alias("__op"), F.lit(False).alias("__delta"),
        *(c for j, f in enumerate(fields) for c in (F.lit(True).alias(f"__h{j}"), F.col(f"`{f.name}`").alias(f"__p{j}"), F.lit(None).cast(types[f"__d{j}"]).alias(f"__d{j}"))),
    )
    schema = T.StructType([T.StructField("__op", types["__op"]), *(T.StructField(f"__p{j}", f.dataType) for j, f in enumerate(fields))])
    # A window asks for each row's operations in one task, sorted; a repartition() may be optimized away above a union.
    turn = F.row_number().over(Window.partitionBy("id").orderBy("__turn", "__op"))
    after = base.unionByName(ops).withColumn("__turn", turn).mapInArrow(_resolver([f.dataType for f in fields]), schema)
    at = {f.name: F.col(f"__p{j}") for j, f in enumerate(fields)}
    plain = json_object([(f.name, F.array_contains(keys, f.name), json_value(at.get(f.name, own[f.name]))) for f in table.shape.fields])
    out = marked.join(after, F.col("seq") == F.col("__op"), "left")
    return out.withColumn("patch", F.when(F.col("__delta"), plain).otherwise(patch)).drop("__delta", *schema.names)


def field_deltas(table: TableDef, operations: DataFrame, live: DataFrame) -> DataFrame:
    """operations whose patches of declared set and counter fields are deltas from the live row: what one client adds does
    not undo what another adds. Values of a wrong type, and deltas, stay as they are."""
    fields = [f for f in table.shape.fields if f.name in (*table.set_fields, *table.counter_fields)]
    if not fields:
        return operations
    now = live.select(F.col("_id").alias("__i"), F.struct(*(F.col(f"`{f.name}`") for f in fields)).alias("__now"))
    # What is read from a patch is a column of its own: as a part of what compares elements it would be read again for each.
    read, patch = {"__keys": _keys(F.col("patch"))}, F.col("patch")
    for j, f in enumerate(fields):
        read |= {f"__k{j}": field_kind(patch, f.name), f"__w{j}": F.from_json(patch, T.StructType([f]))[f.name]}
    joined = operations.join(now, F.col("id") == F.col("__i"), "left").withColumns(read)
    parts = []
    for f in table.shape.fields:
        raw = json_value(F.from_json(patch, T.StructType([f]))[f.name])
        text = F.to_json(F.try_variant_get(F.try_parse_json(patch), f"$['{f.name}']", "variant"))
        value = F.coalesce(text, raw)
        if f in fields:
            j = fields.index(f)
            kind, want, old = F.col(f"__k{j}"), F.col(f"__w{j}"), F.col("__now")[f.name]
        if f.name in table.set_fields:
            add, remove = set_delta(old, want)
            value = F.when((kind == "ARRAY") & F.col("__i").isNotNull(), F.concat(F.lit('{"__lfSet":{"add":'), json_value(add), F.lit(',"remove":'), json_value(remove), F.lit("}}"))).otherwise(value)
        elif f.name in table.counter_fields:
            step = want - F.coalesce(old, F.lit(0))
            value = F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & F.col("__i").isNotNull(), F.concat(F.lit('{"__lfCounter":'), json_value(step), F.lit("}"))).otherwise(value)
        parts.append((f.name, F.array_contains("__keys", f.name), value))
    hit = (F.col("kind") == "patch") & F.arrays_overlap("__keys", F.array(*(F.lit(f.name) for f in fields)))
    return joined.withColumn("patch", F.when(hit, json_object(parts)).otherwise(patch)).drop("__i", "__now", *read)


def images(table: TableDef, canonical: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(change_id, id, kind, value, patch, op_id) with before and after: the row as each change found and left it,
    null where there is none. Patches hold plain values. A running last value per column: no history is collected."""
    fields = list(table.shape.fields)
    full = F.col("kind").isin("insert", "replace")
    keys = _keys(F.col("patch"))
    base = canonical.select(F.col("_id").alias("id"), F.lit("").alias("change_id"), F.lit("base").alias("kind"), F.lit(None).cast("string").alias("op_id"), (~F.coalesce("_deleted", F.lit(False))).alias("__live"), *(F.struct(F.col(f"`{f.name}`").alias("v")).alias(f"__{f.name}") for f in fields))
    body = _row(table, F.coalesce("value", "patch"))
    log = changes.select("id", "change_id", "kind", "op_id", (F.col("kind") != "delete").alias("__live"), *(F.when(full | F.array_contains(keys, f.name), F.struct(body[f.name].alias("v"))).alias(f"__{f.name}") for f in fields))
    order = Window.partitionBy("id").orderBy("change_id")
    sides = {}
    for name, frame in (("before", order.rowsBetween(Window.unboundedPreceding, -1)), ("after", order.rowsBetween(Window.unboundedPreceding, Window.currentRow))):
        row = F.struct(*(F.last(f"__{f.name}", ignorenulls=True).over(frame)["v"].alias(f.name) for f in fields))
        sides[name] = F.when(F.last("__live").over(frame), row)
    return base.union(log).withColumns(sides).filter("kind <> 'base'").select("change_id", "id", "kind", "op_id", "before", "after")


def can(table: TableDef, rules: dict[str, Callable[[Column], Column]], role: Column) -> Column:
    """Whether a role may write: TRUE for tables without a rule, unscoped ones and those of one user; where a rule is
    declared it decides, and no role means no."""
    rule = rules.get(table.name)
    if rule is None or table.scope is None or table.scope.kind == "byUser":
        return F.lit(True)
    return role.isNotNull() & F.coalesce(rule(role), F.lit(False))


@dataclass
class Push:
    """What a push makes: answers(user_id, op_id, outcome, error), changes of the log, ledger rows to keep (with the change
    that each operation made), redelivered changes of operations that were answered before, and `done`: the taken
    operations with user_id, function_name and change_id."""

    answers: DataFrame
    changes: DataFrame
    ledger: DataFrame
    redelivered: DataFrame
    done: DataFrame


_CHANGE = tuple(c.split(":")[0] for c in CHANGE_FIELDS.split(","))


def _with_fields(table: TableDef, text: Column, given: dict[str, Column]) -> Column:
    """The JSON object `text` with some fields set to JSON texts, whatever it had there."""
    keys = _keys(text)
    raw = lambda n: F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(text), f"$['{n}']", "variant")), F.lit("null"))
    return json_object([(f.name, F.lit(True), given[f.name]) if f.name in given else (f.name, F.array_contains(keys, f.name), raw(f.name)) for f in table.shape.fields])


def _forced(table: TableDef, taken: DataFrame, stamps: dict[str, int]) -> DataFrame:
    """Accepted operations whose inserts carry their user and the next server-made numbers, in the order of the push."""
    given = {}
    if table.scope and table.scope.kind == "byUser":
        given[table.scope.field] = json_value(F.col("user_id").cast(table.type_of(table.scope.field)))
    held = {table.id_field, *([table.scope.field] if table.scope else [])}
    if bad := sorted(c for c in stamps if c in held or c not in table.server_fields):
        raise ValueError(f"a stamp sets server columns other than the id and the scope: {bad}")
    if stamps:
        number = numbered(taken.filter("kind = 'insert'").select("seq"), [], "seq", "__n").withColumnRenamed("seq", "__s")
        taken = taken.join(number, F.col("seq") == F.col("__s"), "left").drop("__s")
        given |= {c: json_value((F.col("__n") + F.lit(start)).cast(table.type_of(c))) for c, start in stamps.items()}
    if not given:
        return taken
    return taken.withColumn("value", F.when(F.col("kind") == "insert", _with_fields(table, F.coalesce("value", F.lit("{}")), given)).otherwise(F.col("value"))).drop("__n")


def _taken(table: TableDef, checked: DataFrame, canonical: DataFrame, stamps: dict[str, int]) -> DataFrame:
    """The accepted operations of a table that change something, with plain values and what the server sets."""
    taken = checked.filter("reject_reason is null and not no_op").withColumns({"kind": F.col("__kind"), "seq": F.struct("__lead", "seq"), "table": F.lit(table.name)})
    return materialize(table, _forced(table, taken, stamps), canonical)


def _made(checked: DataFrame, taken: DataFrame, answered: DataFrame, known: Known, schema_version: int, now: float, scope_key: Column) -> Push:
    asked = F.last(F.when(F.col("kind") == "insert", F.col("__asked_key")), ignorenulls=True).over(Window.partitionBy("table", "id").orderBy("seq"))
    rows = scope_of(known, taken.withColumns({"server_time": F.lit(float(now)), "__asked_key": scope_key}).drop("scope_key"))
    rows = rows.withColumn("scope_key", F.coalesce(asked, "scope_key", "__asked_key")).select("scope_key", "table", "id", "kind", "value", "patch", "server_time", "op_id", "seq", "user_id", "function_name")
    done = cut(append(known, rows).drop("seq"))
    change = F.struct(*(F.col(f"`{c}`") for c in _CHANGE)).cast(f"struct<{CHANGE_FIELDS}>")
    outcome = F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected")
    fresh = checked.select("user_id", "op_id", F.lit(schema_version).alias("schema_version"), outcome.alias("status"), F.col("reject_reason").alias("error"))
    answers = answered.select("user_id", "op_id", "outcome", "error").union(fresh.select("user_id", "op_id", "status", "error"))
    fresh = fresh.join(done.select("user_id", "op_id", change.alias("change")), ["user_id", "op_id"], "left")
    again = answered.filter("change is not null and outcome = 'accepted'").select("change.*")
    return Push(answers, done.select(*_CHANGE), fresh, again, done)


def push(
    table: TableDef, operations: DataFrame, canonical: DataFrame, log: DataFrame | Known, ledger: DataFrame, functions: dict[str, tuple[str, tuple[str, ...]]], schema_version: int, now: float, scope_key: Column,
    roles: DataFrame | None = None, rules: dict[str, Callable[[Column], Column]] | None = None, stamps: dict[str, int] | None = None,
) -> Push:
    """Operations known to the ledger are answered as before, with the changes they made then, and do nothing; the others are
    validated, their deltas resolved, and appended to the log.

    Inserts belong to the user who sends them, whatever they say, and to the scope that scope_key, a Column over operations,
    names; patches and deletes to the scope of their row. log: the whole log, or what is known of it. With roles(user_id,
    scope_value, role) only members write, and where rules has the table its rule decides. stamps: server columns that
    inserts get running numbers in, with the last number given out. An operation is named by its user and op_id together.
    """
    answered, new = replay_or_new(operations, ledger, schema_version)
    checked = cut(judged(table, new, canonical, functions, schema_version, roles, (rules or {}).get(table.name)))
    known = log if isinstance(log, Known) else Known.of(log)
    return _made(checked, _taken(table, checked, canonical, stamps or {}), answered, known, schema_version, now, scope_key)


@dataclass
class Part:
    """A table that takes part in a push of several: its rows, and its functions by name."""

    table: TableDef
    canonical: DataFrame
    functions: dict[str, tuple[str, tuple[str, ...]]]
    stamps: dict[str, int] | None = None


def push_all(parts: list[Part], operations: DataFrame, log: DataFrame | Known, ledger: DataFrame, schema_version: int, now: float, scope_key: Column, roles: DataFrame | None = None, rules: dict[str, Callable[[Column], Column]] | None = None) -> Push:
    """push() of operations(table, ...) on several tables, whose groups may hold operations of more than one. An operation
    on another table is an unknown function."""
    answered, new = replay_or_new(operations, ledger, schema_version)
    new = cut(new)
    known = log if isinstance(log, Known) else Known.of(log)
    names = [p.table.name for p in parts]
    sides = [facts(p.table, new.filter(F.col("table") == p.table.name), p.canonical, p.functions, schema_version, roles, (rules or {}).get(p.table.name)) for p in parts]
    other = TableDef("", T.StructType([]))
    nothing = new.sparkSession.createDataFrame([], "_id string, _deleted boolean")
    sides.append(facts(other, new.filter(~F.coalesce(F.col("table").isin(*names), F.lit(False))), nothing, {}, schema_version))
    every = sides[0]
    for side in sides[1:]:
        every = every.unionByName(side)
    checked = cut(decide(every).withColumnRenamed("kind__", "__kind"))
    taken = None
    for p in parts:
        own = _taken(p.table, checked.filter(F.col("table") == p.table.name), p.canonical, p.stamps or {})
        taken = own if taken is None else taken.unionByName(own)
    return _made(checked, taken, answered, known, schema_version, now, scope_key)


def written(table: TableDef, canonical: DataFrame, made: Push) -> DataFrame:
    """What a push wrote, for those who follow it: user_id, function_name and the images of each change. Operations that the
    ledger answered are not in it, so each write is told once, with the push that first accepted it."""
    seen = images(table, canonical, made.changes).select("change_id", "id", "kind", "before", "after")
    return made.done.select("scope_key", "change_id", "id", "op_id", "user_id", "function_name").join(seen, ["change_id", "id"])


def server_write(table: TableDef, writes: DataFrame, log: DataFrame, now: float, scope_key: Column) -> DataFrame:
    """Changes of writes(seq, id, kind, value, patch) by the server itself: trusted, so not validated, but logged, numbered
    and stamped like any other; of their values only synced columns are logged."""
    made, changed = table.timestamps or (None, None)
    synced = [f for f in table.shape.fields if f.name not in table.server_fields]

    def body(c: str, stamps: list[str]) -> Column:
        keys = _keys(F.col(c))
        text = lambda n: F.to_json(F.try_variant_get(F.try_parse_json(F.col(c)), f"$['{n}']", "variant"))
        parts = [(f.name, F.array_contains(keys, f.name), F.coalesce(text(f.name), F.lit("null"))) for f in synced if f.name not in stamps]
        return F.when(F.col(c).isNotNull(), json_object([*parts, *((n, F.lit(True), F.lit(str(float(now)))) for n in stamps)]))

    out = writes.withColumns({"value": body("value", [n for n in (made, changed) if n]), "patch": body("patch", [n for n in (changed,) if n])})
    rows = out.withColumns({"table": F.lit(table.name), "server_time": F.lit(float(now)), "op_id": F.lit(None).cast("string"), "scope_key": scope_key})
    return append(log, rows.select("scope_key", "table", "id", "kind", "value", "patch", "server_time", "op_id", "seq")).drop("seq")
