"""Declared writes: how calls of a named mutation become operations.

calls(seq, op_id, user_id, local_id, args, now): one row per call, args as the JSON text of an object. A generator is a
function of a Call, whose parts are Columns, so a batch of calls is planned by one expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json import json_object, json_value
from .catalog import TableDef


@dataclass(frozen=True)
class Call:
    """What a generator may look at; it has no way to read tables."""

    table: TableDef
    args: Column
    user: Column
    now: Column
    local_id: Column

    def arg(self, name: str, dtype: T.DataType | None = None) -> Column:
        """An argument as a value: of the column of that name, of `dtype`, or as text."""
        if dtype is None and name in self.table.shape.fieldNames():
            dtype = self.table.type_of(name)
        return F.from_json(self.args, T.StructType([T.StructField(name, dtype or T.StringType())]))[name]


@dataclass(frozen=True)
class Mutation:
    """A write of one kind (insert, patch, delete). value: the columns of an inserted row; patch: the columns to set; row_id:
    which row. By default an insert has the arguments of its fields, a patch those that were given, and the row is named
    by the argument `id` (of an insert: by local_id)."""

    table: TableDef
    kind: str
    fields: tuple[str, ...] = ()
    value: Callable[[Call], dict[str, Column]] | None = None
    patch: Callable[[Call], dict[str, Column]] | None = None
    row_id: Callable[[Call], Column] | None = None

    def operations(self, calls: DataFrame, name: str) -> DataFrame:
        """seq, op_id, user_id, function_name, id, kind, value and patch of calls."""
        c = Call(self.table, F.col("args"), F.col("user_id"), F.col("now"), F.col("local_id"))
        given = F.coalesce(F.json_object_keys("args"), F.array().cast("array<string>"))
        made = (self.value if self.kind == "insert" else self.patch) if self.kind != "delete" else None
        if made:
            body = json_object([(n, F.lit(True), json_value(v)) for n, v in made(c).items()])
        else:
            body = json_object([(f, F.array_contains(given, f), json_value(c.arg(f))) for f in self.fields])
        row = self.row_id(c) if self.row_id else F.col("local_id") if self.kind == "insert" else c.arg("id", T.StringType())
        none = F.lit(None).cast("string")
        return calls.select("seq", "op_id", "user_id", F.lit(name).alias("function_name"), row.alias("id"), F.lit(self.kind).alias("kind"), (body if self.kind == "insert" else none).alias("value"), (body if self.kind == "patch" else none).alias("patch"))


@dataclass(frozen=True)
class Step:
    """One operation of a plan: under which mutation, on which row, with which columns (of an insert's row, or of a patch).
    when: whether a call has this step."""

    mutation: str
    row_id: Column
    columns: dict[str, Column] | None = None
    when: Column | None = None


@dataclass(frozen=True)
class Plan:
    """A write of several operations: steps makes them from a Call, in order. A call becomes a group, which a push accepts or
    rejects whole; its members are numbered, and named by the call's op_id and their number. Steps may be of several
    tables; mutations: the declared writes by name, which say what kind of operation a step is and what it may set."""

    mutations: dict[str, Mutation]
    steps: Callable[[Call], list[Step]]

    def operations(self, calls: DataFrame) -> DataFrame:
        """seq, op_id, user_id, function_name, table, id, kind, value, patch, group_id and group_index. seq orders calls and,
        within a call, its steps."""
        any_table = next(iter(self.mutations.values())).table
        made = self.steps(Call(any_table, F.col("args"), F.col("user_id"), F.col("now"), F.col("local_id")))
        none, parts = F.lit(None).cast("string"), []
        for step in made:
            m = self.mutations[step.mutation]
            if extra := sorted(set(step.columns or ()) - set(m.fields)):
                raise ValueError(f"{step.mutation} does not set {extra[0]!r}")
            body = json_object([(n, F.lit(True), json_value(v)) for n, v in (step.columns or {}).items()])
            part = F.struct(F.lit(step.mutation).alias("function_name"), F.lit(m.table.name).alias("table"), step.row_id.alias("id"), F.lit(m.kind).alias("kind"), (body if m.kind == "insert" else none).alias("value"), (body if m.kind == "patch" else none).alias("patch"))
            parts.append(F.when(step.when if step.when is not None else F.lit(True), part))
        each = calls.select("seq", "op_id", "user_id", F.posexplode(F.array_compact(F.array(*parts))).alias("group_index", "o"))
        return each.select(F.struct("seq", "group_index").alias("seq"), F.concat_ws(":", "op_id", "group_index").alias("op_id"), "user_id", "o.*", F.col("op_id").alias("group_id"), "group_index")


def _free(table: TableDef) -> tuple[str, ...]:
    """Columns that a client sets: not those that the server, the owner or the clock stamps."""
    owner = {table.scope.field} if table.scope and table.scope.kind == "byUser" else set()
    stamped = {*table.server_fields, *(table.timestamps or ()), *owner, table.id_field}
    return tuple(f for f in table.shape.fieldNames() if f not in stamped)


def insert_of(table: TableDef) -> Mutation:
    """An insert that takes every column a client may set."""
    return Mutation(table, "insert", _free(table))


def patch_of(table: TableDef) -> Mutation:
    """A patch of any of these but the scope."""
    held = table.scope.field if table.scope else None
    return Mutation(table, "patch", tuple(f for f in _free(table) if f != held))


def remove_of(table: TableDef) -> Mutation:
    return Mutation(table, "delete")


def functions(mutations: dict[str, Mutation]) -> dict[str, tuple[str, tuple[str, ...]]]:
    """Kind and writable fields by name, as validation wants them."""
    return {n: (m.kind, m.fields) for n, m in mutations.items()}
