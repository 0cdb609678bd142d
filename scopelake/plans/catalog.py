"""Declared tables, scopes and relations, and the manifest that holds them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SYSTEM = ("_id", "_table", "_version", "_deleted", "_pending", "_conflict", "_seq")


@dataclass(frozen=True)
class Scope:
    """How rows belong to someone: by a user column, or by a workspace or project column."""

    kind: str
    field: str
    membership: str | None = None


def by_user(field: str) -> Scope:
    return Scope("byUser", field)


def by_workspace(field: str, membership: str | None = None) -> Scope:
    return Scope("byWorkspace", field, membership)


def by_project(field: str, membership: str | None = None) -> Scope:
    return Scope("byProject", field, membership)


@dataclass(frozen=True)
class Relation:
    """one: fk here names a row there. many: rows there name this one by fk. many_to_many: through a link table.
    via_ids: an array of ids here, whose order and repeats are kept."""

    kind: str
    table: str
    fk: str | None = None
    through: str | None = None
    local_key: str | None = None
    target_key: str | None = None


def one(table: str, fk: str) -> Relation:
    return Relation("one", table, fk)


def many(table: str, fk: str) -> Relation:
    return Relation("many", table, fk)


backref = many


def many_to_many(table: str, through: str, local_key: str, target_key: str) -> Relation:
    return Relation("many_to_many", table, through=through, local_key=local_key, target_key=target_key)


def via_ids(table: str, ids: str) -> Relation:
    return Relation("via_ids", table, ids)


@dataclass(frozen=True)
class TableDef:
    """A table: its columns, whose rows they are, and how they are related, merged, indexed and searched."""

    name: str
    shape: T.StructType
    scope: Scope | None = None
    id_field: str = "_id"
    relations: dict[str, Relation] = field(default_factory=dict)
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    set_fields: tuple[str, ...] = ()
    counter_fields: tuple[str, ...] = ()
    search_fields: tuple[str, ...] = ()
    server_fields: tuple[str, ...] = ()
    timestamps: tuple[str, str] | None = None

    def __post_init__(self):
        names = set(self.shape.fieldNames())
        need = [*self.set_fields, *self.counter_fields, *self.search_fields, *(c for cols in self.indexes.values() for c in cols), *([self.scope.field] if self.scope else [])]
        if unknown := sorted({c for c in need if c not in names and c not in (self.timestamps or ())}):
            raise ValueError(f"{self.name}: no such columns: {unknown}")

    @property
    def synced_fields(self) -> list[str]:
        """What leaves the server: shape, timestamps and id, without server columns."""
        return list(dict.fromkeys([c for c in self.shape.fieldNames() if c not in self.server_fields] + list(self.timestamps or ()) + [self.id_field]))

    def type_of(self, column: str) -> T.DataType:
        if column in self.shape.fieldNames():
            return self.shape[column].dataType
        if self.timestamps and column in self.timestamps:
            return T.DoubleType()
        if column in ("_id", "_table", self.id_field):
            return T.StringType()
        if column in ("_version", "_seq"):
            return T.LongType()
        if column in ("_deleted", "_pending"):
            return T.BooleanType()
        raise KeyError(f"{self.name} has no column {column!r}")


class Manifest:
    """Registered tables, named queries and mutations, under one schema version."""

    def __init__(self, schema_version: int, tables: list[TableDef] = ()):
        self.schema_version, self.tables, self.queries, self.mutations, self.keyed = schema_version, {}, {}, {}, {}
        for t in tables:
            self.add(t)

    def add(self, table: TableDef) -> None:
        if self.tables.get(table.name, table) != table:
            raise ValueError(f"table {table.name!r} is declared twice, differently")
        self.tables[table.name] = table

    def query(self, name: str, run: Callable[..., DataFrame]) -> None:
        self.queries[name] = run

    def indexed_query(self, name: str, table: str, index: str, key: Callable[[str | None, dict], list]) -> None:
        """A query by an index whose key is made from the signed-in user and the arguments; key sees nothing else."""
        if index not in self.tables[table].indexes:
            raise KeyError(f"{table} has no index {index!r}")
        self.keyed[name] = (table, index, key)

    def mutation(self, name: str, table: str, kind: str, fields: tuple[str, ...] = ()) -> None:
        """A write that may set the given columns."""
        self.mutations[name] = (table, kind, tuple(fields))

    def merge(self, other: Manifest) -> Manifest:
        if other.schema_version != self.schema_version:
            raise ValueError("modules of different schema versions")
        out = Manifest(self.schema_version, [*self.tables.values(), *other.tables.values()])
        out.queries, out.mutations, out.keyed = self.queries | other.queries, self.mutations | other.mutations, self.keyed | other.keyed
        if not out.tables:
            raise ValueError("no tables found")
        return out
