"""The query builder: an immutable plan over one declared table that becomes a single lazy DataFrame.

scope -> filters -> order -> limit -> relations -> grouping. Tables of a workspace or project whose scope value is not
given yield nothing, never the whole table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import js_string, ordered, same_value, sort_key
from ..operators import relations
from .catalog import Manifest, Relation, TableDef
from .filters import compile_filter

#: Columns that carry the sort keys of a plan through its joins begin with this.
_ORDER = "__order"


@dataclass(frozen=True)
class Query:
    """A plan over `table`; each method returns a new one."""

    table: TableDef
    scopes: dict | None = None
    filters: tuple[dict, ...] = ()
    predicates: tuple = ()
    ordering: tuple[str, bool] | None = None
    rows: int | None = None
    group_field: str | None = None
    related_by: tuple[tuple[str, Relation], ...] = ()
    collation: str | None = None

    def scope(self, **values) -> Query:
        """Equality on every given column; replaces an earlier scope."""
        for c in values:
            self.table.type_of(c)
        return replace(self, scopes=values)

    def filter(self, spec: dict) -> Query:
        compile_filter(spec, self.table)  # unknown columns show here
        return replace(self, filters=(*self.filters, spec))

    def where(self, condition, *value) -> Query:
        """A Column, a function from a row dictionary to bool (slow), or a column name and a value."""
        if value:
            condition = same_value(F.col(f"`{condition}`"), self.table.type_of(condition), value[0])
        return replace(self, predicates=(*self.predicates, condition))

    def order(self, column: str, direction: str = "asc") -> Query:
        if direction not in ("asc", "desc"):
            raise ValueError("direction is asc or desc")
        self.table.type_of(column)
        return replace(self, ordering=(column, direction == "desc"))

    order_by = order

    def limit(self, n: int) -> Query:
        return replace(self, rows=max(0, int(n)))

    def group_by(self, column: str) -> Query:
        self.table.type_of(column)
        return replace(self, group_field=column)

    def related(self, name: str, relation: Relation) -> Query:
        return replace(self, related_by=(*(r for r in self.related_by if r[0] != name), (name, relation)))

    def with_relations(self, several: dict[str, Relation]) -> Query:
        out = self
        for name, relation in several.items():
            out = out.related(name, relation)
        return out

    def with_(self, *names: str) -> Query:
        """Declared relations by name."""
        if unknown := [n for n in names if n not in self.table.relations]:
            raise KeyError(f"{self.table.name} has no relation {unknown[0]!r}")
        return self.with_relations({n: self.table.relations[n] for n in names})

    def collate(self, collation: str | None) -> Query:
        """How strings compare in order and ranges: None by code point (pushed to the files), "UNICODE" as people sort."""
        return replace(self, collation=collation)

    @property
    def reads(self) -> list[str]:
        """All tables that the plan reads."""
        return list(dict.fromkeys([self.table.name, *(t for _, r in self.related_by for t in (r.table, r.through) if t)]))

    @property
    def fingerprint(self) -> str:
        """Equal for equal plans; opaque predicates count by their text."""
        parts = [sorted(self.reads), self.scopes, self.filters, self.ordering, self.rows, [str(p) if isinstance(p, Column) else repr(p) for p in self.predicates], self.group_field, [str(r) for r in self.related_by], self.collation]
        return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()

    def missing_scope(self) -> bool:
        own = self.table.scope
        return bool(own and own.kind != "byUser" and (self.scopes or {}).get(own.field) is None)

    def condition(self, user: str | None = None) -> Column:
        """Scope and filters as one Column (functions of rows are not part of it)."""
        out = F.lit(not self.missing_scope())
        own = self.table.scope
        if own and own.kind == "byUser" and user is not None:
            out = out & F.col(f"`{own.field}`").eqNullSafe(F.lit(user))
        for c, v in (self.scopes or {}).items():
            out = out & same_value(F.col(f"`{c}`"), self.table.type_of(c), v)
        for spec in self.filters:
            out = out & compile_filter(spec, self.table, self.collation)
        for p in self.predicates:
            out = out & F.coalesce(p, F.lit(False)) if isinstance(p, Column) else out
        return out

    def sort_columns(self, df: DataFrame) -> list[Column]:
        keys = []
        if self.ordering:
            c, down = self.ordering
            keys.append(sort_key(ordered(F.col(f"`{c}`"), self.table.type_of(c), self.collation), down))
        return [*keys, F.col(relations.tie(df)).asc(), *([F.col("_id").asc()] if "_seq" in df.columns else [])]

    def matching(self, rows: DataFrame, user: str | None = None) -> DataFrame:
        """Live rows in scope that pass all predicates."""
        if "_deleted" in rows.columns:
            rows = rows.filter(~F.coalesce(F.col("_deleted"), F.lit(False)))
        out = rows.filter(self.condition(user))
        for p in self.predicates:
            if not isinstance(p, Column):
                out = out.filter(_row_predicate(p, out))
        return out

    def to_df(self, frames: dict[str, DataFrame], user: str | None = None, target_scope: bool = True) -> DataFrame:
        """The rows in plan order, with relations nested. target_scope: related rows must lie in the same scope where
        they have its column (the base is always held to its scope)."""
        out = self._unordered(frames, user, target_scope)
        keys = [c for c in out.columns if c.startswith(_ORDER)]
        return out.orderBy(*(sort_key(F.col(c), c.endswith("desc")) for c in keys)).drop(*keys) if keys else out

    def _unordered(self, frames: dict[str, DataFrame], user: str | None, target_scope: bool = True) -> DataFrame:
        """The rows that order and limit choose, with relations, and columns _ORDER... to sort them by: joins keep no order."""
        out = self.matching(frames[self.table.name], user)
        if self.ordering or self.rows is not None:
            tie = relations.tie(out)
            keys = [(ordered(F.col(f"`{self.ordering[0]}`"), self.table.type_of(self.ordering[0]), self.collation), self.ordering[1])] if self.ordering else []
            keys += [(F.col(c), False) for c in dict.fromkeys([tie, "_id"])]
            if self.rows is not None:
                out = out.orderBy(*(sort_key(k, down) for k, down in keys)).limit(self.rows)
            out = out.withColumns({f"{_ORDER}{i}{'desc' if down else 'asc'}": k for i, (k, down) in enumerate(keys)})
        for name, relation in self.related_by:
            target = frames[relation.table]
            if target_scope and self.table.scope and self.scopes and (c := self.table.scope.field) in target.columns and c in self.scopes:
                target = target.filter(F.col(c).eqNullSafe(F.lit(self.scopes[c])))
            if "_deleted" in target.columns:
                target = target.filter(~F.coalesce(F.col("_deleted"), F.lit(False)))
            out = relations.attach(out, name, relation, target, frames.get(relation.through) if relation.through else None)
        return out

    def key_column(self, column: str | None = None) -> Column:
        c = column or self.group_field
        return js_string(F.col(f"`{c}`"), self.table.type_of(c))

    def groups(self, frames: dict[str, DataFrame], user: str | None = None) -> DataFrame:
        """key, first and rows: the rows of each group in plan order (the limit comes before the grouping); `first` sorts
        groups by first appearance. A group becomes one value: for groups of any size use group_positions."""
        df = self._unordered(frames, user)
        df = df.drop(*(c for c in df.columns if c.startswith(_ORDER)))
        row, down = F.struct(*(F.col(f"`{c}`") for c in df.columns)), bool(self.ordering and self.ordering[1])
        o = F.col(f"`{self.ordering[0]}`") if self.ordering else F.lit(0)
        entry = F.struct(o.isNotNull().alias("has"), ordered(o, self.table.type_of(self.ordering[0]), self.collation).alias("o") if self.ordering else o.alias("o"), F.col(relations.tie(df)).alias("t"), row.alias("r"))

        def before(a, b):
            up = F.when(a["has"] != b["has"], F.when(a["has"], 1).otherwise(-1)).when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
            turned = -up if down else up
            return F.when(turned != 0, turned).when(a["t"] < b["t"], -1).when(a["t"] > b["t"], 1).otherwise(0)

        grouped = df.groupBy(self.key_column().alias("key")).agg(F.array_sort(F.collect_list(entry), before).alias("s"))
        return grouped.select("key", F.get("s", F.lit(0)).alias("first"), F.transform("s", lambda x: x["r"]).alias("rows"))

    def group_positions(self, frames: dict[str, DataFrame], user: str | None = None) -> DataFrame:
        """All rows with key, sorted by it and then in plan order: a range-partitioned sort, whatever the group sizes."""
        df = self._unordered(frames, user)
        df = df.drop(*(c for c in df.columns if c.startswith(_ORDER))).withColumn("key", self.key_column())
        return df.orderBy(F.col("key").asc_nulls_first(), *self.sort_columns(df))

    def counts(self, frames: dict[str, DataFrame], user: str | None = None, null_key: str | None = None) -> DataFrame:
        """key and n of each group, or n alone; order and limit do not count. null_key: what the null group is called."""
        df = self.matching(frames[self.table.name], user)
        if not self.group_field:
            return df.agg(F.count("*").alias("n"))
        key = self.key_column() if null_key is None else F.coalesce(self.key_column(), F.lit(null_key))
        return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"))

    def describe(self) -> dict:
        """What the plan asks for: scope, filters, order, limit, grouping, relations and the number of opaque predicates."""
        opaque = sum(not isinstance(p, Column) for p in self.predicates)
        return {"table": self.table.name, "scope": self.scopes, "filters": list(self.filters), "order": self.ordering, "limit": self.rows, "group_by": self.group_field, "relations": [n for n, _ in self.related_by], "predicates": len(self.predicates), "opaque": opaque}

    def explain(self, frames: dict[str, DataFrame], user: str | None = None) -> dict:
        """describe() with what Spark makes of it: the filters that reach the files, the columns read, and the operators."""
        df = self.to_df(frames, user)
        conf, name = df.sparkSession.conf, "spark.sql.maxMetadataStringLength"
        before = conf.get(name)
        conf.set(name, 100_000)  # else long lists of filters are cut
        try:
            text = df._jdf.queryExecution().executedPlan().toString()
        finally:
            conf.set(name, before)
        return self.describe() | {
            "scope_satisfied": not self.missing_scope(),
            "pushed": re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", text),
            "read": re.findall(r"ReadSchema: struct<(.*?)>(?:\s|$)", text),
            "sorts": len(re.findall(r"\bSort\b|TakeOrderedAndProject", text)),
            "exchanges": len(re.findall(r"Exchange (?:hash|range|Single)", text)),
        }


def _row_predicate(fn: Callable, df: DataFrame) -> Column:
    """A Python function of a row as a vectorised predicate; Spark cannot push it down."""
    @F.pandas_udf("boolean")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([bool(fn(r)) for r in rows.to_dict("records")], dtype=bool)

    return run(F.struct(*(F.col(f"`{c}`") for c in df.columns)))


def indexed(table: TableDef, rows: DataFrame, index: str, key: list, descending: bool = False, user: str | None = None) -> DataFrame:
    """Rows whose leading index columns equal the key, sorted by the remaining ones; surplus key parts are ignored."""
    columns = table.indexes[index]
    out = rows
    for c, v in zip(columns, key):
        if user is None and table.scope and table.scope.kind == "byUser" and c == table.scope.field:
            continue  # nobody is signed in: the owner column does not restrict
        out = out.filter(same_value(F.col(f"`{c}`"), table.type_of(c), v))
    return out.orderBy(*(sort_key(F.col(f"`{c}`"), descending) for c in columns[len(key) :]), F.col(relations.tie(rows)))


def server_indexed(table: TableDef, rows: DataFrame, index: str, key: list, user: str, descending: bool = False) -> DataFrame:
    """indexed() as a server may run it: only a user's own rows, by an index that leads with the owner."""
    columns = table.indexes[index]
    if not (table.scope and table.scope.kind == "byUser" and columns[0] == table.scope.field and key and key[0] == user and len(key) <= len(columns)):
        raise PermissionError(f"{table.name}.{index} does not begin with the signed-in owner")
    return indexed(table, rows, index, key, descending, user)


@dataclass
class Database:
    """Plans by table name over frames, for one user."""

    manifest: Manifest
    frames: dict[str, DataFrame] = field(default_factory=dict)
    user: str | None = None

    def __getattr__(self, name: str) -> Query:
        tables = self.__dict__.get("manifest").tables if "manifest" in self.__dict__ else {}
        if name not in tables:
            raise AttributeError(name)
        return Query(tables[name])

    def run(self, query: Query) -> DataFrame:
        return query.groups(self.frames, self.user) if query.group_field else query.to_df(self.frames, self.user)

    def get(self, table: str, row_id: str) -> DataFrame:
        rows = self.frames[table].filter(F.col("_id") == row_id)
        return rows.filter(~F.coalesce(F.col("_deleted"), F.lit(False))) if "_deleted" in rows.columns else rows

    def call(self, name: str, **args) -> DataFrame:
        """A registered query; whatever it does, it only sees rows of the user's scope. One by an index makes its key itself:
        without a user there is no key of theirs, and no rows."""
        if name in self.manifest.keyed:
            table, index, key = self.manifest.keyed[name]
            t, rows, made = self.manifest.tables[table], self.frames[table], key(self.user, args)
            if t.scope and t.scope.kind == "byUser":
                return server_indexed(t, rows, index, made, self.user) if self.user is not None else rows.limit(0)
            return indexed(t, rows, index, made, user=self.user)
        held = {n: Query(t).scope(**{t.scope.field: args[t.scope.field]}).matching(self.frames[n], self.user) if t.scope and t.scope.field in args else Query(t).matching(self.frames[n], self.user) for n, t in self.manifest.tables.items() if n in self.frames}
        return self.manifest.queries[name](held, **args)


#: Type names that schema() knows; needs no session, so tables can be declared at import.
TYPES = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType(), "binary": T.BinaryType()}


def _type(name: str) -> T.DataType:
    return T.ArrayType(_type(name[6:-1])) if name.startswith("array<") else TYPES[name]


def schema(**columns: str) -> T.StructType:
    """A shape from column names and type names."""
    return T.StructType([T.StructField(c, _type(t)) for c, t in columns.items()])
