"""Operations of a push, decided one after the other where they depend on each other.

A unit is a single operation or a group; units come in the order of their first operation, the operations of a group in
their own order. A group is staged: its members see each other's effects, and if one is rejected none of them happens.

Operations of different rows never meet unless a group holds both, and units of different rows or of a row that no
operation can change do not either. So rows that can change and groups form a graph whose components are
decided apart from each other: Spark brings each component together, sorted, and a state machine runs down the sorted
rows of a partition. It holds the rows of one component (whether known, live and whose) and the group at hand, no history.
The operations of one component, or of one row, are a sequence by nature and are read by one task.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .components import components

#: What decide() wants to know of each operation.
FACTS = "__row string, __label string, __kind string, __fixed string, __known boolean, __live boolean, __holder string, __mine boolean, __asked string, __moved string, __may map<string,int>"


def group_key() -> Column:
    """Groups of different users are different, whatever their ids."""
    return F.when(F.col("group_id").isNotNull(), F.concat_ws("\u0001", F.lit("g"), "user_id", "group_id"))


def _changes_row() -> Column:
    """Whether an operation could change its row as it is stored: a row with no such operation stays as it is."""
    return F.coalesce(((F.col("__kind") == "insert") & ~F.col("__live")) | ((F.col("__kind") == "delete") & F.col("__live")), F.lit(False))


def in_units(ops: DataFrame) -> DataFrame:
    """ops(seq, user_id, group_id) with __unit, the group if there is one, and __node, a number for it or else for the row.
    Two of one number are only decided by one task."""
    return ops.withColumn("__unit", group_key()).withColumn("__node", F.xxhash64(F.coalesce("__unit", F.concat(F.lit("r\u0001"), "__row"))))


def with_component(ops: DataFrame) -> DataFrame:
    """in_units(ops) with __lead, the place of a unit's first operation, and __component, a number for the rows and groups
    that hang together; sorted by component, units in their order.

    A row ties the units that touch it only if it can change. Few rows are touched by several units as a rule: these are
    found by an aggregation of numbers, and only they make edges, from each group to the smallest of the row.
    """
    units = ops.withColumn("__key", F.xxhash64("__row"))
    group = F.when(F.col("__unit").isNotNull(), F.col("__node"))
    rows = units.groupBy("__key").agg(F.min(group).alias("__first"), F.max(group).alias("__last"), F.max(F.col("__unit").isNull()).alias("__single"), F.max(_changes_row()).alias("__changes"))
    ties = cut(rows.filter("__changes and __first is not null and (__first <> __last or __single)").select("__key", "__first", "__single"))
    tied, single = ties.agg(F.count("*"), F.count_if("__single")).first()
    if single:  # single operations go where the groups of their row go
        units = units.join(ties.filter("__single").select("__key", F.col("__first").alias("__at")), "__key", "left").withColumn("__node", F.when(F.col("__unit").isNull(), F.coalesce("__at", "__node")).otherwise(F.col("__node"))).drop("__at")
    unit = Window.partitionBy("__node", "__unit").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lead = F.when(F.col("__unit").isNull(), F.col("seq")).otherwise(F.first("seq").over(unit))
    placed = units.repartition("__node").withColumn("__lead", lead).drop("__key")
    if not tied:
        return placed.withColumn("__component", F.col("__node")).sortWithinPartitions("__node", "__unit", "seq")
    edges = units.filter("__unit is not null").select("__key", "__node").join(ties.select("__key", "__first"), "__key").filter("__node <> __first")
    linked = components(edges.select(F.col("__node").alias("a"), F.col("__first").alias("b"))).select(F.col("node").alias("__node"), F.col("component").alias("__c"))
    placed = placed.join(linked, "__node", "left").withColumn("__component", F.coalesce("__c", "__node")).drop("__c")
    return placed.repartition("__component").sortWithinPartitions("__component", "__lead", "seq")


class Machine:
    """Rows of one component as the operations so far leave them: row -> (known, live, whose)."""

    def __init__(self):
        self.rows: dict[str, tuple] = {}
        self.staged: dict[str, tuple] = {}

    def take(self, row, label, kind, known, live, holder, user, mine, asked, moved, may) -> tuple[str | None, bool]:
        """(why not, whether it changes nothing) of one operation, staged if it is fine."""
        known, live, holder = self.staged.get(row) or self.rows.setdefault(row, (known, live, holder))
        where = asked if kind == "insert" else holder
        level = 1 if may is None else may.get(where, 0) if where is not None else 0
        foreign = (mine and holder != user) or level < 1 or (moved is not None and moved != holder)
        if kind == "insert":
            if live:
                return f"Duplicate localId {label}", False
            if level < 1:
                return f"Not a member of {where}" if level == 0 else f"Cannot insert {label}", False
            self.staged[row] = (True, True, user if mine else asked)
            return None, False
        if foreign or not (live if kind == "patch" else known):
            return f"Cannot {kind} {label}", False
        if kind == "delete":
            self.staged[row] = (True, False, holder)
        return None, kind == "delete" and not live

    def commit(self) -> None:
        self.rows.update(self.staged)
        self.staged = {}


_ASKED = ("__row", "__label", "__kind", "__known", "__live", "__holder", "user_id", "__mine", "__asked", "__moved", "__may", "__fixed", "__unit", "__component")


def _plain(column: pa.Array) -> list:
    """The texts, truth values or whole numbers of a column as to_pylist() gives them, without an object for each between."""
    return [None] * len(column) if column.null_count == len(column) else column.to_numpy(zero_copy_only=False).tolist()


def _decisions(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """The reason and whether nothing changes, for batches of _ASKED sorted by component and unit; held while a group is open."""
    held: deque = deque()  # reasons, no-ops
    machine, component, unit = Machine(), None, None
    members: list[tuple[list, list, int]] = []
    failed: str | None = None

    def close() -> None:
        nonlocal failed, members, unit
        if failed is None:
            machine.commit()
        else:
            machine.staged = {}
            for reasons, nothing, i in members:
                reasons[i], nothing[i] = f"groupRejected: {failed}", False
        failed, members, unit = None, [], None

    for batch in batches:
        *columns, may, fixed, units, parts = map(_plain, batch)
        n = len(units)
        may = [None if m is None else json.loads(m) for m in may]
        reasons, nothing = [None] * n, [False] * n
        for i in range(n):
            if unit is not None and units[i] != unit:
                close()
            if parts[i] != component:
                machine, component = Machine(), parts[i]
            unit = units[i]
            why, no_op = (fixed[i], False) if fixed[i] is not None else machine.take(*(c[i] for c in columns), may[i])
            reasons[i], nothing[i] = why, no_op
            if unit is None:
                machine.commit()
            else:
                members.append((reasons, nothing, i))
                failed = why if failed is None else failed
        held.append((reasons, nothing))
        while held and not (unit is not None and members[0][0] is held[0][0]):
            yield _out(*held.popleft())
    close()
    while held:
        yield _out(*held.popleft())


def _out(reasons: list, nothing: list) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(reasons, pa.string()), pa.array(nothing, pa.bool_())], names=["reject_reason", "no_op"])


def decide(ops: DataFrame) -> DataFrame:
    """ops(seq, user_id, group_id, ... and FACTS) with reject_reason, no_op and __lead, without the facts. seq has no ties.

    __row names the row, __label is how messages name it; __fixed is a reason that needs no order; __known, __live and
    __holder (its user or scope) are of the row as stored; __mine: only its user may change it; __asked: the scope an
    insert asks for; __moved: the scope that a patch sets; __may: by scope, 1 if the user may write, 0 without a role, -1
    if the rule says no (null: no rules).
    """
    # Roles go as text: Arrow writers measure a batch after each row, which for a column of null maps takes a pass over its rows.
    units = in_units(ops.withColumn("__may", F.to_json("__may")))
    # Without groups a row is a component, and the graph is not asked.
    if units.filter("__unit is not null").limit(1).count():
        placed = with_component(units)
    else:
        placed = units.withColumns({"__component": F.col("__row"), "__lead": F.col("seq")}).repartition("__component").sortWithinPartitions("__component", "seq")
    # Only what is asked goes through Python, the rest of a row waits for its answer. The answers depend on the order of the
    # rows, so Spark must not take the function for one that it may move or repeat.
    answer = F.arrow_udf(_decisions, "struct<reject_reason:string,no_op:boolean>").asNondeterministic()
    kept = [c for c in placed.columns if not c.startswith("__") or c == "__lead"]
    return placed.withColumn("__answer", answer(*_ASKED)).select(*(F.col(f"`{c}`") for c in kept), "__answer.reject_reason", "__answer.no_op")


def permissions(ops: DataFrame, roles: DataFrame, rule) -> DataFrame:
    """ops(seq, user_id, __row, __holder, __asked) with __may, for every scope that the row may be in: as it is stored, or
    as an insert of this push asks. roles(user_id, scope_value, role); rule: a function of the role as a Column, or None."""
    may = F.when(F.col("role").isNull(), 0).when(F.coalesce(rule(F.col("role")), F.lit(False)) if rule else F.lit(True), 1).otherwise(-1)
    scopes = F.array_distinct(F.array_compact(F.array_append(F.collect_set("__asked").over(Window.partitionBy("__row")), F.col("__holder"))))
    asked = ops.withColumn("__scopes", scopes).select("seq", "user_id", F.explode("__scopes").alias("scope_value"))
    level = asked.join(roles.select("user_id", F.col("scope_value").cast("string").alias("scope_value"), "role"), ["user_id", "scope_value"], "left").groupBy("seq", "scope_value").agg(F.max(may).alias("level"))
    whole = level.groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("scope_value", "level"))).alias("__may"))
    return ops.join(whole, "seq", "left").withColumn("__may", F.coalesce("__may", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))))
