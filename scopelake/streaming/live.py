"""Streaming drivers: the same folds as in batch, fed by change-log files as they arrive.

State is the canonical table itself, in a Store; a micro-batch is folded into it. Version guards make the fold idempotent
for a batch that is delivered again after a failure.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators.push import push
from ..operators.search import index, matches, search
from ..operators.view import row_deltas
from ..plans.catalog import TableDef
from ..sources.segments import add_segment, has_segments, postings
from ..sources.shared import cut
from ..sources.store import CHANGES, OPERATIONS, Store
from .views import LiveCounts, LiveQuery, sides, touched_groups  # noqa: F401


def change_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def follow(changes: DataFrame, store: Store, table: TableDef, checkpoint: str, on_deltas: Callable[[DataFrame], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Folds a stream of changes into the store's table, advances cursors, and hands out the row deltas of each batch."""

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.filter(F.col("table") == table.name).persist()
        before = store.live(table)
        store.apply_changes(table, rows)
        store.advance(rows.groupBy("scope_key").agg(F.max("change_id").alias("cursor")))
        if on_deltas:
            touched = rows.select(F.col("id").alias("_id")).distinct()
            on_deltas(row_deltas(before.join(touched, "_id", "left_semi"), store.live(table).join(touched, "_id", "left_semi")))
        rows.unpersist()

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def operation_stream(spark: SparkSession, path: str, columns: str = OPERATIONS, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(columns).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def serve(operations: DataFrame, store: Store, table: TableDef, functions: dict[str, tuple[str, tuple[str, ...]]], schema_version: int, scope_key: Column, checkpoint: str, name: str = "serve", clock: Callable[[], float] | None = None, on_write: Callable[[DataFrame], None] | None = None, roles: DataFrame | None = None, rules: dict | None = None, available_now: bool = True) -> StreamingQuery:
    """Pushes a stream of operations (with seq for their order within a batch) into a store. on_write gets what each batch
    wrote, as push.written has it.

    A batch is committed under its number: one that Spark delivers again after a failure is not pushed twice. Its writes are
    handed to on_write again from the store's feed only if the process died between the commit and the call.
    """

    def batch(rows: DataFrame, number: int) -> None:
        base, mark = store.version(), f"{name}-{number}"
        if not store.committed(mark):
            made = push(table, rows, store.canonical(table), store.known(), store.ledger(), functions, schema_version, clock() if clock else time.time() * 1000, scope_key, roles, rules)
            store.commit(table, made, base=base, batch=mark)
        if on_write and not store.committed(f"{mark}-told"):
            on_write(store.feed(table, mark))
            store.mark(f"{mark}-told")

    writer = operations.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def reindex(store: Store, table: TableDef, deltas: DataFrame) -> None:
    """Search postings after deltas(_id, kind, row): a segment of their own, and no other is written. Many are merged."""
    if has_segments(store, table):  # the first speaks of all rows there are and does not list them, so its deltas are read once
        deltas = cut(deltas.select("_id", "kind", F.struct(*(F.col("row")[f].alias(f) for f in table.search_fields)).alias("row")))
    now = deltas.filter("kind = 'upsert'").select("_id", *(F.col("row")[f].alias(f) for f in table.search_fields))
    add_segment(store, table, index(table, now), deltas.select(F.col("_id").alias("id")))


class LiveSearch:
    """A search that is kept up to date, and reports only if the result changed. It is asked again only if a row that changed
    matches it, as the row was or as it is."""

    def __init__(self, store: Store, table: TableDef, text: str, limit: int | None = None):
        self.store, self.table, self.text, self.limit, self.seen, self.asked = store, table, text, limit, None, 0

    def concerned(self, deltas: DataFrame) -> bool:
        """Whether deltas(_id, kind, row, was) can change the result."""
        return any(matches(self.table, index(self.table, side), self.text).limit(1).count() for side in sides(deltas))

    def refresh(self, on_change: Callable[[DataFrame], None], deltas: DataFrame | None = None) -> bool:
        if deltas is not None and self.seen is not None and not self.concerned(deltas):
            return False
        self.asked += 1
        found = search(self.table, self.store.live(self.table).filter("not _deleted"), postings(self.store, self.table), self.text, self.limit).persist()
        now = tuple(found.agg(F.count("*"), F.sum(F.xxhash64("id", "score", "recency").cast("decimal(38,0)"))).first())
        changed = now != self.seen
        if changed:
            self.seen = now
            on_change(found)
        found.unpersist()
        return changed


def presence(heartbeats: DataFrame, ttl_ms: int = 30_000) -> DataFrame:
    """A stream of who came and went: heartbeats(scope_key, client_id, updated_at, leaving) with updated_at in ms of the
    clock. A client is gone when it says so or stays silent for the time to live."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = state.exists
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"scope_key": [key[0]], "client_id": [key[1]], "here": [False]})
            return
        last = None
        for f in frames:
            row = f.loc[f["updated_at"].idxmax()] if len(f) else None
            last = row if row is not None and (last is None or row["updated_at"] >= last["updated_at"]) else last
        if last is None or (was and last["updated_at"] < state.get[0]):
            return
        if last["leaving"]:
            if was:
                state.remove()
                yield pd.DataFrame({"scope_key": [key[0]], "client_id": [key[1]], "here": [False]})
            return
        state.update((float(last["updated_at"]),))
        state.setTimeoutDuration(ttl_ms)
        if not was:
            yield pd.DataFrame({"scope_key": [key[0]], "client_id": [key[1]], "here": [True]})

    return heartbeats.groupBy("scope_key", "client_id").applyInPandasWithState(step, "scope_key string, client_id string, here boolean", "updated_at double", "append", "ProcessingTimeTimeout")
