"""Update logs of shared documents: ordered reads, and snapshots in place of the updates that they hold.

updates(doc, id, update, confirmed): each row is an opaque binary update. A snapshot is a row too: its update holds others,
one after the other, each behind its length in four bytes, and `covers` names them (null for a plain update). What updates
mean is for the reader to say, so nothing is merged; a snapshot gives back every update that it took in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .log import needs_compaction


def _framed(update: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(F.length(update)), 8, "0")), update)


def _covers(updates: DataFrame) -> DataFrame:
    return updates if "covers" in updates.columns else updates.withColumn("covers", F.lit(None).cast("array<string>"))


def ordered(updates: DataFrame) -> DataFrame:
    """Each update of a document once, by id, without those that a snapshot beside them holds."""
    rows = _covers(updates)
    once = rows.groupBy("doc", "id").agg(F.min_by(F.struct("update", "covers", "confirmed"), F.when(F.col("confirmed"), 0).otherwise(1)).alias("r")).select("doc", "id", "r.*")
    held = once.filter("covers is not null").select("doc", F.explode("covers").alias("id")).distinct()
    return once.join(held, ["doc", "id"], "left_anti").orderBy("doc", "id")


def due(updates: DataFrame, rows: int = 100, size: int = 1 << 20) -> DataFrame:
    """doc of those that have grown to `rows` updates or `size` bytes and are quiet: all that they hold is confirmed."""
    now = ordered(updates)
    loud = now.filter(~F.coalesce("confirmed", F.lit(False))).select("doc").distinct()
    return needs_compaction(now, rows, size).select("doc").join(loud, "doc", "left_anti")


def snapshots(updates: DataFrame, docs: DataFrame, snapshot_id: Column) -> DataFrame:
    """A snapshot row of each of docs(doc), from its confirmed updates in order; snapshot_id: a new id, from doc and covers.

    A document is one value by nature; its updates meet in one row. Not confirmed yet: prune() waits until it is.
    """
    own = ordered(updates).filter("confirmed").join(docs.select("doc"), "doc", "left_semi")
    entry = F.struct("id", F.when(F.col("covers").isNull(), _framed(F.col("update"))).otherwise(F.col("update")).alias("update"), F.coalesce("covers", F.array()).alias("covers"))
    whole = own.groupBy("doc").agg(F.array_sort(F.collect_list(entry)).alias("u"))
    text = F.unhex(F.array_join(F.transform("u", lambda x: F.hex(x["update"])), ""))
    covers = F.flatten(F.transform("u", lambda x: F.concat(F.array(x["id"]), x["covers"])))
    made = whole.select("doc", text.alias("update"), covers.alias("covers"))
    return made.select("doc", snapshot_id.alias("id"), "update", F.lit(False).alias("confirmed"), "covers")


def prune(updates: DataFrame) -> DataFrame:
    """Updates without those that a confirmed snapshot holds. What came later, or is held by a snapshot that is not confirmed,
    stays; so a crash between the two steps leaves more rows, never fewer."""
    rows = _covers(updates)
    held = rows.filter("confirmed and covers is not null").select("doc", F.explode("covers").alias("id")).distinct()
    return rows.join(held, ["doc", "id"], "left_anti")


def unfolded(updates: DataFrame) -> DataFrame:
    """doc, position and update: all updates of each document in the order of its log, those in snapshots in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ids, places, parts = [], [], [], []
            for doc, row_id, update, covers in zip(*(batch.column(c).to_pylist() for c in ("doc", "id", "update", "covers"))):
                at = k = 0
                while covers is not None and at < len(update):
                    size = int.from_bytes(update[at : at + 4], "big")
                    docs.append(doc), ids.append(row_id), places.append(k), parts.append(update[at + 4 : at + 4 + size])
                    at, k = at + 4 + size, k + 1
                if covers is None:
                    docs.append(doc), ids.append(row_id), places.append(0), parts.append(update)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(ids, pa.string()), pa.array(places, pa.int32()), pa.array(parts, pa.binary())], names=["doc", "id", "place", "update"])

    return ordered(updates).select("doc", "id", "update", "covers").mapInArrow(run, "doc string, id string, place int, update binary")
