"""Attachments: rows that name where their blob lies. Uploads are finalized by logged writes of the server, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import json_object, json_value
from ..plans.catalog import TableDef
from .log import Known
from .push import server_write


def checked(table: TableDef, field: str, functions: dict[str, tuple[str, tuple[str, ...]]]) -> None:
    """A storage column is synced, and no function of a client may set it; anything else is an error."""
    if field not in table.synced_fields or field not in table.shape.fieldNames():
        raise ValueError(f"{table.name}.{field} does not reach clients")
    if open_ := sorted(n for n, (kind, fields) in functions.items() if kind != "delete" and field in fields):
        raise ValueError(f"{table.name}.{field} is the server's, but {open_[0]!r} may set it")


def finalize(table: TableDef, field: str, uploads: DataFrame, canonical: DataFrame, log: DataFrame | Known, now: float, scope_key: Column, roles: DataFrame | None = None, rule: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, changes) of uploads(seq, id, storage_id, user_id): the row of each upload gets its storage id.

    answers(seq, id, storage_id, ok): not ok if the row is not there, or is not the user's to write. A row that carries
    the id already is answered without a change, so a repeated call changes nothing. scope_key: a Column over the row.
    """
    mine = bool(table.scope and table.scope.kind == "byUser")
    scope = F.col(f"`{table.scope.field}`").cast("string") if table.scope else F.lit(None).cast("string")
    rows = canonical.filter(~F.coalesce("_deleted", F.lit(False))).select(F.col("_id").alias("__i"), F.col(f"`{field}`").alias("__now"), scope.alias("__holder"), scope_key.alias("scope_key"))
    joined = uploads.join(rows, F.col("id") == F.col("__i"), "left")
    fine = F.col("__i").isNotNull() & (F.coalesce(F.col("__holder") == F.col("user_id"), F.lit(False)) if mine else F.lit(True))
    if roles is not None and table.scope and not mine:
        held = roles.groupBy("user_id", F.col("scope_value").cast("string").alias("__holder")).agg(F.max("role").alias("__role"))
        joined = joined.join(held, ["user_id", "__holder"], "left")
        fine = fine & F.col("__role").isNotNull() & (F.coalesce(rule(F.col("__role")), F.lit(False)) if rule else F.lit(True))
    judged = joined.withColumn("ok", fine)
    # Of the uploads of one row each is compared with the one before it, the first with the row.
    before = F.coalesce(F.lag("storage_id").over(Window.partitionBy("id").orderBy("seq")), F.col("__now"))
    new = judged.filter("ok").withColumn("__before", before).filter(~F.col("storage_id").eqNullSafe(F.col("__before")))
    body = json_object([(field, F.lit(True), json_value(F.col("storage_id")))])
    writes = new.select("seq", "id", F.lit("patch").alias("kind"), F.lit(None).cast("string").alias("value"), body.alias("patch"), "scope_key")
    return judged.select("seq", "id", "storage_id", "ok"), server_write(table, writes, log, now, F.col("scope_key"))


def orphans(blobs: DataFrame, rows: DataFrame, field: str) -> DataFrame:
    """Blobs that are stored but that no live row names, by storage id: what a sweep may delete."""
    named = rows.filter(~F.coalesce("_deleted", F.lit(False))).select(F.col(f"`{field}`").alias("storage_id")).filter("storage_id is not null").distinct()
    return blobs.filter("storage_id is not null").join(named, "storage_id", "left_anti")
