"""Identifiers of logs and scopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANGE_ID_WIDTH = 12
EMPTY_CURSOR = "0" * CHANGE_ID_WIDTH


def change_id(number: Column) -> Column:
    """A zero-padded number: ids compare as strings in number order."""
    return F.lpad(number.cast("string"), CHANGE_ID_WIDTH, "0")


def change_number(cid: Column) -> Column:
    return F.coalesce(cid.cast("bigint"), F.lit(0).cast("bigint"))


def scope_key(kind: str, value: Column) -> Column:
    """Text of the form kind:value; a user scope is "u:user"."""
    return F.concat(F.lit("u:" if kind == "byUser" else f"{kind}:"), value)


def scope_kind(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def scope_value(key: Column) -> Column:
    """What follows the first colon."""
    return F.regexp_extract(key, r"^[^:]*:((?s:.*))$", 1)


def row_key(table: Column, row_id: Column) -> Column:
    return F.concat_ws(":", table, row_id)
