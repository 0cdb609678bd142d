"""Convergent field merges: set deltas, counter deltas and patches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _empty(like: Column) -> Column:
    return F.filter(like, lambda x: F.lit(False))


def _or_empty(col: Column, like: Column) -> Column:
    return F.coalesce(col, _empty(like))


def has(array: Column, value: Column) -> Column:
    """Membership with null equal to null; FALSE for a null array."""
    return F.coalesce(F.exists(array, lambda y: y.eqNullSafe(value)), F.lit(False))


def set_delta(current: Column, wanted: Column) -> tuple[Column, Column]:
    """(add, remove) between two arrays; a null current is empty. Repeated elements of the inputs stay repeated."""
    now = _or_empty(current, wanted)
    return F.filter(wanted, lambda x: ~has(now, x)), F.filter(now, lambda x: ~has(wanted, x))


def apply_set_delta(current: Column, add: Column, remove: Column) -> Column:
    """The current order without what is removed, then what is added and not removed; no element twice. Idempotent."""
    add, remove = F.coalesce(add, _empty(F.coalesce(current, remove))), F.coalesce(remove, _empty(F.coalesce(current, add)))
    now = _or_empty(current, add)
    return F.array_distinct(F.concat(F.filter(now, lambda x: ~has(remove, x)), F.filter(add, lambda x: ~has(remove, x))))


def counter_delta(current: Column, wanted: Column) -> Column:
    return wanted - F.coalesce(current, F.lit(0))


def apply_counter_delta(current: Column, delta: Column) -> Column:
    return F.coalesce(current, F.lit(0)) + F.coalesce(delta, F.lit(0))
