"""Value semantics: equality without nulls, ordering, and text forms of numbers.

Every predicate here is TRUE or FALSE, never NULL, so NOT is safe, and stays in a form that Parquet filters understand.
Null and absent are one; 0 and -0 are equal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMBERS)


def comparable(dtype: T.DataType, value) -> bool:
    """Whether a literal is of the column's kind; values of two kinds are never equal."""
    if isinstance(value, bool):
        return isinstance(dtype, T.BooleanType)
    if isinstance(value, (int, float)):
        return is_number(dtype)
    return isinstance(value, str) and isinstance(dtype, T.StringType)


def same_value(col: Column, dtype: T.DataType, value) -> Column:
    if value is None:
        return col.isNull()
    return col.eqNullSafe(F.lit(value)) if comparable(dtype, value) else F.lit(False)


def js_string(col: Column, dtype: T.DataType) -> Column:
    """Text form of a value; whole numbers have no fraction ("1", not "1.0")."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        whole = (col == F.floor(col)) & (F.abs(col) < 1e15)
        return F.when(whole, col.cast("bigint").cast("string")).when(F.isnan(col), "NaN").otherwise(col.cast("string"))
    return col.cast("string")


def js_text(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value == int(value) and abs(value) < 1e15:
        return str(int(value))
    return str(value)


def ordered(col: Column, dtype: T.DataType, collation: str | None) -> Column:
    """The column as it is compared: strings by a collation, or by code point if there is none."""
    return F.collate(col, collation) if collation and isinstance(dtype, T.StringType) else col


def sort_key(col: Column, descending: bool) -> Column:
    """Nulls are smallest: first when ascending, last when descending."""
    return col.desc_nulls_last() if descending else col.asc_nulls_first()


def compare(col: Column, dtype: T.DataType, op: str, value, collation: str | None = None) -> Column:
    """lt, lte, gt or gte against a literal, with nulls as the smallest value. A NaN passes every comparison."""
    if value is None:
        return {"lt": F.lit(False), "lte": col.isNull(), "gt": col.isNotNull(), "gte": F.lit(True)}[op]
    if comparable(dtype, value):
        left, right = ordered(col, dtype, collation), F.lit(value)
        right = F.collate(right, collation) if collation and isinstance(value, str) else right
    else:
        left, right = js_string(col, dtype), F.lit(js_text(value))
    holds = {"lt": left < right, "lte": left <= right, "gt": left > right, "gte": left >= right}[op]
    if isinstance(dtype, (T.FloatType, T.DoubleType)) and comparable(dtype, value):
        holds = holds | F.coalesce(F.isnan(col), F.lit(False)) if op in ("lt", "lte") else holds
    return col.isNull() | holds if op in ("lt", "lte") else col.isNotNull() & holds
