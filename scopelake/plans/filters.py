"""Serializable filters: a tree of conditions that compiles to one Column, TRUE or FALSE for every row.

{"status": "open", "rank": {"gt": 3, "lte": 9}, "OR": [{...}, {...}], "NOT": {...}}: all parts must hold.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sets import has
from ..functions.values import comparable, compare, same_value
from .catalog import TableDef

LISTS, RANGES = ("in", "nin", "overlaps"), ("lt", "lte", "gt", "gte")
OPERATORS = ("eq", "ne", "contains", *LISTS, *RANGES)


@dataclass(frozen=True)
class FilterError(Exception):
    code: str
    path: str
    message: str


def _scalar(v) -> bool:
    return v is None or isinstance(v, (str, bool, int)) or isinstance(v, float) and math.isfinite(v)


def validate(spec, path: str = "$", above: tuple = ()) -> None:
    """Raises FilterError with the code and place of the first fault."""
    if not isinstance(spec, dict):
        raise FilterError("invalid_filter", path, "a filter is an object")
    if any(spec is s for s in above):
        raise FilterError("invalid_filter", path, "a filter cannot hold itself")
    above = (*above, spec)
    for name, value in spec.items():
        at = f"{path}.{name}"
        if name in ("AND", "OR"):
            if not isinstance(value, list):
                raise FilterError("invalid_operand", at, f"{name} takes a list of filters")
            for i, x in enumerate(value):
                validate(x, f"{at}[{i}]", above)
        elif name == "NOT":
            validate(value, at, above)
        elif isinstance(value, dict):
            if not value:
                raise FilterError("invalid_operator", at, "a condition needs an operator")
            for op, v in value.items():
                if op not in OPERATORS:
                    raise FilterError("invalid_operator", f"{at}.{op}", f"unknown operator {op!r}")
                if op in LISTS:
                    if not isinstance(v, list):
                        raise FilterError("invalid_operand", f"{at}.{op}", f"{op} takes a list")
                    bad = next((i for i, x in enumerate(v) if not _scalar(x)), None)
                    if bad is not None:
                        raise FilterError("invalid_operand", f"{at}.{op}[{bad}]", "not a plain value")
                elif not _scalar(v):
                    raise FilterError("invalid_operand", f"{at}.{op}", "not a plain value")
        elif not _scalar(value):
            raise FilterError("invalid_operand", at, "not a plain value")


def parse_filter(text: str) -> tuple[dict | None, FilterError | None]:
    """(filter, None) or (None, error); never raises."""
    try:
        spec = json.loads(text)
    except (ValueError, TypeError) as e:
        return None, FilterError("invalid_json", "$", str(e))
    try:
        validate(spec)
    except FilterError as e:
        return None, e
    return spec, None


def serialize_filter(spec: dict) -> str:
    try:
        validate(spec)
    except FilterError as e:
        raise TypeError(f"{e.code} at {e.path}: {e.message}") from None
    return json.dumps(spec)


def _condition(col: Column, dtype: T.DataType, op: str, v, collation: str | None) -> Column:
    if op == "eq":
        return same_value(col, dtype, v)
    if op == "ne":
        return ~same_value(col, dtype, v)
    if op in ("in", "nin"):
        if not isinstance(v, (list, tuple)):
            return F.lit(False)
        plain = [x for x in v if comparable(dtype, x)]
        found = col.isNotNull() & col.isin(plain) if plain else F.lit(False)
        found = found | col.isNull() if None in v else found
        return found if op == "in" else ~found
    if op in RANGES:
        return compare(col, dtype, op, v, collation)
    values = list(v) if op == "overlaps" and isinstance(v, (list, tuple)) else [v] if op == "contains" else []
    out = F.lit(False)
    if isinstance(dtype, T.ArrayType):
        for x in values:
            if x is None or comparable(dtype.elementType, x):
                out = out | has(col, F.lit(x).cast(dtype.elementType))
    return out


def compile_filter(spec, table: TableDef, collation: str | None = None) -> Column:
    """The Column of a filter. Malformed parts are FALSE, as they match nothing; unknown columns raise."""
    if not isinstance(spec, dict):
        return F.lit(False)
    out = F.lit(True)
    for name, value in spec.items():
        if name in ("AND", "OR"):
            part = F.lit(name == "AND")
            if not isinstance(value, list):
                part = F.lit(False)
            else:
                for x in value:
                    one = compile_filter(x, table, collation)
                    part = part & one if name == "AND" else part | one
        elif name == "NOT":
            part = ~compile_filter(value, table, collation) if isinstance(value, dict) else F.lit(False)
        else:
            dtype, col = table.type_of(name), F.col(f"`{name}`")
            if isinstance(value, dict):
                part = F.lit(bool(value) and all(op in OPERATORS for op in value))
                if value and all(op in OPERATORS for op in value):
                    for op, v in value.items():
                        part = part & _condition(col, dtype, op, v, collation)
            else:
                part = same_value(col, dtype, value) if _scalar(value) else F.lit(False)
        out = out & part
    return out
