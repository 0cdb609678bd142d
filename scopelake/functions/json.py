"""Pieces of JSON text. A field that is null is not a field that is absent, which to_json() alone does not keep apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_value(col: Column) -> Column:
    """The JSON text of a value of any type; null for null."""
    whole = F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)  # what stands between {"v": and }


def json_object(fields: list[tuple[str, Column, Column]]) -> Column:
    """An object of (name, whether it is there, JSON text of the value)."""
    parts = F.array(*(F.when(there, F.concat(F.lit(f'"{name}":'), value)) for name, there, value in fields))
    return F.concat(F.lit("{"), F.array_join(F.filter(parts, lambda x: x.isNotNull()), ","), F.lit("}"))


def field_kind(text: Column, name: str) -> Column:
    """The kind of a top-level field of an object: SET and COUNTER for deltas, else the name of a JSON type (VOID for a
    null); null if it is absent."""
    parsed = F.try_parse_json(text)

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))

    at = f"$['{name}']"
    plain = kind(at)
    # Only an object can be a delta, so other values are looked up once.
    delta = F.when(kind(f"{at}['__lfSet']").startswith("OBJECT"), "SET").when(kind(f"{at}['__lfCounter']").isNotNull(), "COUNTER").otherwise("OBJECT")
    return F.when(plain.startswith("OBJECT"), delta).otherwise(F.regexp_extract(plain, "^[A-Z]+", 0))
