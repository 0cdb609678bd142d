"""Search text: markup out, lower case, runs of letters and digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import js_string

#: Entities that are decoded; all others become a space.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "amp": "&"}


def looks_like_html(col: Column) -> Column:
    return F.coalesce(col.rlike(r"(?i)<[a-z!/][^>]*>"), F.lit(False))


def strip_html(col: Column) -> Column:
    """Tags and unknown entities become spaces; known ones are decoded once ("&amp;lt;" reads "&lt;")."""
    out = F.regexp_replace(col, r"<[^>]*>", " ")
    out = F.regexp_replace(out, rf"(?i)&(?!(?:{'|'.join(ENTITIES)});)(?:[a-z]+|#\d+);", " ")
    for name, value in ENTITIES.items():  # the ampersand last
        out = F.regexp_replace(out, f"(?i)&{name};", value)
    return out


def tokenize(col: Column, dtype: T.DataType | None = None) -> Column:
    """Lower-cased runs of letters and digits, in order; an empty array for null. Arrays are joined by spaces."""
    dtype = dtype or T.StringType()
    if isinstance(dtype, T.ArrayType):
        text = F.array_join(F.transform(col, lambda x: js_string(x, dtype.elementType)), " ", "")
    else:
        text = js_string(col, dtype)
    text = F.when(looks_like_html(text), strip_html(text)).otherwise(text)
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))
