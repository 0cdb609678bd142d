"""Values of any column type as JSON text and back, without loss.

JSON has no bytes, no integers beyond 53 bits and no odd floats, so these are objects of one tagged field. Everything is an
expression: encode() builds the text, decode() reads it into the shape in which tags are structs and takes them off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json import json_value

#: The tags. Integers and odd floats are the base64 of eight bytes, the lowest first.
INTEGER, BYTES, FLOAT, DECIMAL, DATE, TIME, LOCAL = "$integer", "$bytes", "$float", "$decimal", "$date", "$micros", "$local"
#: Floats that JSON cannot write, by their eight bytes.
ODD = {"NaN": "AAAAAAAA+H8=", "Infinity": "AAAAAAAA8H8=", "-Infinity": "AAAAAAAA8P8=", "-0.0": "AAAAAAAAAIA="}
_FLOATS = (T.FloatType, T.DoubleType)
_PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.StringType)


def _turned(digits: Column) -> Column:
    """Sixteen hex digits with their bytes in reverse."""
    return F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2)))


def _tagged(tag: str, text: Column) -> Column:
    return F.concat(F.lit(f'{{"{tag}":"'), text, F.lit('"}'))


def encode(col: Column, dtype: T.DataType) -> Column:
    """The JSON text of a value; "null" for null."""
    if isinstance(dtype, T.LongType):
        text = _tagged(INTEGER, F.base64(F.unhex(_turned(F.lpad(F.hex(col), 16, "0")))))
    elif isinstance(dtype, T.BinaryType):
        text = _tagged(BYTES, F.regexp_replace(F.base64(col), r"\s", ""))
    elif isinstance(dtype, T.DecimalType):
        text = _tagged(DECIMAL, col.cast("string"))
    elif isinstance(dtype, T.DateType):
        text = _tagged(DATE, F.unix_date(col).cast("string"))
    elif isinstance(dtype, T.TimestampType):
        text = _tagged(TIME, F.unix_micros(col).cast("string"))
    elif isinstance(dtype, T.TimestampNTZType):
        text = _tagged(LOCAL, col.cast("string"))
    elif isinstance(dtype, _FLOATS):
        plain = col.cast("string")
        odd = F.lit(None).cast("string")
        for name, raw in ODD.items():
            odd = F.when(plain == name, raw).otherwise(odd)
        text = F.when(odd.isNotNull(), _tagged(FLOAT, odd)).otherwise(plain)
    elif isinstance(dtype, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(col, lambda x: encode(x, dtype.elementType)), ","), F.lit("]"))
    elif isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        entries = F.transform(F.map_entries(col), lambda e: F.concat(json_value(e["key"]), F.lit(":"), encode(e["value"], dtype.valueType)))
        text = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    elif isinstance(dtype, T.StructType):
        parts = [F.concat(json_value(F.lit(f.name)), F.lit(":"), encode(col[f.name], f.dataType)) for f in dtype.fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(dtype, _PLAIN):
        text = json_value(col)
    else:
        raise TypeError(f"no JSON form for {dtype.simpleString()}")
    return F.when(col.isNull(), "null").otherwise(text)


def _wire(dtype: T.DataType) -> T.DataType:
    """The type that JSON text of a value is read as, tags and all."""
    tag = {T.LongType: INTEGER, T.BinaryType: BYTES, T.DecimalType: DECIMAL, T.DateType: DATE, T.TimestampType: TIME, T.TimestampNTZType: LOCAL}.get(type(dtype))
    if tag:
        return T.StructType([T.StructField(tag, T.StringType())])
    if isinstance(dtype, _FLOATS):
        return T.StringType()  # a number or an object, as its text
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_wire(dtype.elementType))
    if isinstance(dtype, T.MapType):
        return T.MapType(T.StringType(), _wire(dtype.valueType))
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _wire(f.dataType)) for f in dtype.fields])
    return dtype


def _untagged(x: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.LongType):
        return F.conv(_turned(F.hex(F.unbase64(x[INTEGER]))), 16, -10).cast("bigint")
    if isinstance(dtype, T.BinaryType):
        return F.unbase64(x[BYTES])
    if isinstance(dtype, T.DecimalType):
        return x[DECIMAL].cast(dtype)
    if isinstance(dtype, T.DateType):
        return F.date_from_unix_date(x[DATE].cast("int"))
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(x[TIME].cast("bigint"))
    if isinstance(dtype, T.TimestampNTZType):
        return x[LOCAL].cast(dtype)
    if isinstance(dtype, _FLOATS):
        raw = F.when(x.startswith("{"), F.get_json_object(x, f"$['{FLOAT}']"))  # plain numbers need no parser
        odd = F.lit(None).cast("string")
        for name, text in ODD.items():
            odd = F.when(raw == text, name).otherwise(odd)
        return F.coalesce(odd, x).cast(dtype)
    if isinstance(dtype, T.ArrayType):
        return F.transform(x, lambda e: _untagged(e, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(x, lambda _, v: _untagged(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(_untagged(x[f.name], f.dataType).alias(f.name) for f in dtype.fields)))
    return x


def _read(text: Column, dtype: T.DataType) -> Column:
    """The tagged value of JSON text."""
    return F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), T.StructType([T.StructField("v", _wire(dtype))]))["v"]


def decode(text: Column, dtype: T.DataType) -> Column:
    """The value of JSON text that encode() made; null for "null" and for text that is not JSON."""
    return _untagged(_read(text, dtype), dtype)


def encode_rows(rows: DataFrame, column: str = "json") -> DataFrame:
    """One column: each whole row as text."""
    return rows.select(encode(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), rows.schema).alias(column))


def decode_rows(texts: DataFrame, schema: T.StructType, column: str = "json") -> DataFrame:
    """The columns of whole rows. A generator stands between reading and untagging: Spark does not merge expressions across
    it, so each text is read once and not once for each place where a column is used."""
    read = texts.select(F.inline(F.array(_read(F.col(column), schema))))
    return read.select(*(_untagged(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema.fields))
