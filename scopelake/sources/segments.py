"""Search postings in segments of a store.

A segment holds the postings of some rows, each of its files sorted by token, and which rows it speaks of. What a later segment says of a
row, or that it is gone, holds; so an update writes its own segment and no other. Many segments are merged into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import TableDef
from .store import Conflict, Store

POSTINGS, ROWS = "id string, token string, field int", "id string"
#: Segments before they are merged.
SEGMENTS = 16


def _parts(store: Store, name: str) -> dict[int, str]:
    """Folders of a table's parts by their number: later ones have greater ones."""
    return {int(n.rpartition("#")[2]): f for n, f in store._folders(f"{name}#").items()}


def has_segments(store: Store, table: TableDef) -> bool:
    return bool(_parts(store, f"postings/{table.name}"))


def _numbered(store: Store, name: str, shape: str) -> DataFrame:
    """The rows of all parts, with the number of their part."""
    out = store.spark.createDataFrame([], f"{shape}, seq bigint")
    for number, folder in _parts(store, name).items():
        out = out.union(store._rows([folder], shape).withColumn("seq", F.lit(number).cast("long")))
    return out


def postings(store: Store, table: TableDef) -> DataFrame:
    """id, token and field as the latest segment of each row has them. A condition on tokens reaches the files."""
    every = _numbered(store, f"postings/{table.name}", POSTINGS)
    latest = _numbered(store, f"posted/{table.name}", ROWS).groupBy("id").agg(F.max("seq").alias("__last"))
    return every.join(latest, "id", "left").filter(F.coalesce("__last", "seq") == F.col("seq")).select("id", "token", "field")


def add_segment(store: Store, table: TableDef, found: DataFrame, rows: DataFrame) -> None:
    """Adds the postings of rows(id) as they are now; a row without postings is gone. The first segment of a table speaks of
    all rows there are, so it need not list them."""
    base, name = store.version(), f"postings/{table.name}"
    held = _parts(store, name)
    number = max(held, default=0) + 1
    parts = {f"{name}#{number:012d}": _by_token(found)}
    if held:
        parts[f"posted/{table.name}#{number:012d}"] = rows.select("id").distinct()
    store.replace_all(parts, base=base)  # another writer's segment of that number is a Conflict
    if len(held) >= SEGMENTS:
        merge(store, table)


def _by_token(found: DataFrame) -> DataFrame:
    """Each slice sorted by itself: no posting is moved for it."""
    return found.sortWithinPartitions("token", "id").select("id", "token", F.col("field").cast("int").alias("field"))


def merge(store: Store, table: TableDef) -> bool:
    """Writes all segments as one; False if another writer was at it."""
    base, name = store.version(), f"postings/{table.name}"
    held, listed = _parts(store, name), _parts(store, f"posted/{table.name}")
    first = f"{name}#{max(held):012d}"
    gone = [(f"{name}#{n:012d}", "") for n in held if n != max(held)] + [(f"posted/{table.name}#{n:012d}", "") for n in listed]
    try:
        return store.replace_all({first: _by_token(postings(store, table))}, None, lambda: gone, base)
    except Conflict:
        return False
