"""Query results that row deltas keep up to date, at a cost that follows the deltas.

A view's matching rows lie in ranges of its order, each a folder of the store, with a small table of where ranges begin and
how many rows they hold. A delta (row_deltas) knows a row as it was and as it is, so it touches the ranges of its two
places and no others. The first rows of a view are in its first ranges: a place that is freed in a limited result is
filled from the next range, which need not be written for it. Grouped views are ordered by group first, so a group is a
few neighbouring ranges. Counts are sums of signed contributions, one small part for each delta.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import ordered, sort_key
from ..operators import relations
from ..plans.query import Query
from ..sources.shared import cut
from ..sources.store import Store

#: About how many rows a range holds.
RANGE_ROWS = 50_000
#: Sorted partitions that a new view is cut from at most.
PARTITIONS = 256


def _compare(a: Column, b: Column, down: bool) -> Column:
    """-1, 0 or 1: how two keys stand in the order; nulls are smallest."""
    up = F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)
    return -up if down else up


def sides(deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as they were and as they are, of deltas(_id, kind, row, was)."""
    return deltas.filter("was is not null").select("_id", "was.*") if "_id" not in deltas.schema["was"].dataType.fieldNames() else deltas.filter("was is not null").select("was.*"), (
        deltas.filter("row is not null").select("_id", "row.*") if "_id" not in deltas.schema["row"].dataType.fieldNames() else deltas.filter("row is not null").select("row.*")
    )


class LiveQuery:
    """The rows of a plan, in its order. With a grouping, order and limit of the plan hold as in Query.groups(), but the
    limit, which is taken before groups are made, is not kept up."""

    def __init__(self, store: Store, name: str, query: Query, user: str | None = None, range_rows: int = RANGE_ROWS):
        if query.group_field and query.rows is not None:
            raise ValueError("a grouped view has no limit")
        self.store, self.name, self.query, self.user, self.range_rows = store, f"views/{name}", query, user, range_rows

    # Order

    def _keys(self, rows: DataFrame) -> list[tuple[Column, bool]]:
        q, keys = self.query, []
        if q.group_field:
            keys.append((q.key_column(), False))
        if q.ordering:
            keys.append((ordered(F.col(f"`{q.ordering[0]}`"), q.table.type_of(q.ordering[0]), q.collation), q.ordering[1]))
        return keys + [(F.col(c), False) for c in dict.fromkeys([relations.tie(rows), "_id"])]

    def _sorted(self, rows: DataFrame) -> list[Column]:
        return [sort_key(k, down) for k, down in self._keys(rows)]

    def _held(self) -> list:
        """Ranges by position: range_id, n and low, the keys of its first row when it was made."""
        folders = self.store._folders(f"{self.name}/")
        return sorted(self.store.spark.read.parquet(f"{self.store.base}/{folders[f'{self.name}/ranges']}").collect(), key=lambda r: r.position)  # a row for each range

    def _place(self, rows: DataFrame, held: list) -> DataFrame:
        """rows with __range, the position of the range they belong to: how many lower bounds, but for the first, do not come
        after the row. Rows and bounds are sorted together and counted in two passes, whatever the number of ranges."""
        if len(held) < 2:
            return rows.withColumn("__range", F.lit(0))
        keys, down = [k for k, _ in self._keys(rows)], [d for _, d in self._keys(rows)]
        names = [f"__k{i}" for i in range(len(keys))]
        own = rows.withColumns({n: k for n, k in zip(names, keys)}).withColumn("__low", F.lit(0))
        typed = own.select(*names).schema
        plain = [T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.StringType) else f.dataType) for f in typed]
        lows = self.store.spark.createDataFrame([tuple(r.low) for r in held[1:]], T.StructType(plain)).withColumns({f.name: F.col(f.name).cast(f.dataType) for f in typed}).withColumn("__low", F.lit(1))
        order = [*(sort_key(F.col(n), d) for n, d in zip(names, down)), F.desc("__low")]
        both = own.unionByName(lows, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order)
        both = cut(both.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
        sums = both.groupBy("__part").agg(F.sum("__low").alias("__n"))  # a row for each partition
        before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inside = F.sum("__low").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
        counted = both.withColumn("__inside", inside).filter("__low = 0")
        placed = counted.join(F.broadcast(sums.select("__part", before.alias("__before"))), "__part")
        return placed.withColumn("__range", (F.col("__before") + F.col("__inside")).cast("int")).drop(*names, "__low", "__part", "__at", "__before", "__inside")

    def _folder_rows(self, ids: list[str]) -> DataFrame:
        held = self.store._folders(f"{self.name}#")
        return self.store.spark.read.parquet(*(f"{self.store.base}/{held[f'{self.name}#{i}']}" for i in ids))

    def _ranged_rows(self, held: list, positions: list[int]) -> DataFrame:
        """The rows of some ranges with __range: the folder that a row lies in tells it."""
        folders = self.store._folders(f"{self.name}#")
        at = self.store.spark.createDataFrame([("/".join(folders[f"{self.name}#{held[p].range_id}"].rsplit("/", 2)[1:]), p) for p in positions], "__folder string, __range int")
        rows = self._folder_rows([held[p].range_id for p in positions])
        rows = rows.withColumn("__folder", F.regexp_extract(F.col("_metadata.file_path"), "([0-9a-f]+/__[a-z]+=[0-9]+)/[^/]+$", 1))
        return rows.join(F.broadcast(at), "__folder").drop("__folder")

    # Writing

    def _deal(self, rows: DataFrame, position: str | None, parts: int) -> tuple[list[tuple], list[tuple[str, str]]]:
        """Writes rows by ranges, and returns their (range_id, n, low) in order and the names and folders. position: a column
        that has them dealt already; else they are dealt to about `parts` ranges of the order."""
        if position is None:
            # Many ranges are cut from fewer sorted partitions: Spark asks for a sample of the rows for each of these.
            rows = rows.repartitionByRange(min(parts, PARTITIONS), *self._sorted(rows)).sortWithinPartitions(*self._sorted(rows))
            whole = F.monotonically_increasing_id()
            share = F.pmod(whole, F.lit(1 << 33)) / self.range_rows if parts > PARTITIONS else F.lit(0)
            rows = rows.withColumn("__range", F.spark_partition_id().cast("long") * (1 << 20) + F.floor(share))
            position = "__range"
        folder = f"data/{self.name}/{uuid.uuid4().hex}"
        rows.repartition(position).sortWithinPartitions(position, *self._sorted(rows)).write.partitionBy(position).parquet(f"{self.store.base}/{folder}")
        if not self.store.has_parts(folder):
            return [], []
        written = self.store.spark.read.parquet(f"{self.store.base}/{folder}")
        low = F.struct(*(k.alias(f"k{i}") for i, (k, _) in enumerate(self._keys(written))))
        first = Window.partitionBy(position).orderBy(*self._sorted(written))
        total = Window.partitionBy(position)
        found = written.select(position, low.alias("low"), F.row_number().over(first).alias("__n"), F.count("*").over(total).alias("n")).filter("__n = 1").orderBy(position).collect()
        made = [(uuid.uuid4().hex, r.n, r.low, r[position]) for r in found]
        return made, [(f"{self.name}#{i}", f"{folder}/{position}={p}") for i, _, _, p in made]

    def _table(self, ranges: list[tuple], rows: DataFrame) -> DataFrame:
        """The table of ranges; an empty view has one without rows."""
        typed = rows.select(F.struct(*(k.alias(f"k{i}") for i, (k, _) in enumerate(self._keys(rows)))).alias("low")).schema["low"]
        shape = f"position int, range_id string, n bigint, low {typed.dataType.simpleString()}"
        return self.store.spark.createDataFrame([(p, i, n, tuple(low) if low is not None else None) for p, (i, n, low) in enumerate(ranges)], shape).coalesce(1)

    def reset(self, rows: DataFrame) -> None:
        """The view from all rows of its table."""
        base, match = self.store.version(), self.query.matching(rows, self.user)
        n = match.count()
        made, named = self._deal(match, None, max(1, -(-n // self.range_rows)))
        if not made:  # the columns are kept in an empty range
            empty = f"data/{self.name}/{uuid.uuid4().hex}"
            match.limit(0).write.parquet(f"{self.store.base}/{empty}")
            made, named = [("none", 0, None, 0)], [(f"{self.name}#none", empty)]
        old = [(name, "") for name in self.store._folders(f"{self.name}#")]
        self.store.replace_all({f"{self.name}/ranges": self._table([m[:3] for m in made], match)}, None, lambda: [*old, *named], base)

    def apply(self, deltas: DataFrame) -> list[int]:
        """Takes deltas(_id, kind, row, was) in, and returns the positions of the ranges that were written: none if no
        delta is a row of the view, before or after."""
        base, held = self.store.version(), self._held()
        was, now = (self.query.matching(side, self.user) for side in sides(deltas))
        both = cut(self._place(was.withColumn("__new", F.lit(False)).unionByName(now.withColumn("__new", F.lit(True)), allowMissingColumns=True), held))
        touched = sorted(r[0] for r in both.select("__range").distinct().collect())  # positions
        if not touched:
            return []
        kept = self._ranged_rows(held, touched).join(deltas.select("_id"), "_id", "left_anti")
        rows = kept.unionByName(both.filter("__new").select(*kept.columns))
        kept = kept.drop("__range")
        size = Window.partitionBy("__range")
        at = F.row_number().over(size.orderBy(*self._sorted(rows))) - 1
        # A range that has grown to twice its size is cut into parts.
        part = F.when(F.count("*").over(size) > 2 * self.range_rows, F.floor(at / self.range_rows)).otherwise(0)
        dealt = rows.withColumn("__place", F.col("__range").cast("long") * (1 << 20) + part).drop("__range")
        made, named = self._deal(dealt, "__place", 0)
        new: dict[int, list] = {}
        for i, n, low, place in made:
            p, k = divmod(place, 1 << 20)
            new.setdefault(p, []).append((i, n, held[p].low if k == 0 and p else low))  # a range keeps its lower bound
        ranges = [m for p, r in enumerate(held) for m in (new.get(p, []) if p in touched else [(r.range_id, r.n, r.low)])]
        gone = [(f"{self.name}#{held[p].range_id}", "") for p in touched]
        if not ranges:  # keep one empty range
            ranges, gone = [("none", 0, None)], gone
            empty = f"data/{self.name}/{uuid.uuid4().hex}"
            kept.limit(0).write.parquet(f"{self.store.base}/{empty}")
            named = [(f"{self.name}#none", empty)]
            gone = [g for g in gone if g[0] != f"{self.name}#none"]
        self.store.replace_all({f"{self.name}/ranges": self._table(ranges, kept)}, None, lambda: [*gone, *named], base)
        return touched

    # Reading

    def rows(self) -> DataFrame:
        """All matching rows."""
        return self._folder_rows([r.range_id for r in self._held()])

    def result(self) -> DataFrame:
        """The rows of the plan in order; of a limited one only the ranges that hold them are read."""
        ids, n = [], 0
        for r in self._held():
            if not ids or self.query.rows is None or n < self.query.rows:
                ids.append(r.range_id)
                n += r.n
        rows = self._folder_rows(ids)
        out = rows.orderBy(*self._sorted(rows))
        return out if self.query.rows is None else out.limit(self.query.rows)

    def group(self, key: str | None) -> DataFrame:
        """The rows of one group in order: only the ranges that the group can lie in are read."""
        held = self._held()
        known = [(None if r.low is None else r.low[0]) for r in held]
        small = lambda v: (v is not None, v or "")  # noqa: E731  nulls are smallest
        ids = [r.range_id for p, r in enumerate(held) if (p == 0 or small(known[p]) <= small(key)) and (p + 1 == len(held) or small(known[p + 1]) >= small(key))]
        rows = self._folder_rows(ids)
        return rows.filter(self.query.key_column().eqNullSafe(F.lit(key))).orderBy(*self._sorted(rows))

    def counts(self) -> DataFrame:
        return self.rows().groupBy(self.query.key_column().alias("key")).agg(F.count("*").alias("n"))


def touched_groups(deltas: DataFrame, old: DataFrame, column: str) -> DataFrame:
    """key: the groups that deltas may have changed, by the value before and after."""
    before = old.join(deltas.select("_id"), "_id", "left_semi").select(F.col(column).cast("string").alias("key"))
    return before.union(deltas.filter("kind = 'upsert'").select(F.col(f"row.{column}").cast("string"))).distinct()


class LiveCounts:
    """Rows of each group of a plan, or of all of it: a sum over signed contributions, to which each delta adds its own."""

    SHAPE = "key string, n bigint"

    def __init__(self, store: Store, name: str, query: Query, user: str | None = None):
        self.store, self.name, self.query, self.user = store, f"counts/{name}", query, user

    def _each(self, rows: DataFrame, sign: int) -> DataFrame:
        key = self.query.key_column() if self.query.group_field else F.lit("")
        return self.query.matching(rows, self.user).groupBy(key.alias("key")).agg((F.count("*") * sign).alias("n"))

    @staticmethod
    def _sums(parts: DataFrame) -> DataFrame:
        return parts.groupBy("key").agg(F.sum("n").alias("n")).filter("n <> 0")

    def reset(self, rows: DataFrame) -> None:
        base = self.store.version()
        old = [(name, "") for name in self.store._folders(f"{self.name}#")]
        self.store.replace_all({f"{self.name}#{uuid.uuid4().hex}": self._each(rows, 1)}, None, lambda: old, base)

    def apply(self, deltas: DataFrame) -> None:
        """Takes deltas(_id, kind, row, was) in: groups that lose and win the same number are not written."""
        was, now = sides(deltas)
        self.store.replace_all({f"{self.name}#{uuid.uuid4().hex}": self._sums(self._each(was, -1).union(self._each(now, 1)))})
        self.store._fold_parts(self.name, self.SHAPE, self._sums)

    def result(self) -> DataFrame:
        """key and n of groups that have rows, or n alone."""
        sums = self._sums(self.store.parts(self.name, self.SHAPE))
        return sums if self.query.group_field else sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
