"""The folder that all executors share, and intermediate tables in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session names none, a folder of this machine serves if it runs everything itself
    (a local master); on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="scopelake-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, keys: list[str], order: str, column: str, after: DataFrame | None = None) -> DataFrame:
    """df with a dense number 1, 2, ... in `column`, by `order` within `keys` (none: over all rows); `order` has no ties.
    after(keys, last): what the numbers of a key go on from; it is joined to the counts, of which there are a few for each
    key, and not to the rows, of which one key may hold most.

    In two passes: rows are range-partitioned and counted per partition, and each partition adds the counts before it, so
    one key that holds most rows is still spread over many tasks.
    """
    at, low = F.monotonically_increasing_id(), 1 << 33
    placed = df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).withColumns({"__part": F.spark_partition_id(), "__at": F.pmod(at, F.lit(low))})
    placed = cut(placed)
    sizes = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per key and partition
    offsets = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    if after is not None:
        base = after.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("last").alias("__last"))
        offsets = offsets.join(base, [f"__k{i}" for i in range(len(keys))], "left").withColumn("__before", F.col("__before") + F.coalesce("__last", F.lit(0))).drop("__last")
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = placed.join(offsets, same).withColumn(column, F.col("__before") + F.col("__at") - F.col("__first") + 1)
    return joined.drop("__part", "__at", "__p", "__first", "__before", *[f"__k{i}" for i in range(len(keys))])


def running(df: DataFrame, keys: list[str], order: str, amount: str, column: str) -> DataFrame:
    """df with the sum of `amount` over the rows before each, by `order` within `keys`; `order` has no ties. In two passes,
    as numbered(): the rows of one key need not meet in one task."""
    placed = cut(df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "__part").agg(F.sum(amount).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per key and partition
    offsets = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy("__part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(offsets, same).withColumn(column, F.col("__base") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return joined.drop("__part", "__p", "__base", *[f"__k{i}" for i in range(len(keys))])
