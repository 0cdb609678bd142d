"""Relations: left-outer joins whose matches are nested, so the rows of the base stay as many as they were.

Rows of a target come in the order of _seq if it has that column, else of _id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Relation


def tie(df: DataFrame) -> str:
    return "_seq" if "_seq" in df.columns else "_id"


def _row(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def _attach(base: DataFrame, name: str, found: DataFrame, here: Column, there: str, empty: bool) -> DataFrame:
    rest = base.drop(name) if name in base.columns and name not in ("__k",) else base
    joined = base.withColumn("__base_key", here).join(found, F.col("__base_key") == F.col(there), "left")
    value = F.coalesce(F.col("__rel"), F.array().cast(found.schema["__rel"].dataType)) if empty else F.col("__rel")
    return joined.select(*(F.col(f"`{c}`") for c in rest.columns), value.alias(name))


def attach(base: DataFrame, name: str, relation: Relation, target: DataFrame, through: DataFrame | None = None) -> DataFrame:
    """base with the column `name`: a struct (one) or an array of structs of target rows; it replaces one of that name."""
    if relation.kind == "one":
        found = target.select(F.col("_id").alias("__k"), _row(target).alias("__rel"))
        return _attach(base, name, found, F.col(f"`{relation.fk}`"), "__k", False)
    order = tie(target)
    if relation.kind == "many":
        found = target.filter(F.col(f"`{relation.fk}`").isNotNull()).groupBy(F.col(f"`{relation.fk}`").alias("__k"))
        found = found.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_id").alias("i"), _row(target).alias("r")))).alias("__s"))
        return _attach(base, name, found.select("__k", F.transform("__s", lambda x: x["r"]).alias("__rel")), F.col("_id"), "__k", True)
    if relation.kind == "many_to_many":
        links = through.select(F.col(f"`{relation.local_key}`").alias("__k"), F.col(f"`{relation.target_key}`").alias("__t"), F.col(tie(through)).alias("__o"))
        links = links.groupBy("__k", "__t").agg(F.min("__o").alias("__o"))
    else:
        ids = F.col(f"`{relation.fk}`")
        links = base.select(F.col("_id").alias("__k"), F.posexplode(ids).alias("__o", "__t"))
    found = links.join(target.select(F.col("_id").alias("__i"), _row(target).alias("__r")), F.col("__t") == F.col("__i"))
    found = found.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("__o", "__t", "__r"))).alias("__s"))
    return _attach(base, name, found.select("__k", F.transform("__s", lambda x: x["__r"]).alias("__rel")), F.col("_id"), "__k", True)


def flat(base: DataFrame, relation: Relation, target: DataFrame, through: DataFrame | None = None) -> DataFrame:
    """One row for each related row: _base, the id of the base row, `place`, by which the related rows of a base row sort (with
    _id), and the target's columns. For keys with any number of related rows: nothing is collected, and a hot key is left
    to Spark's skew joins."""
    if relation.kind == "one":
        links = base.select(F.col("_id").alias("_base"), F.col(f"`{relation.fk}`").alias("__t"), F.lit(0).cast("string").alias("place"))
    elif relation.kind == "many":
        found = target.withColumn("place", F.col(tie(target)).cast("string")) if tie(target) == "_id" else target.withColumn("place", F.format_string("%019d", F.col("_seq")))
        return found.join(base.select(F.col("_id").alias("_base")), F.col(f"`{relation.fk}`") == F.col("_base"))
    elif relation.kind == "many_to_many":
        at = F.col(tie(through))
        links = through.groupBy(F.col(f"`{relation.local_key}`").alias("_base"), F.col(f"`{relation.target_key}`").alias("__t")).agg(F.min(F.format_string("%019d", at) if tie(through) == "_seq" else at).cast("string").alias("place"))
        links = links.join(base.select(F.col("_id").alias("_base")), "_base", "left_semi")
    else:
        links = base.select(F.col("_id").alias("_base"), F.posexplode(F.col(f"`{relation.fk}`")).alias("__p", "__t")).withColumn("place", F.format_string("%019d", F.col("__p").cast("long"))).drop("__p")
    return links.join(target, F.col("__t") == F.col("_id")).drop("__t")


def members_only(df: DataFrame, scope_column: str, membership: DataFrame, user: str) -> DataFrame:
    """Rows of scopes in which the user has a role; membership(user_id, scope_value, role)."""
    mine = membership.filter((F.col("user_id") == user) & F.col("role").isNotNull()).select("scope_value")
    return df.join(mine, df[scope_column] == mine["scope_value"], "left_semi")


def with_role(df: DataFrame, scope_column: str, membership: DataFrame, user: str) -> DataFrame:
    mine = membership.filter(F.col("user_id") == user).groupBy(F.col("scope_value").alias("__s")).agg(F.max("role").alias("role"))
    return df.join(mine, df[scope_column] == F.col("__s"), "left").drop("__s")


def keep_except_ghosts(rows: DataFrame, column: str, value, kept: DataFrame) -> DataFrame:
    """Rows of other scopes, and those of scope column = value whose _id is in `kept`."""
    ghosts = rows.filter(F.col(column).eqNullSafe(F.lit(value))).join(kept.select("_id"), "_id", "left_anti").select("_id")
    return rows.join(ghosts, "_id", "left_anti")
