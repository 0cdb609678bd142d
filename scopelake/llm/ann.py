"""Nearest neighbours by inner product: stable projections to a few dimensions, indexed by kd-trees.

Inner product becomes distance by one more coordinate: with M the greatest length, (v, sqrt(M^2 - |v|^2)) and (q, 0) lie
sqrt(M^2 + |q|^2 - 2 q.v) apart. Vectors are projected to DIMS dimensions with standard normal directions, so a squared
projected distance is the squared distance times a chi-square variable of DIMS degrees of freedom. A query visits the
leaves of a kd-tree over the projections nearest first and verifies their vectors exactly, until the projected distance
of the next leaf exceeds sqrt(chi-square quantile of SURE) times the k-th distance found: each nearer vector lies beyond
that with probability 1 - SURE at most.

Distribution: the top of the tree (fitted on a bounded sample, MOST_CELLS cells at most) deals all vectors to cells, and
cells that hold more than BLOCK rows are split by a hash, so a block never outgrows a task. A query first searches the
block it falls in; the k-th distance found there decides by the same test which other cells it visits: the WAVE nearest of
them first, whose finds narrow the choice of the rest. Queries of a block are split into groups of QUERY_GROUP at most.
Every row is indexed.

Edge cases: vectors that are null, zero, not finite or of another length than most, and rows without an id, take no
part. Ties go to the smaller id; a query with fewer candidates than k gets all that are found. Repeated rows are
separate candidates, except that rows with the query's own id are left out; of several query rows of one id the one whose
vector is the smallest, component by component, asks. Empty tables give an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import SAMPLE_ROWS, Cells, chi2_quantile, gaussian, usable, with_dimension

DIMS, SURE = 8, 0.97
BLOCK, LEAF, QUERY_GROUP, WAVE = 8192, 32, 4096, 3


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with q, added in the same order for every row, so that equal rows tie."""
    return (x * q).sum(1)


class Tree:
    """A kd-tree's leaves over projected points: row order, leaf bounds and boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        parts, stack = [], [np.arange(len(points))] if len(points) else []
        while stack:
            rows = stack.pop()
            if len(rows) <= leaf:
                parts.append(rows)
                continue
            dim = int(np.ptp(points[rows], axis=0).argmax())
            rows = rows[np.argpartition(points[rows, dim], len(rows) // 2)]
            stack += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
        self.parts = parts
        self.low = np.array([points[r].min(0) for r in parts])
        self.high = np.array([points[r].max(0) for r in parts])

    def nearest_leaves(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by squared distance of their box to p, and these distances."""
        off = np.maximum(np.maximum(self.low - p, p - self.high), 0)
        far = (off * off).sum(1)
        order = np.argsort(far, kind="stable")
        return order, far[order]


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, p: np.ndarray, own: int, k: int, top2: float, stop: float, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows found, best first. floor: a score that k other rows are known to reach.

    top2 is M^2; stop the chi-square quantile.
    """
    order, far = tree.nearest_leaves(p)
    q2 = float(q @ q)
    best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0)
    at, step = 0, 4
    while at < len(order):
        bound = max(floor, best[-1]) if len(best) == k else floor
        if bound > -np.inf and far[at] >= stop * max(0.0, top2 + q2 - 2 * bound):
            break
        rows = np.concatenate([tree.parts[i] for i in order[at : at + step]])
        at, step = at + step, step * 2
        rough = x[rows] @ q
        slack = 1e-9 * (1 + abs(top2))
        keep = rough >= bound - slack
        if len(best) + int(keep.sum()) > 4 * k:
            # only rows that can still be among the k best are scored exactly
            cut_at = np.partition(rough, len(rough) - min(len(rough), k + 1))[len(rough) - min(len(rough), k + 1)]
            keep &= rough >= cut_at - slack
        rows = rows[keep]
        rows = rows[ids[rows] != own]
        if len(rows):
            best, best_ids = np.concatenate([best, exact(x[rows], q)]), np.concatenate([best_ids, ids[rows]])
            top = np.lexsort((best_ids, -best))[:k]
            best, best_ids = best[top], best_ids[top]
    return best_ids, best


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, sure: float = SURE, dims: int = DIMS, query_group: int = QUERY_GROUP) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows of vectors(vec_id, embedding) of greatest inner product found for each
    id of queries(vec_id, embedding)."""
    schema = "query_id bigint, vec_id bigint, score double"
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"  # floats travel as floats; tasks compute in doubles
    live = vectors.filter(usable(vectors) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast(kind).alias("v"))
    live, dim = with_dimension(live)
    if not dim:
        return spark.createDataFrame([], schema).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    norm2 = F.aggregate("v", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    n, top2 = live.agg(F.count("*"), F.max(norm2)).first()
    directions, stop = gaussian(dim + 1, dims), chi2_quantile(sure, dims)

    def project(x: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, top2 - (x * x).sum(1)))
        return np.column_stack([x, rest]) @ directions

    def matrix(col: pd.Series) -> np.ndarray:
        return np.stack(col.to_numpy()).astype(float) if len(col) else np.zeros((0, dim))

    sample = live.orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS).toPandas()
    cells = Cells.fit(project(matrix(sample["v"])), math.ceil(n / block))

    def deal(query: bool):
        def run(frames):
            for f in frames:
                p = project(matrix(f["v"]), query)
                yield f.assign(cell=cells.assign(p)) if query else f.assign(cell=cells.assign(p), p=list(p))

        return run

    dealt = cut(live.mapInPandas(deal(False), f"vec_id bigint, v {kind}, cell bigint, p array<double>"))
    bounds = [f(F.col("p")[i]) for f in (F.min, F.max) for i in range(dims)]
    boxes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.array(*bounds[:dims]).alias("low"), F.array(*bounds[dims:]).alias("high")).toPandas()  # a row per cell: MOST_CELLS at most
    subs = np.zeros(len(cells), dtype=np.int64)
    subs[boxes["cell"]] = np.ceil(boxes["n"] / block).astype(int)
    low, high, box_cell = np.stack(boxes["low"]), np.stack(boxes["high"]), boxes["cell"].to_numpy()
    sub_of = F.array(*(F.lit(int(s)) for s in np.maximum(1, subs)))
    data = dealt.select("cell", F.pmod(F.xxhash64("vec_id"), F.get(sub_of, F.col("cell").cast("int"))).cast("int").alias("sub"), "vec_id", "v")

    asked = queries.filter(usable(queries) & F.col("vec_id").isNotNull() & (F.size("embedding") == dim)).groupBy("vec_id").agg(F.min(F.col("embedding").cast(kind)).alias("v"))
    asked = cut(asked.mapInPandas(deal(True), f"vec_id bigint, v {kind}, cell bigint").withColumn("sub", F.pmod(F.xxhash64(F.lit("q"), "vec_id"), F.get(sub_of, F.col("cell").cast("int"))).cast("int")))

    def scan(targets: DataFrame) -> DataFrame:
        """Searches of targets(cell, sub, vec_id, v, floor), in groups of a block and some of its queries."""
        groups = targets.groupBy("cell", "sub").agg(F.ceil(F.count("*") / query_group).cast("int").alias("parts"))
        dealt_q = targets.join(groups, ["cell", "sub"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).drop("parts")
        dealt_v = data.join(groups, ["cell", "sub"]).select("cell", "sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v")
        keys = ["cell", "sub", "part"]

        def run(rows: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("vec_id", kind="stable")
            x, ids = matrix(rows["v"]), rows["vec_id"].to_numpy()
            tree, asking = Tree(project(x)), matrix(qs["v"])
            out = [
                (q, *search(tree, x, ids, v, p, q, k, top2, stop, f))
                for q, v, p, f in zip(qs["vec_id"].tolist(), asking, project(asking, True), qs["floor"].tolist())
                if len(x)
            ]
            return pd.DataFrame({
                "query_id": np.concatenate([np.full(len(i), q, dtype=np.int64) for q, i, _ in out] or [np.zeros(0, np.int64)]),
                "vec_id": np.concatenate([i for _, i, _ in out] or [np.zeros(0, np.int64)]),
                "score": np.concatenate([s for *_, s in out] or [np.zeros(0)]),
            })

        return dealt_v.groupBy(*keys).cogroup(dealt_q.groupBy(*keys)).applyInPandas(run, schema)

    found = cut(scan(asked.withColumn("floor", F.lit(float("-inf")))))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)

    def visits(first: int, last: int):
        """The cells besides the home block that a query must visit, from the first-th nearest to before the last-th."""
        def run(frames):
            for f in frames:
                asking, cs = matrix(f["v"]), []
                for v, p, floor in zip(asking, project(asking, True), f["floor"]):
                    off = np.maximum(np.maximum(low - p, p - high), 0)
                    far = (off * off).sum(1)
                    near = np.argsort(far, kind="stable")[first:last]
                    reach = np.inf if floor == -np.inf else stop * max(0.0, top2 + float(v @ v) - 2 * floor)
                    cs.append(box_cell[near[far[near] < reach]])
                yield f.assign(go=cs)

        return run

    for first, last in ((0, WAVE), (WAVE, len(low))):
        if first >= len(low):
            break
        floors = best(found).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        plan = asked.join(floors, asked.vec_id == floors.query_id, "left").select("vec_id", "v", F.col("cell").alias("home"), F.col("sub").alias("home_sub"), F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        going = plan.mapInPandas(visits(first, last), f"vec_id bigint, v {kind}, home bigint, home_sub int, floor double, go array<bigint>")
        targets = going.select("*", F.explode("go").alias("cell")).select("*", F.explode(F.sequence(F.lit(0), F.get(sub_of, F.col("cell").cast("int")) - 1)).alias("sub")).filter((F.col("cell") != F.col("home")) | (F.col("sub") != F.col("home_sub")))
        found = cut(found.union(scan(targets.select("cell", "sub", "vec_id", "v", "floor"))))
    return best(found).select("query_id", "rank", "vec_id", "score")
