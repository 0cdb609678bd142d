"""Near-duplicate embeddings of one label, by collision counting over sorted one-dimensional projections.

Unit vectors with cosine c lie sqrt(2 - 2c) apart. Each of PROJECTIONS random directions sorts the vectors of a block;
a vector's window holds those whose projection lies within WIDTH distances (at the threshold) of its own. A pair at the
threshold collides in a window with a known probability, so a pair is verified by its exact cosine if its collisions
reach the count that such pairs miss with probability MISS at most; closer pairs collide more often.

Distribution: equal vectors of a label are one representative with a weight. A label of at most BLOCK representatives is
one group. Larger labels are dealt to groups in several tables: a table's group is named by the cells, CELL wide, that a
few more random projections of a vector fall in. The number of projections follows the logarithm of the largest label and how
alike its vectors are on the whole (embeddings of a model share a direction), so groups of unrelated vectors stay about
BLOCK rows, and the number of tables is the least for which a pair at the threshold
shares no group with probability MISS at most; so rows shuffled grow nearly in proportion to the input, not with the
square of a label. A pair is counted in the first table that brings it together. A group that is larger all the same
(copies with noise) is split, and its parts are compared with each other: such a group's pairs mostly are links, which
have to be counted. Only ids and group names are dealt out first; vectors follow to groups of two or more. A task
returns the number of links of each vector and a spanning forest of the links, never the pairs. Components are found by
star contraction in DataFrame operations.

Edge cases: vectors that are null, zero, not finite or of another length than most link with nothing, nor do rows
without a label or an id; they are their own component. Repeated rows count as vectors of their own, whatever their ids:
one id with several labels or vectors links by each of them. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .vectors import gaussian, normal_cdf, usable, with_dimension

PROJECTIONS, WIDTH, MISS = 48, 1.2, 1e-5
BLOCK, CELL = 8192, 2.0


def least_collisions(projections: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """The greatest count that a pair at the threshold falls short of with probability `miss` at most."""
    p = 2 * normal_cdf(width) - 1
    below = 0.0
    for k in range(projections + 1):
        below += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > miss:
            return k
    return projections


def links_between(a: np.ndarray, b: np.ndarray | None, directions: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) with at least this cosine; b None: pairs i < j within a. Rows are original vectors."""
    na = np.sqrt((a * a).sum(1))
    other, nb = (a, na) if b is None else (b, np.sqrt((b * b).sum(1)))
    pa, pb = (a / na[:, None]) @ directions, (other / nb[:, None]) @ directions
    half, least = WIDTH * math.sqrt(max(0.0, 2 - 2 * cosine)), least_collisions(directions.shape[1])
    order = np.argsort(pb, axis=0, kind="stable")
    low, high = np.empty(pa.shape, dtype=np.int64), np.empty(pa.shape, dtype=np.int64)
    for j in range(pa.shape[1]):
        ranked = pb[order[:, j], j]
        low[:, j], high[:, j] = np.searchsorted(ranked, pa[:, j] - half, "left"), np.searchsorted(ranked, pa[:, j] + half, "right")
    lists = [np.ascontiguousarray(order[:, j]) for j in range(pa.shape[1])]
    left, right = [], []
    for i in range(len(a)):
        met = np.concatenate([x[s:e] for x, s, e in zip(lists, low[i].tolist(), high[i].tolist())])
        found = np.flatnonzero(np.bincount(met, minlength=len(other)) >= least)
        found = found[found > i] if b is None else found
        if len(found):
            found = found[(other[found] * a[i]).sum(1) / (nb[found] * na[i]) >= cosine]
            left.append(np.full(len(found), i))
            right.append(found)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def spanning(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with edges (u, v)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for x, y in zip(u.tolist(), v.tolist()):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def same_cell(distance: float, cell: float = CELL) -> float:
    """The probability that two vectors so far apart fall in one cell of a random projection."""
    r = cell / max(distance, 1e-12)
    return 2 * normal_cdf(r) - 1 - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


@dataclass(frozen=True)
class Tables:
    """How unit vectors are dealt to groups: `count` tables of `width` projections each."""

    count: int
    width: int
    directions: np.ndarray
    offsets: np.ndarray

    @classmethod
    def plan(cls, dim: int, largest: int, block: int, cosine: float, miss: float = MISS, likeness: float = 0.0) -> Tables:
        """Width 0 and one table if the largest label fits a block: then its label names the group. likeness: the mean cosine
        of unrelated vectors; the nearer they are to each other, the more projections it takes to tell them apart."""
        near = math.sqrt(max(0.0, 2 - 2 * cosine))
        apart = max(math.sqrt(2 - 2 * min(1.0, likeness)), 1.05 * near)
        width = max(0, math.ceil(math.log(largest / block) / -math.log(same_cell(apart)))) if largest > block else 0
        together = same_cell(math.sqrt(max(0.0, 2 - 2 * cosine))) ** width
        count = 1 if together >= 1 else math.ceil(math.log(miss) / math.log(1 - together))
        return cls(count, width, gaussian(dim, count * width, seed=17), np.random.default_rng(18).uniform(0, CELL, count * width))

    def groups(self, units: np.ndarray) -> np.ndarray:
        """The group of each vector (row) in each table (column), as a number."""
        if not self.width:
            return np.zeros((len(units), 1), dtype=np.int64)
        cells = np.floor((units @ self.directions + self.offsets) / CELL).astype(np.int64).view(np.uint64).reshape(len(units), self.count, self.width)
        out = np.zeros(cells.shape[:2], dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.width):
                out = (out ^ cells[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return out.view(np.int64)


def _matrix(col: pd.Series, dim: int) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float) if len(col) else np.zeros((0, dim))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def likeness(reps: DataFrame, dim: int, block: int) -> float:
    """The greatest mean cosine of two vectors of a label of more than `block`: the squared length of its mean unit vector,
    from sums of every vector of reps(label, v). 0 if the directions of a label cancel out."""

    def sums(frames):
        for f in frames:
            units = _units(_matrix(f["v"], dim))
            for label, at in f.groupby("label").indices.items():
                yield pd.DataFrame({"label": [label], "n": [len(at)], "s": [units[at].sum(0)]})

    label = reps.schema["label"].dataType.simpleString()
    parts = reps.select("label", "v").mapInPandas(sums, f"label {label}, n bigint, s array<double>")
    whole = parts.select("label", "n", F.posexplode("s").alias("at", "x")).groupBy("label", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    means = whole.groupBy("label").agg(F.max("n").alias("n"), F.sum((F.col("x") / F.col("n")) ** 2).alias("c")).filter(F.col("n") > block)
    return means.agg(F.coalesce(F.max("c"), F.lit(0.0))).first()[0]


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors(vec_id, embedding, label)."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select("vec_id", "label", F.when(usable(vectors) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.col("embedding").cast(kind)).alias("v"))
    live, dim = with_dimension(rows.filter("v is not null"))
    if not dim:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    # Representatives get a number of their own; the checkpoint fixes it.
    reps = cut(live.groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight")).withColumn("rep", F.monotonically_increasing_id()))
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0]
    alike = likeness(reps, dim, block) if largest > block else 0.0
    tables, directions = Tables.plan(dim, largest, block, cosine, likeness=alike), gaussian(dim, PROJECTIONS, seed=11)

    def name(frames):
        for f in frames:
            codes = tables.groups(_units(_matrix(f["v"], dim)))
            n = len(f)
            yield pd.DataFrame({"label": np.repeat(f["label"].to_numpy(), tables.count), "rep": np.repeat(f["rep"].to_numpy(), tables.count), "t": np.tile(np.arange(tables.count, dtype=np.int32), n), "code": codes.reshape(-1)})

    label = reps.schema["label"].dataType.simpleString()
    named = reps.select("label", "rep", "v").mapInPandas(name, f"label {label}, rep bigint, t int, code bigint")
    named = cut(named) if tables.width else named
    group = ["label", "t", "code"]
    sizes = named.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"), F.count("*").alias("n")).filter("n > 1").drop("n")
    placed = named.join(sizes, group).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    # A part meets itself and every other part of its group: one task per pair of parts.
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    sides = met.select("rep", *group, F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), (F.col("part") > F.col("other")).cast("int").alias("side"))
    full = sides.join(reps.select("rep", "weight", "v"), "rep")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["side", "rep"], kind="stable")
        x, rep, weight, table = _matrix(f["v"], dim), f["rep"].to_numpy(), f["weight"].to_numpy(), int(f["t"].iloc[0])
        n = int((f["side"] == 0).sum()) if f["a"].iloc[0] != f["b"].iloc[0] else len(f)
        i, j = links_between(x[:n], x[n:] if n < len(x) else None, directions, cosine)
        if n < len(x):
            j = j + n
        if table and len(i):
            codes = tables.groups(_units(x))[:, :table]
            first = ~(codes[i] == codes[j]).any(1)
            i, j = i[first], j[first]
        total = np.bincount(i, weight[j], len(x)) + np.bincount(j, weight[i], len(x))
        has = np.flatnonzero(total)
        forest = spanning(rep[i], rep[j])
        return pd.DataFrame({
            "u": np.concatenate([rep[has], [u for u, _ in forest]]).astype("int64"),
            "v": np.concatenate([np.full(len(has), -1), [v for _, v in forest]]).astype("int64"),
            "n": np.concatenate([total[has], np.full(len(forest), -1)]).astype("int64"),
        })

    found = cut(full.groupBy(*group, "a", "b").applyInPandas(compare, "u bigint, v bigint, n bigint"))
    joined = components(found.filter("n = -1").select("u", "v"))
    links = found.filter("n >= 0").groupBy("u").agg(F.sum("n").alias("n"))
    every = (
        reps.join(links, reps.rep == links.u, "left")
        .join(joined, reps.rep == joined.node, "left")
        .select(F.col("label").alias("l"), F.col("v").alias("w"), "low", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("c"))
    )
    every = cut(every)
    lowest = every.groupBy("c").agg(F.min("low").alias("component_id"))
    known = every.join(lowest, "c").select("l", "w", "links", F.col("component_id").alias("c"))
    out = rows.withColumn("v", F.when(F.size("v") == dim, F.col("v"))).join(known, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
