"""Shared by the vector operators: which vectors count, random projections, and cells of projected space."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 20240501
#: Rows that the splits of cells are fitted on, and how many cells the driver's tree may have.
SAMPLE_ROWS, MOST_CELLS = 20_000, 4096


def usable(vectors: DataFrame, embedding: str = "embedding") -> F.Column:
    """Not null, without null or non-finite components, and not all zero."""
    col = F.col(embedding)
    whole = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(col.isNotNull() & whole & F.exists(col, lambda x: x != 0), F.lit(False))


def with_dimension(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The vectors of the commonest length (of equally common ones the greater), and that length; 0 if there are none."""
    row = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (vectors.filter(F.size("v") == row.d), row.d) if row else (vectors, 0)


def gaussian(dim: int, count: int, seed: int = SEED) -> np.ndarray:
    """dim x count independent standard normal directions: 2-stable, so a projection's variance is the squared length."""
    return np.random.default_rng(seed).standard_normal((dim, count))


def normal_cdf(x: float) -> float:
    return (1 + math.erf(x / math.sqrt(2))) / 2


def chi2_cdf(x: float, m: int) -> float:
    """Of m (even) degrees of freedom."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, m: int) -> float:
    low, high = 0.0, 20.0 * m
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, m) < p else (low, mid)
    return high


@dataclass
class Cells:
    """The top of a kd-tree: a full binary tree of splits, dimension and value by node (children of i: 2i+1, 2i+2)."""

    dims: np.ndarray
    cuts: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, cells: int) -> Cells:
        """Splits at the medians of the widest dimensions of a sample, for at least `cells` cells if MOST_CELLS allows."""
        depth = max(0, math.ceil(math.log2(max(1, min(cells, MOST_CELLS)))))
        dims, cuts = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1)
        held = {0: points}
        for i in range(len(dims)):
            part = held.pop(i)
            if len(part):
                dims[i] = int(np.ptp(part, axis=0).argmax())
                cuts[i] = float(np.median(part[:, dims[i]]))
            right = part[:, dims[i]] > cuts[i]
            held[2 * i + 1], held[2 * i + 2] = part[~right], part[right]
        return cls(dims, cuts)

    def __len__(self) -> int:
        return len(self.dims) + 1

    def assign(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), dtype=np.int64)
        for _ in range(int(math.log2(len(self)))):
            at = 2 * at + 1 + (points[np.arange(len(points)), self.dims[at]] > self.cuts[at])
        return at - len(self.dims)
