"""Importance resampling to a target distribution: documents are drawn without replacement by the likelihood ratio of
their words under target and raw data, with Gumbel noise made from the id, so that a draw can be repeated.

1. Words of all documents and of all target texts are counted by hash bucket. The gain of a bucket is the floored log of
   the ratio of its smoothed shares; gains are an array, and a document's weight is the sum of gains at its buckets.
2. Each partition sorts its eligible documents into a run: by score, highest first, then by id, then by row.
3. Runs are dealt to ranges of that order. A task merges the pieces of all runs in its range by a tournament tree: an
   inner node keeps the loser of its match, so the next winner costs one match per level; a winner gives all its rows up
   to the runner-up's key at once. Ranges are counted first: each task knows the ranks before it and stops at the last
   row to be drawn.

Only rows that can be drawn are sorted and dealt: a histogram of scores (BINS numbers) shows how low a drawn score can
be; its lowest bin goes along whole. So the draw shuffles about as many narrow rows as are drawn, and no texts; runs,
ranges and results lie in the shared folder. A task holds one range, about RANGE_ROWS rows of four numbers.

Edge cases: null and empty texts have no words, weight 0, and are not eligible unless least_words is 0; a null id counts
as the empty text in the noise and comes after all ids in ties. Repeated rows are documents each, and equal rows are
drawn in the order in which they were scored. Without target texts gains follow from the smoothing alone; empty tables
give empty ones. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, slices

BUCKETS, LEAST_WORDS, SHARE_PERCENT, SEED = 10_000, 20, 10, 2024
#: Bins of the score histogram, and rows of a range.
BINS, RANGE_ROWS = 4096, 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LAST = (1 << 63) - 1


class Buckets(dict):
    """Bucket of each feature, found once."""

    def __init__(self, buckets: int, most: int = 300_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[feature] = found = crc32(feature) % self.buckets
        return found


def features(raw: bytes, longest: int = 1) -> list[bytes]:
    """Runs of 1 to `longest` consecutive words of a text: letters and digits of ASCII, A-Z lowered, and all else beyond it."""
    words = raw.translate(_LOWER).split()
    return words if longest == 1 else words + [b" ".join(words[i : i + k]) for k in range(2, longest + 1) for i in range(len(words) - k + 1)]


def _found(part: pa.RecordBatch, known: Buckets, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and features of each text of a slice, and the buckets of all features, text after text."""
    raw = pc.fill_null(part.column("__text"), "").cast(pa.binary()).to_pylist()
    each = [features(x, longest) for x in raw]
    count = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
    words = count if longest == 1 else np.array([len(features(x)) for x in raw], dtype=np.int64)
    return words, count, np.fromiter(map(known.__getitem__, chain.from_iterable(each)), dtype=np.int64, count=int(count.sum()))


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """How many features of all texts fall in each bucket: an array of `buckets` numbers, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "__text"):
                total += np.bincount(_found(part, known, longest)[2], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
        release()

    out = np.zeros(buckets, dtype=np.int64)
    sums = texts.select(F.col(f"`{text}`").alias("__text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # `buckets` rows at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(ratio of add-one shares)) of each bucket."""
    s_all, t_all, b = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: int | str | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gain))
        for batch in batches:
            for part in slices(batch, "__text"):
                words, count, found = _found(part, known, longest)
                sums, ends = np.concatenate([[0], np.cumsum(gain[found])]), np.cumsum(count)
                weight = sums[ends] - sums[ends - count]
                luck = np.array([noise(x, seed) for x in part.column("doc_id").to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (words, count, weight, weight + luck))], names=["doc_id", "n_words", "n_features", "weight", "score"])
        release()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text"))
    return narrow.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


class Tournament:
    """A tree of losers over sorted runs of keys; of equal keys that of the lower run comes first."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.leaves = 1 << max(0, (len(runs) - 1).bit_length())
        self.lost = [0] * self.leaves  # the loser at each inner node; at 0 the winner of all
        self.lost[0] = self._play(1)

    def _head(self, run: int) -> tuple:
        """The key of a run's next row; one that is over comes after all others."""
        over = run >= len(self.runs) or self.at[run] >= len(self.runs[run])
        return (True, (), run) if over else (False, self.runs[run][self.at[run]], run)

    def _play(self, node: int) -> int:
        if node >= self.leaves:
            return node - self.leaves
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, self.lost[node] = (a, b) if self._head(a) < self._head(b) else (b, a)
        return won

    def pop(self) -> tuple[int, int, int] | None:
        """(run, first row, end row) of the next rows in order; None when all are out."""
        run = self.lost[0]
        if self._head(run)[0]:
            return None
        rows, low = self.runs[run], self.at[run]
        path = [(run + self.leaves) >> k for k in range(1, self.leaves.bit_length())]
        next_best = min((self._head(self.lost[n]) for n in path), default=(True, (), -1))  # all who lost to the winner stand here
        high = len(rows) if next_best[0] else max(low + 1, bisect_right(rows, next_best[1], low) if run < next_best[2] else bisect_left(rows, next_best[1], low))
        self.at[run], won = high, run
        for n in path:
            if self._head(self.lost[n]) < self._head(won):
                won, self.lost[n] = self.lost[n], won
        self.lost[0] = won
        return run, low, high


def merged(runs: list[list[tuple]], most: int) -> Iterator[tuple[int, int, int]]:
    """The first `most` rows of all runs in order, as (run, first row, end row)."""
    tree = Tournament(runs)
    while most > 0 and (got := tree.pop()):
        run, low, high = got
        yield run, low, min(high, low + most)
        most -= high - low


KEY = ("k1", "k2", "k3")


def _lowest(rows: DataFrame, k: int) -> int:
    """A score that at least k rows reach, and hardly more: by histograms of BINS bins, each over the bin that the one
    before left open. rows is not empty and has k rows at least."""
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    above = 0
    while True:
        width = (high - low) // BINS + 1
        inside = rows.filter(F.col("score").between(low, high))
        found = inside.groupBy(F.floor((F.col("score") - low) / F.lit(width)).cast("long").alias("bin")).count().orderBy(F.desc("bin")).collect()  # BINS rows at most
        for r in found:
            if above + r["count"] >= k:
                break
            above += r["count"]
        low, high = low + r.bin * width, min(high, low + (r.bin + 1) * width - 1)
        if width == 1 or r["count"] <= RANGE_ROWS:
            return low


def ranked(rows: DataFrame, k: int) -> tuple[DataFrame, tuple]:
    """(drawn, last): the k first of rows(doc_id, score, row, ...) by score, id and row with `rank`, and the key of the
    last of them. rows has k rows at least, and its partitions are the runs."""
    keyed = rows.filter(F.col("score") >= _lowest(rows, k)).withColumns({"k1": -F.col("score"), "k2": F.coalesce("doc_id", F.lit(_LAST)), "k3": F.col("row")})
    runs = cut(keyed.sortWithinPartitions(*KEY).withColumns({"run": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}))
    n = runs.count()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartitionByRange(max(-(-n // RANGE_ROWS), min(tasks, -(-n // 5000))), *KEY).sortWithinPartitions("run", "pos")
    dealt = cut(dealt.withColumn("part", F.spark_partition_id()))
    sizes = {r.part: r["count"] for r in dealt.groupBy("part").count().collect()}  # a number per range
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    out = [f for f in dealt.schema if f.name not in (*KEY, "run", "pos", "part")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held or before[held[0].column("part")[0].as_py()] >= k:
            return
        table = pa.Table.from_batches(held)
        first = before[table.column("part")[0].as_py()]
        of = table.column("run").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        keys = list(zip(*(table.column(c).to_pylist() for c in KEY)))
        pieces = [keys[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)])]
        order = np.concatenate([np.arange(starts[r] + a, starts[r] + b) for r, a, b in merged(pieces, k - first)])
        got = table.select([f.name for f in out]).take(pa.array(order)).append_column("rank", pa.array(np.arange(len(order), dtype=np.int64) + first + 1))
        yield from got.combine_chunks().to_batches(max_chunksize=10_000)
        held = table = keys = pieces = got = None
        release()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out), "rank bigint"])
    drawn = cut(dealt.mapInArrow(run, schema))
    r = drawn.filter(F.col("rank") == k).first()
    return drawn, (-r.score, _LAST if r.doc_id is None else r.doc_id, r.row)


def draw(docs: DataFrame, target: DataFrame, percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document of docs(doc_id, text), drawn towards
    target(text): floor(percent of the documents with least_words words or more)."""
    gain = gains(bucket_counts(docs, buckets=buckets, longest=longest), bucket_counts(target, buckets=buckets, longest=longest))
    rows = cut(scored(docs, gain, seed, longest).withColumn("row", F.monotonically_increasing_id()))
    eligible = F.col("n_words") >= least_words
    k = rows.filter(eligible).count() * percent // 100
    names = ("doc_id", "n_features", "weight", "score")
    if not k:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    drawn, last = ranked(rows.filter(eligible), k)
    after = F.struct(-F.col("score"), F.coalesce("doc_id", F.lit(_LAST)), F.col("row")) > F.struct(*(F.lit(x).cast("long") for x in last))
    return drawn.select(*names, "rank").union(rows.filter(~eligible | after).select(*names, F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The documents that draw() takes, with all their columns and `rank`; ids are unique."""
    return docs.join(draw(docs, target, **how).filter("rank is not null").select("doc_id", "rank"), "doc_id")
