"""Periodic runs of words, found by Karp-Miller-Rosenberg naming, and texts with the repetitions taken out.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of at least max(LEAST, 2 q)
words, that no neighbouring word extends keeping the period.

1. Words of a batch of texts get numbers per text, one text after the other. Level k names every stretch of 2^k words:
   equal stretches of one text, and only these, have one name, made from the two names of its halves. Only positions
   whose stretch occurs again in the text are named further, so levels end when nothing occurs twice.
2. A run of period q holds a grid pair (i, i + q), i a multiple of q, both in the run. Each grid pair of equal words is
   extended to both sides: how far two positions agree follows from the names, by descending levels.
3. Of the periods of one stretch the smallest stays (by Fine and Wilf the others are its multiples).

n log n grid pairs for n words, in NumPy and in blocks of bounded size; no hashes of stretches and no suffix sorting.
Each text is handled in one task, in one pass and without a shuffle; what a task holds grows with its longest text only.

Edge cases: null and empty texts have no runs and an empty collapsed text; rows are independent, so repeated ids, null
ids and empty tables need no rule. Columns are kept by name, whatever else the table has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import release, slices

#: The fewest words of a run.
LEAST = 12
#: Grid pairs looked at in one go.
BLOCK = 1 << 21
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def name_levels(symbols: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... symbols at each position: equal names stand for equal stretches. A stretch
    that does not occur twice, or would pass the end, has a name of its own below 0."""
    n = len(symbols)
    own = -1 - np.arange(n, dtype=np.int64)

    def named(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = own.copy()
        _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
        again = count[number] > 1
        names[at[again]] = number[again]
        return names, at[again]

    names, live = named(np.arange(n), symbols)
    levels, wide = [names], 1
    while len(live):
        left = live[live + wide < n]
        both = (names[left] >= 0) & (names[left + wide] >= 0)
        left = left[both]
        if not len(left):
            break
        names, live = named(left, names[left] * n + names[left + wide])
        wide *= 2
        if len(live):
            levels.append(names)
    return levels


def agree(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols from i and from j on are equal; back: how many up to and with i and j, going down."""
    n, far = len(levels[0]), np.zeros(len(i), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        wide, names = 1 << k, levels[k]
        todo = np.arange(len(i))
        while len(todo):  # the top level may hold several times, any other once
            a, b = (x[todo] + (-far[todo] - wide + 1 if back else far[todo]) for x in (i, j))
            inside = (a >= 0) & (b >= 0) & (a < n) & (b < n)
            todo, a, b = todo[inside], a[inside], b[inside]
            todo = todo[names[a] == names[b]]
            far[todo] += wide
            if k < len(levels) - 1:
                break
    return far


def grid(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, q) of all grid pairs of texts that lie at `starts`, in blocks: i a multiple of q from the text's start."""
    most = sizes // 2
    text = np.repeat(np.arange(len(sizes)), most)
    if not len(text):
        return
    q = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    pairs = (sizes[text] - 1) // q  # i = 0, q, ... while i + q is inside
    ends = np.cumsum(pairs)
    low = 0
    while low < len(q):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + BLOCK, side="right")))
        count = pairs[low:high]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        period = np.repeat(q[low:high], count)
        yield np.repeat(starts[text[low:high]], count) + step * period, period
        low = high


def find_runs(symbols: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period) of the runs of texts whose numbered words lie one after the other; sorted by
    text, start and period. Starts count from the text's first word."""
    starts = np.cumsum(sizes) - sizes
    texts = np.repeat(np.arange(len(sizes)), sizes)
    top = int(symbols.max(initial=0)) + 1
    levels = name_levels(texts * top + symbols)  # names of different texts differ
    word, found = levels[0], []
    for i, q in grid(sizes, starts):
        same = word[i] == word[i + q]
        i, q = i[same], q[same]
        forth, back = agree(levels, i, i + q), agree(levels, i - 1, i + q - 1, back=True)
        held = forth + back + q >= np.maximum(least, 2 * q)
        found.append(np.stack([i - back, q + back + forth, q], 1)[held])
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)
    if not len(rows):
        return np.zeros((0, 4), dtype=np.int64)
    first = np.ones(len(rows), dtype=bool)  # sorted by start, length and period: the first of a stretch is its smallest period
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[first]
    text = texts[rows[:, 0]]
    rows = np.column_stack([text, rows[:, 0] - starts[text], rows[:, 1:]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def echo(n: int, seed: int) -> np.ndarray:
    """Positions of a text of n words whose tail repeats itself: from seed % n on, with a period that the seed gives."""
    a = seed % n
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % (1 + (n - a) // (3 + seed % 8)))


def collapse(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: int = LEAST, seed: str | None = None) -> DataFrame:
    """Columns `keep` (doc_id) with `runs` of each whole text, by start and period, and `collapsed`: its words joined by
    one space, without those that repeat a run's first period.

    seed: a column of numbers; a text that has one is first changed by echo().
    """
    keep = ["doc_id"] if keep is None else keep
    narrow = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"), (F.col(f"`{seed}`") if seed else F.lit(None)).cast("long").alias("__seed"))
    kept = narrow.select(*(F.col(f"`{c}`") for c in keep)).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"runs {RUNS}", "collapsed string"])
    item = to_arrow_type(docs.sparkSession.createDataFrame([], f"runs {RUNS}").schema["runs"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                raw = pc.fill_null(part.column("__text"), "").cast(pa.binary()).to_pylist()
                words = [x.split() for x in raw]  # bytes split at 0x20 and 0x09 to 0x0D
                for d, x in enumerate(part.column("__seed").to_pylist()):
                    if x is not None and words[d]:
                        words[d] = [words[d][i] for i in echo(len(words[d]), x).tolist()]
                sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                number: dict[bytes, int] = {}
                symbols = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), dtype=np.int64, count=int(sizes.sum()))
                rows = find_runs(symbols, sizes, least)
                cuts = np.searchsorted(rows[:, 0], np.arange(len(words) + 1))
                texts = []
                for d, ws in enumerate(words):
                    own = rows[cuts[d] : cuts[d + 1], 1:]
                    texts.append(b" ".join(ws if not len(own) else [ws[i] for i in np.flatnonzero(~repeated(own, len(ws))).tolist()]))
                fields = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in (1, 2, 3)], fields=[item.value_type.field(c) for c in range(3)])
                runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), fields, type=item)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), runs, pa.array(texts, pa.binary()).cast(pa.string())], names=[*keep, "runs", "collapsed"])
        release()

    return narrow.mapInArrow(run, schema)


def longest(runs: F.Column) -> F.Column:
    """The longest of `runs`; of equal ones the first by start, then by period; null if there is none."""
    better = lambda a, b: F.when(a.isNull() | (b["length"] > a["length"]), b).otherwise(a)
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
