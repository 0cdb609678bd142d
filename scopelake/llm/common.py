"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..sources.shared import cut, shared_dir, work_path  # noqa: F401

#: Text handled at once inside a task, in bytes of UTF-8 (Arrow batches may be larger).
SLICE_BYTES = 2 << 20


def release() -> None:
    """Gives memory that Arrow and the C library hold unused back to the system: a Python worker lives on after its task,
    beside other workers, and what one stage left unused must not narrow the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of an Arrow batch that hold about `most` bytes of text (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(size):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_text(docs: DataFrame, text: str, out: list[tuple[str, str]], fn: Callable[[], Callable[[list[str]], list[list]]], keep: list[str] | None = None, arrow: bool = False) -> DataFrame:
    """Columns `keep` of docs plus those that fn's function derives from whole texts (null counts as empty).

    fn is called once per task and returns a function from a list of texts (arrow: an Arrow array of them, about four
    as much) to one list per derived column.
    """
    keep = ["doc_id"] if keep is None else keep
    narrow = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in [*((f.name, f.dataType.simpleString()) for f in narrow.select(*keep).schema), *out])
    names = [c for c, _ in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        derived = batch = part = texts = cols = None
        for batch in batches:
            derived = derived or fn()
            for part in slices(batch, "__text", SLICE_BYTES * 4 if arrow else SLICE_BYTES):
                texts = pc.fill_null(part.column("__text"), "")
                cols = derived(texts if arrow else texts.to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(v if isinstance(v, pa.Array) else pa.array(v, arrow_types[c]) for c, v in zip(names, cols))], names=[*keep, *names])
        derived = batch = part = texts = cols = None
        release()

    arrow_types = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in out))}
    return narrow.mapInArrow(run, schema)
