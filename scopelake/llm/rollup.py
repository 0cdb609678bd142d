"""Token counts as delta-maintained rollups by source, language and tokenizer version.

Counts are additive, so a change of the corpus is a set of signed rows: +1 document and its tokens for an insert, -1 and
minus its tokens for a delete, the difference for a revised count. A batch of such rows is pre-aggregated to one row
per group and committed under its batch id into a folder of its own, replaced as a whole. Totals are the sums over the
committed batches.

Commits are idempotent: rows of a batch id that is already committed are left out, so a batch that is sent again, by
a retry or by mistake, changes nothing, whatever it holds. A commit that dies before its end leaves no committed
folder and can be sent again. compact() folds old batches into one while keeping their ids known. One writer at a
time is assumed, as for any plain folder of files.

Edge cases: null keys form groups of their own. Null counts add 0. A
group whose counts have all returned to 0 is dropped from totals. Repeated rows in a batch count each. Empty batches
are committed (their id is known afterwards). Null and empty texts have 0 tokens but are documents.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text

KEYS = ("source", "lang", "tokenizer_version")
SUMS = ("n_docs", "n_tokens", "n_chars")
_STATE = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint, n_chars bigint, is_batch boolean, batch_id string"


def _rank_counter(path: str, pattern: str):
    """A function from texts to token counts, for a file of byte-pair ranks."""
    with open(path, "rb") as f:
        raw = f.read()

    def start():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    return start


_HELD: dict[str, object] = {}


def token_counts(docs: DataFrame, tokenizers: dict[str, str], pattern: str) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens and n_chars of every whole text, for each tokenizer.

    tokenizers: path of a file of byte-pair ranks, by version; pattern cuts texts into words.
    """
    versions = list(tokenizers)
    starts = {v: _rank_counter(p, pattern) for v, p in tokenizers.items()}

    def start():
        for v in versions:
            if v not in _HELD:
                _HELD[v] = starts[v]()
        encoders = [_HELD[v] for v in versions]
        return lambda texts: [pa.array([[len(e(t)) for e in encoders] for t in texts], pa.list_(pa.int64())), pa.array([len(t) for t in texts], pa.int64())]

    counted = map_text(docs, "text", [("counts", "array<bigint>"), ("n_chars_", "bigint")], start, ["doc_id", "source", "lang"])
    pairs = F.arrays_zip(F.array(*(F.lit(v) for v in versions)).alias("version"), F.col("counts").alias("count"))
    return counted.select("doc_id", "source", "lang", F.explode(pairs).alias("p"), "n_chars_").select("doc_id", "source", "lang", F.col("p.version").alias("tokenizer_version"), F.col("p.count").alias("n_tokens"), F.col("n_chars_").alias("n_chars"))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def deletes(counts: DataFrame) -> DataFrame:
    return inserts(counts).select(*KEYS, *((-F.col(c)).alias(c) for c in SUMS))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The signed rows that turn the contribution of `old` counts into that of `new` ones (of the same documents).

    A document may also have changed its group: it leaves the old one and enters the new one.
    """
    return deletes(old).union(inserts(new))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The signed rows between two whole states of counts, whose key is (doc_id, tokenizer_version): documents only in old
    are deleted, only in new inserted, others revised where a count or a group differs."""
    key = ["doc_id", "tokenizer_version"]
    cols = ("source", "lang", "n_tokens", "n_chars")
    both = old.select(*key, F.struct(*cols).alias("o")).join(new.select(*key, F.struct(*cols).alias("n")), key, "full").filter(~F.col("o").eqNullSafe(F.col("n")))
    went = both.filter("o is not null").select("o.source", "o.lang", "tokenizer_version", "o.n_tokens", "o.n_chars")
    came = both.filter("n is not null").select("n.source", "n.lang", "tokenizer_version", "n.n_tokens", "n.n_chars")
    return deletes(went).union(inserts(came))


class Rollup:
    """The rollup kept under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        # The folder exists from the start, so that it can be read before the first commit.
        spark.createDataFrame([], _STATE).write.mode("append").parquet(f"{self.path}/empty")

    def _state(self) -> DataFrame:
        return self.spark.read.schema(_STATE).option("recursiveFileLookup", "true").parquet(self.path)

    def committed(self) -> DataFrame:
        """batch_id of all committed batches."""
        return self._state().filter("is_batch").select("batch_id").distinct()

    def has(self, batch_id: str) -> bool:
        return bool(self._state().filter("is_batch").filter(F.col("batch_id") == batch_id).head(1))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds a batch of signed rows; False, and nothing changes, if its id is committed already."""
        if self.has(batch_id):
            return False
        sums = deltas.groupBy(*KEYS).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS))
        mark = self.spark.range(1).select(*(F.lit(None).cast("string").alias(c) for c in KEYS), *(F.lit(0).cast("long").alias(c) for c in SUMS), F.lit(True).alias("is_batch"))
        rows = sums.withColumn("is_batch", F.lit(False)).union(mark).withColumn("batch_id", F.lit(batch_id))
        # One folder per batch, replaced as a whole: what a failed commit may have left is overwritten.
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={base64.urlsafe_b64encode(batch_id.encode()).decode().rstrip('=')}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens and n_chars over all committed batches."""
        sums = self._state().filter("not is_batch").groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        return sums.filter(" or ".join(f"{c} <> 0" for c in SUMS))

    def compact(self, path: str) -> Rollup:
        """A rollup at a new path with the same totals and the same known batch ids, in a single folder."""
        new = Rollup(self.spark, path)
        marks = self._state().filter("is_batch").select(*_STATE_NAMES).distinct()
        sums = self.totals().select("*", F.lit(False).alias("is_batch"), F.lit("").alias("batch_id"))
        sums.select(*_STATE_NAMES).union(marks).coalesce(1).write.mode("overwrite").parquet(f"{new.path}/batch=compacted")
        return new


_STATE_NAMES = (*KEYS, *SUMS, "is_batch", "batch_id")
