"""Token files: raw id payloads in ascending doc_id order, with a minimal perfect hash index for keyed access.

Layout under a path, all written by Spark's own writers (so any store will do, and a lost task is written again):

* shards/kind=ids: rows (shard, chunk, payload). A payload is the ids of consecutive documents, each with its end id, as
  little-endian unsigned integers of 2 bytes (4 if the vocabulary needs it). A shard is one range of the ordered rows.
* shards/kind=keys: rows (doc_id, copy, shard, chunk, at, n, base): where a document's ids lie in its chunk, and how many
  ids of the shard come before. `copy` counts within the shard.
* index: rows (block, pilots, marks, shard, chunk, at, n, base, aside), each a block of about BLOCK_KEYS keys chosen by
  hash. A block holds a minimal perfect hash: the bucket of a key names a pilot, pilot and key name the slot, and the
  slot holds the key's fingerprint (mark) and its place. A key that was never written fails the fingerprint but for one
  in 2^32. Keys of one block whose 64-bit hashes are equal cannot have slots of their own; they stand aside in the
  block's row by their full keys.
* totals: rows (shard, start, low, high): ids in all shards before, and the first and last doc_id.
* format: one row (width, end_id): bytes of an id, and the id that ends a document.

Edge cases: null and empty texts have the end id only. Rows without a doc_id have no key and are not written. Repeated
doc_ids are copies 0, 1, ... in the order of their texts' first 64 characters, each found by its own key; they may span
shards, so no key's rows need one task. Texts of any length stay whole in one chunk. Extra columns are ignored; an empty
table gives empty files.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices

CHUNK_IDS, BLOCK_KEYS = 1 << 18, 4096
#: Fixed value: how a byte-level tokenizer with use_regex cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a Python worker keeps, twice: the latest, and those before them. Bytes of text cut into words at once.
CACHE, SLICE = 600_000, 16 << 20
#: What texts that are not cut hold: white space in a row, or anything but line ends, spaces, Latin letters and usual signs.
_UNCUT = r"  | \n|\n |\n\n|[^\n\x20-\x7e\x{a1}-\x{2ff}\x{2010}-\x{2027}\x{2030}-\x{2044}\x{20ac}]"
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in prints else chr(next(rest)) for b in range(256)}


def id_width(vocabulary: int, end_id: int) -> int:
    """Bytes of an id in the files."""
    return 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, as packed little-endian integers.

    A byte-level tokenizer cuts a text before each single space and around each single line end, whatever else it does.
    So a batch of texts is cut there by Arrow, each distinct word (with its space, if it has one) is cut further by the
    pattern (signs after letters are a cut of their own), and each distinct cut is given to the library's model once.
    Texts that hold a special token, white space in a row or unusual characters, and other kinds of
    tokenizers, go through the library whole.
    """

    def __init__(self, spec: str, end_id: int):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.width = id_width(self.tok.get_vocab_size(), end_id)
        self.kind = f"<u{self.width}"
        parts = json.loads(spec)
        pre = parts.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not parts.get("normalizer") and not parts.get("truncation") and not parts["model"].get("dropout")
        self.uncut = "|".join([_UNCUT, *(re.escape(a["content"]) for a in parts.get("added_tokens", []))])
        self.end = self.pack([end_id])
        self.line = self.pack(self.tok.encode("\n", add_special_tokens=False).ids)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before `known` was begun anew
        self.letters = str.maketrans(byte_letters() | {10: "\n"})
        if self.by_word:
            import regex

            self.split = regex.compile(PATTERN).findall

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _cuts(self, word: str) -> list[str]:
        """What the pattern makes of a word after a space; one that begins with a line end has that in place of it."""
        line, lead = word[:1] == "\n", " "
        if line:
            lead, word = "", word[1:]
        if word.isalpha():
            cuts = [lead + word]
        else:
            stem = word.rstrip(_SIGNS)
            cuts = [lead + stem, word[len(stem) :]] if stem.isalpha() else self.split(lead + word)
        return ["\n", *cuts] if line else cuts

    def _learn(self, cuts: list[str]) -> dict[str, bytes]:
        """The ids of cuts, by the library's model, which reads a letter for each byte."""
        tokens = list(map(self.tok.model.tokenize, "\n".join(cuts).encode().decode("latin-1").translate(self.letters).split("\n")))
        raw = self.pack([t.id for found in tokens for t in found])
        ends = (np.cumsum(list(map(len, tokens))) * self.width).tolist()
        return dict(zip(cuts, (raw[a:b] for a, b in zip([0, *ends], ends))))

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words as they stand between two spaces; a line end can only come first."""
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        out = [known.get(w) for w in words]
        rest = [i for i, x in enumerate(out) if x is None]
        cuts = {}
        for i in rest:
            out[i] = older.get(words[i])
            if out[i] is None:
                cuts[i] = self._cuts(words[i])
        found = {c: known.get(c[1:]) if c[0] == " " else None for own in cuts.values() for c in own} | {"\n": self.line}
        if new := [c for c, x in found.items() if x is None]:
            found |= self._learn(new)
            known.update((c[1:], found[c]) for c in new if c[0] == " ")
        for i, own in cuts.items():
            out[i] = b"".join([found[c] for c in own])
        known.update((words[i], out[i]) for i in rest)
        return out

    def _cut(self, texts: pa.Array) -> list[bytes]:
        marked = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        parts = pc.split_pattern(marked, " ")
        coded = parts.values.dictionary_encode()
        packed = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(packed), self.kind)
        of = coded.indices.to_numpy()
        n = size[of]
        until = np.cumsum(n)
        raw = flat[np.repeat(start[of] - until + n, n) + np.arange(int(until[-1]) if len(until) else 0)].tobytes()
        edges = np.concatenate([[0], until])[parts.offsets.to_numpy()] * self.width
        skip = len(self.line)  # the line end that was put before each text
        return [raw[a + skip : b] + self.end for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        whole = pc.match_substring_regex(texts, self.uncut).to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(texts), bool)
        out = np.empty(len(texts), dtype=object)
        plain, rest = np.flatnonzero(~whole), np.flatnonzero(whole)
        if len(plain):
            out[plain] = np.array([*self._cut(texts.take(pa.array(plain))), None], dtype=object)[:-1]
        for i, t in zip(rest.tolist(), texts.take(pa.array(rest)).to_pylist()):
            out[i] = self.pack(self.tok.encode(t, add_special_tokens=False).ids) + self.end
        return out.tolist()


#: The encoder of a Python worker, which goes on from task to task with the words it knows.
_HELD: dict[tuple, Encoder] = {}


def _encoder(spec: str, end_id: int) -> Encoder:
    key = (zlib.crc32(spec.encode()), len(spec), end_id)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Encoder(spec, end_id)
    return _HELD[key]


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mixer over unsigned integers."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit hashes: n keys to the slots 0..n-1, with a pilot per bucket."""

    SALTS = 1 << 16

    def __init__(self, n: int, pilots: np.ndarray):
        self.n, self.pilots = n, pilots

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        buckets = max(1, n // 3)
        of = (mix(keys, 1) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=buckets)
        ends = np.cumsum(counts)
        taken, pilots = np.zeros(n, dtype=bool), np.zeros(buckets, dtype=np.uint32)
        base = mix(keys, 2)
        for b in np.argsort(-counts, kind="stable"):
            if not counts[b]:
                break
            own = base[order[ends[b] - counts[b] : ends[b]]]
            for first in range(0, cls.SALTS * 64, 256):
                slots = cls._slot(own[None, :], np.arange(first, first + 256, dtype=np.uint64)[:, None], n)
                good = ~taken[slots].any(1)
                if counts[b] > 1:
                    ranked = np.sort(slots, axis=1)
                    good &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
                hit = int(good.argmax())
                if good[hit]:
                    pilots[b] = first + hit
                    taken[slots[hit]] = True
                    break
            else:
                raise ValueError("keys are not distinct")
        return cls(n, pilots)

    @staticmethod
    def _slot(base: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(base + pilot * np.uint64(0x9E3779B97F4A7C15), 3) % np.uint64(n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(keys), dtype=np.int64)
        pilot = self.pilots[(mix(keys, 1) % np.uint64(len(self.pilots))).astype(np.int64)]
        return self._slot(mix(keys, 2), pilot.astype(np.uint64), self.n)


def marks(keys: np.ndarray) -> np.ndarray:
    """Fingerprints of keys."""
    return (mix(keys, 4) >> np.uint64(32)).astype("<u4")


def _key() -> F.Column:
    return F.xxhash64("doc_id", "copy")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, text: str = "text", chunk_ids: int = CHUNK_IDS) -> None:
    """Encodes docs(doc_id, text) with the tokenizers file at `tokenizer` (a path of the driver) and writes path."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    width = id_width(Tokenizer.from_str(source).get_vocab_size(), end_id)
    spec = spark.sparkContext.broadcast(source)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = _encoder(spec.value, end_id)
        held: list[tuple[int, int, bytes]] = []
        size = chunk = base = 0
        last, copy = None, 0

        def flush() -> pa.RecordBatch:
            n = np.array([len(p) // width for *_, p in held], dtype=np.int64)
            at = np.cumsum(n) - n
            k = len(held)
            ints = [pa.array([*x, None], pa.int64()) for x in ([d for d, *_ in held], [c for _, c, _ in held], at.tolist(), n.tolist(), (base + at).tolist())]
            return pa.RecordBatch.from_arrays(
                [pa.array(["keys"] * k + ["ids"]), pa.array([shard] * (k + 1), pa.int32()), pa.array([chunk] * (k + 1), pa.int32()), *ints, pa.array([None] * k + [b"".join(p for *_, p in held)], pa.binary())],
                names=["kind", "shard", "chunk", "doc_id", "copy", "at", "n", "base", "payload"],
            )

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for doc, payload in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text"))):
                    if size >= chunk_ids:
                        yield flush()
                        held.clear()
                        chunk, base, size = chunk + 1, base + size, 0
                    copy = copy + 1 if doc == last else 0
                    last = doc
                    held.append((doc, copy, payload))
                    size += len(payload) // width
        if held:
            yield flush()

    spark.createDataFrame([(width, end_id)], "width int, end_id bigint").coalesce(1).write.parquet(f"{path}/format")
    # Equal keys may be many: what follows the doc_id lets their rows be dealt to several shards.
    ties = [F.substring(F.coalesce("text", F.lit("")), 1, 64), F.monotonically_increasing_id()]
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).withColumns({f"__t{i}": t for i, t in enumerate(ties)})
    ordered = rows.repartitionByRange("doc_id", "__t0", "__t1").sortWithinPartitions("doc_id", "__t0", "__t1").select("doc_id", "text")
    ordered.mapInArrow(run, "kind string, shard int, chunk int, doc_id bigint, copy bigint, at bigint, n bigint, base bigint, payload binary").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/shards")
    spec.destroy()
    index(spark, path)


SHARDS = "shard int, chunk int, doc_id bigint, copy bigint, at bigint, n bigint, base bigint, payload binary, kind string"
_PLACE = ("shard", "chunk", "at", "n", "base")


def shards(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(f"{path}/shards").filter(F.col("kind") == kind)


def _global_copies(keys: DataFrame, ends: DataFrame) -> DataFrame:
    """keys with `copy` counted over all shards: only a doc_id that ends one shard and begins another needs an offset."""
    begins, finishes = ends.select(F.col("low").alias("doc_id"), F.col("shard").alias("b")), ends.select(F.col("high").alias("doc_id"), F.col("shard").alias("e"))
    seams = begins.join(finishes, "doc_id").filter("b <> e").select("doc_id").distinct()  # a row per shard at most
    counts = keys.join(F.broadcast(seams), "doc_id").groupBy("doc_id", "shard").count()
    before = Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("doc_id", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    return keys.join(F.broadcast(offsets), ["doc_id", "shard"], "left").withColumn("copy", F.col("copy") + F.coalesce("__before", F.lit(0))).drop("__before")


def build_block(f: pd.DataFrame) -> dict:
    """The index row of a block's keys (doc_id, copy, h and places); keys of one hash stand aside."""
    clash = f["h"].duplicated(keep=False)
    aside, f = f[clash], f[~clash]
    h = f["h"].to_numpy().view(np.uint64)
    table = PerfectHash.build(h)
    order = np.argsort(table.slots(h))
    row = {"pilots": table.pilots.astype("<u4").tobytes(), "marks": marks(h[order]).tobytes()}
    return row | {c: f[c].to_numpy()[order].astype("<i8").tobytes() for c in _PLACE} | {"aside": aside[["doc_id", "copy", *_PLACE]].to_numpy(dtype="<i8").tobytes()}


def look_up(ks: pd.DataFrame, row) -> pd.DataFrame:
    """The keys (doc_id, copy, h) that a block's row holds, with their places."""
    h, mark = ks["h"].to_numpy().view(np.uint64), np.frombuffer(row["marks"], "<u4")
    out = ks[["doc_id", "copy"]].reset_index(drop=True)
    if len(mark):
        slot = PerfectHash(len(mark), np.frombuffer(row["pilots"], "<u4")).slots(h)
        found = out.assign(**{c: np.frombuffer(row[c], "<i8")[slot] for c in _PLACE})[mark[slot] == marks(h)]
    else:
        found = out.assign(**{c: np.zeros(len(out), np.int64) for c in _PLACE})[:0]
    aside = pd.DataFrame(np.frombuffer(row["aside"], "<i8").reshape(-1, 2 + len(_PLACE)), columns=["doc_id", "copy", *_PLACE])
    if not len(aside):
        return found
    other = out.merge(aside, on=["doc_id", "copy"])
    named = pd.MultiIndex.from_frame(other[["doc_id", "copy"]])
    return pd.concat([found[~pd.MultiIndex.from_frame(found[["doc_id", "copy"]]).isin(named)], other])


def index(spark: SparkSession, path: str, block_keys: int = BLOCK_KEYS) -> None:
    """Builds the index and the totals of the shards under path."""
    keys = shards(spark, path, "keys").select("doc_id", "copy", *_PLACE)
    sums = keys.groupBy("shard").agg(F.sum("n").alias("ids"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("keys"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    sums.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"), "low", "high", "keys").write.parquet(f"{path}/totals")
    totals = spark.read.parquet(f"{path}/totals")
    blocks = max(1, -(-(totals.agg(F.sum("keys")).first()[0] or 0) // block_keys))

    def build(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"block": f["block"].iloc[0], "blocks": blocks} | build_block(f)])

    hashed = _global_copies(keys, totals).select(F.pmod(_key(), F.lit(blocks)).alias("block"), _key().alias("h"), "doc_id", "copy", *_PLACE)
    hashed.groupBy("block").applyInPandas(build, "block bigint, blocks bigint, pilots binary, marks binary, " + ", ".join(f"{c} binary" for c in _PLACE) + ", aside binary").write.parquet(f"{path}/index")


def locate(keys: DataFrame, path: str) -> DataFrame:
    """keys(doc_id, copy) that the files hold, each with shard, chunk, at, n and base, by way of the index."""
    spark = keys.sparkSession
    table = spark.read.parquet(f"{path}/index")
    first = table.select("blocks").first()
    blocks = first.blocks if first else 1

    def run(ks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        _HELD.clear()  # a worker that has written needs its words no more
        if not len(rows) or not len(ks):
            return pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("doc_id", "copy", *_PLACE)})
        return look_up(ks, rows.iloc[0])

    asked = keys.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("copy").cast("long").alias("copy"))
    asked = asked.select("doc_id", "copy", _key().alias("h"), F.pmod(_key(), F.lit(blocks)).alias("block"))
    return asked.groupBy("block").cogroup(table.groupBy("block")).applyInPandas(run, "doc_id bigint, copy bigint, " + ", ".join(f"{c} bigint" for c in _PLACE))


def read(keys: DataFrame, path: str, whole: bool = False) -> DataFrame:
    """doc_id, copy, start, n_tokens and ids_crc32 (with whole also the ids) of the given keys, from the files.

    ids_crc32 is of the ids as little-endian unsigned integers of 32 bits, the end id included.
    """
    spark = keys.sparkSession
    kind = f"<u{spark.read.parquet(f'{path}/format').first().width}"
    chunks = shards(spark, path, "ids").select(F.col("shard").cast("bigint").alias("shard"), F.col("chunk").cast("bigint").alias("chunk"), "payload")
    extra = ", ids array<int>" if whole else ""

    def run(places: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(rows["payload"].iloc[0], kind) if len(rows) else np.zeros(0, kind)
        parts = [ids[a : a + n].astype("<u4") for a, n in zip(places["at"], places["n"])]
        out = places[["doc_id", "copy", "shard", "base", "n"]].assign(ids_crc32=np.array([zlib.crc32(p.tobytes()) for p in parts], dtype=np.int64))
        return out.assign(ids=pd.Series([p.tolist() for p in parts], index=out.index, dtype=object)) if whole else out

    found = locate(keys, path).groupBy("shard", "chunk").cogroup(chunks.groupBy("shard", "chunk")).applyInPandas(run, "doc_id bigint, copy bigint, shard bigint, base bigint, n bigint, ids_crc32 bigint" + extra)
    starts = spark.read.parquet(f"{path}/totals").select("shard", "start")
    cols = [F.col("doc_id"), F.col("copy"), (F.col("start") + F.col("base")).alias("start"), F.col("n").alias("n_tokens"), F.col("ids_crc32"), *([F.col("ids")] if whole else [])]
    return found.join(starts, "shard").select(*cols)


def keys_of(docs: DataFrame) -> DataFrame:
    """(doc_id, copy): the keys under which documents are written."""
    counted = docs.filter("doc_id is not null").groupBy("doc_id").count()
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("copy"))
