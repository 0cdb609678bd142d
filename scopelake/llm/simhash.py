"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming distance.

Candidates come from pigeonring filtering: the 64 bits are cut into BOXES consecutive segments on a ring. If two
fingerprints differ in at most `distance` bits, then some segment starts a chain in which the differences summed over
its first 1, 2, ... segments stay within 1, 2, ... times distance / BOXES. With distance < BOXES the first segment of
that chain is equal, so fingerprints are bucketed by (segment number, segment value), and the rest of the chain prunes
the pairs of a bucket before the full Hamming check. A bucket's pairs are never emitted: its task returns a spanning
forest of its links, at most one row per member.

A bucket over BUCKET distinct fingerprints is split by what follows on the ring: the bits outside its segment are cut in
three again, one of which must be equal too, so its members are bucketed by 35 bits or more. Only buckets that are still
over BUCKET (very many fingerprints within a few bits) are linked through shared neighbours: two fingerprints differ in at
most two bits exactly if some word is within one bit of both. Each member makes 65 rows and a word gathers at most 65
members, so no group is hot and no link is lost.

Edge cases: null or blank text has fingerprint zero, linked like any other. A null doc_id is returned and takes part,
but is never a component_id (which is null if no member has an id). Repeated rows are returned as often as they come.
Other columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_text
from .components import components

#: Segments of the ring, as (shift, bits).
BOXES = ((0, 21), (21, 21), (42, 22))
#: Distinct fingerprints that a bucket may hold to be compared pair by pair.
BUCKET = 2048
SEED = 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)))], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _printer(shingle: int):
    return lambda texts: [pa.array(np.array([fingerprint(x, shingle) for x in texts], dtype=np.uint64).view(np.int64))]


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long."""

    return map_text(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "text", [("fp", "bigint")], lambda: _printer(shingle))


def chain(diff: np.ndarray, first: int, distance: int) -> np.ndarray:
    """Whether the differences summed along the ring from segment `first` stay within their budgets."""
    ok, total = np.ones(diff.shape, dtype=bool), np.zeros(diff.shape, dtype=np.uint8)
    for step in range(len(BOXES)):
        shift, bits = BOXES[(first + step) % len(BOXES)]
        total = total + np.bitwise_count((diff >> np.uint64(shift)) & np.uint64((1 << bits) - 1))
        ok &= total <= (step + 1) * distance // len(BOXES)
    return ok


def forest(members: np.ndarray, first: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over the members of a bucket that lie within the distance."""
    u, v = [], []
    order = np.sort(members)
    label = np.arange(len(order))
    for i in range(0, len(order), 256):
        diff = order[i : i + 256, None] ^ order[None, :]
        a, b = np.nonzero(chain(diff, first, distance))
        a = a + i
        a, b = a[a < b], b[a < b]
        near = np.bitwise_count(order[a] ^ order[b]) <= distance
        for x, y in zip(a[near].tolist(), b[near].tolist()):
            while label[x] != x:
                label[x] = x = label[label[x]]
            while label[y] != y:
                label[y] = y = label[label[y]]
            if x != y:
                label[max(x, y)] = min(x, y)
                u.append(order[max(x, y)])
                v.append(order[min(x, y)])
    return np.array(u, dtype=np.uint64), np.array(v, dtype=np.uint64)


def _box(i: int) -> F.Column:
    shift, bits = BOXES[i]
    return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))


def _within(full: DataFrame, distance: int) -> DataFrame:
    """(u, v): the links of buckets(box, fps)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for box, fps_ in zip(batch.column("box").to_pylist(), batch.column("fps")):
                u, v = forest(fps_.values.to_numpy().view(np.uint64), box, distance)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(x) if x else np.zeros(0, np.uint64)).view(np.int64)) for x in (us, vs)], names=["u", "v"])

    return full.select("box", "fps").mapInArrow(run, "u bigint, v bigint")


def _rest() -> F.Column:
    """The three parts of the ring after a fingerprint's segment `box`, as an array of (sub, subpart)."""
    turned = F.col("fp")
    for i, (shift, bits) in enumerate(BOXES):
        at = (shift + bits) % 64
        if at:
            turned = F.when(F.col("box") == i, F.shiftrightunsigned("fp", at).bitwiseOR(F.shiftleft("fp", 64 - at))).otherwise(turned)
    left = 64 - max(bits for _, bits in BOXES)
    cuts = [(left * k // 3, left * (k + 1) // 3) for k in range(3)]
    cuts[2] = (cuts[2][0], 64 - min(bits for _, bits in BOXES))  # bits of the segment itself are equal anyway
    return F.array(*(F.struct(F.lit(k).alias("sub"), F.shiftrightunsigned(turned, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("subpart")) for k, (a, b) in enumerate(cuts)))


def links(fps: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(u, v): enough links between the distinct fingerprints in column fp to connect all that lie within the distance."""
    if not 0 <= distance < len(BOXES):
        raise ValueError(f"the distance must be under {len(BOXES)}")
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("box"), _box(i).alias("part")) for i in range(len(BOXES))))).alias("k")).select("k.box", "k.part", "fp")
    sizes = keyed.groupBy("box", "part").count().filter("count > 1")
    shared = cut(keyed.join(sizes, ["box", "part"]))
    near = _within(shared.filter(F.col("count") <= bucket).groupBy("box", "part").agg(F.collect_list("fp").alias("fps")), distance)
    if not shared.filter(F.col("count") > bucket).head(1):
        return near
    deep = ["box", "part", "sub", "subpart"]
    finer = shared.filter(F.col("count") > bucket).select("box", "part", "fp", F.explode(_rest()).alias("s")).select("box", "part", "s.sub", "s.subpart", "fp")
    finer = cut(finer.join(finer.groupBy(*deep).count().filter("count > 1"), deep))
    near = near.union(_within(finer.filter(F.col("count") <= bucket).groupBy(*deep).agg(F.collect_list("fp").alias("fps")), distance))
    hot = finer.filter(F.col("count") > bucket).select("fp").distinct()
    flips = [F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long") for i in range(64)]
    if distance == 2:
        met = hot.select("fp", F.explode(F.array(F.lit(0).cast("long"), *flips)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
        stars = met.groupBy("word").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
        return near.union(stars.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).filter("u <> v").distinct())
    if distance == 1:
        met = hot.select("fp", F.explode(F.array(*flips)).alias("flip")).withColumn("low", F.least("fp", F.col("fp").bitwiseXOR(F.col("flip"))))
        return near.union(met.groupBy("low", "flip").agg(F.max("fp").alias("u"), F.min("fp").alias("v")).select("u", "v").filter("u <> v"))
    return near


def _components(fps: DataFrame, distance: int, bucket: int) -> DataFrame:
    """(fp, component): a number for the group of each distinct fingerprint of a column fp."""
    found = components(links(fps, distance, bucket))
    return fps.join(found, fps.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, distance: int = 2, shingle: int = 3, text: str = "text", id_col: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the smallest doc_id that links reach."""
    fps = cut(fingerprints(docs, shingle, text, id_col))
    roots = fps.groupBy("fp").agg(F.min("doc_id").alias("root"))
    joined = roots.join(_components(roots.select("fp"), distance, bucket), "fp")
    low = joined.groupBy("component").agg(F.min("root").alias("component_id"))
    named = joined.join(low, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def kept(docs: DataFrame, distance: int = 2, shingle: int = 3, text: str = "text", id_col: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """docs with one row of each group: of the smallest id (a row without an id stays only where its group has none), of
    rows of that id the one whose text has the smallest hash, and any one of rows that are equal in both. Ids may be of any
    type that sorts.

    The hash, not the text, is what is compared: rows are told apart by id and hash.
    """
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), hashed.alias("h"))
    fps = cut(map_text(rows, "text", [("fp", "bigint")], lambda: _printer(shingle), ["doc_id", "h"]))
    # The first row of each fingerprint, then of each component; ids come before none.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h"))
    firsts = cut(fps.groupBy("fp").agg(F.min(order).alias("first")))
    group = firsts.join(_components(firsts.select("fp"), distance, bucket), "fp").groupBy("component").agg(F.min("first").alias("first"))
    keys = ["__none", "__id", "__h"]
    stay = group.select(F.col("first.none").alias("__none"), F.coalesce(F.col("first.id").cast("string"), F.lit("")).alias("__id"), F.col("first.h").alias("__h"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    found = docs.select(F.col(id_col).isNull().alias("__none"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"), hashed.alias("__h"), whole.alias("__row")).join(stay, keys)
    # Rows that are equal in id and text: the join has brought them together.
    return found.groupBy(*keys).agg(F.first("__row").alias("__row")).select("__row.*")
