"""SentencePiece encoding and decoding of whole texts, by suffix-array matching.

The distinct segments of a batch (a run of spaces with what follows up to the next space or line end; no piece
reaches further) are
concatenated and indexed by a suffix array over their first MAX_PIECE characters. Every piece of the vocabulary is
looked up by binary search, which gives its range of occurrences; the occurrences are edges of a graph over text
positions. Sorted by position, the edges are relaxed from left to right, all segments at once: for a unigram model by
the best sum of scores; for a BPE model an edge is taken if its piece can follow the last piece before it, that is, if
merging would leave the two side by side (exactly one edge into a position can, and it ends the encoding of that
prefix). Characters without a piece fall back to byte pieces, or to the unknown id.

Segments seen before by a task are not matched again (the latest CACHE to 2 * CACHE of them are kept). The model file's tables are made once on
the driver and sent with the job; their size depends on the vocabulary alone. No shuffle takes place.

Edge cases: null and empty texts have no ids and decode to "". Texts of any length are matched whole (very long
segments by themselves). Rows without an id and repeated rows are encoded like any other; extra columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

CACHE = 500_000
#: Characters matched at once.
CHUNK = 150_000
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Tables:
    """What matching, relaxing and decoding need of a model, as arrays."""

    name: str
    bpe: bool
    size: int
    unk: int
    prefix: bool
    chars: np.ndarray  # code points that pieces use, sorted
    codes: np.ndarray  # piece by position: 1 + index into chars, 0 beyond its end
    length: np.ndarray  # of the pieces in codes
    ids: np.ndarray  # of the pieces in codes
    score: np.ndarray  # by id
    order: np.ndarray  # by id: when a merge forms the piece; -1 for single characters
    left: np.ndarray  # by id: the pieces of its last merge
    right: np.ndarray
    pairs: np.ndarray  # sorted left * size + right of all pieces that join to a piece
    joins: np.ndarray  # order of the piece that such a pair joins to
    byte_ids: np.ndarray  # id of each byte value, -1 if there is none
    surface: list[bytes]  # by id: what it decodes to


def _bpe(piece: str, order: dict[str, int]) -> tuple[str, str] | None:
    """The two parts that the last merge of a piece's own encoding joins; None if merging does not end in the piece."""
    parts = list(piece)
    while len(parts) > 2:
        best = min(((order.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best[0] == 1 << 60:
            return None
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(parts) if len(parts) == 2 and "".join(parts) in order else None


@lru_cache(maxsize=4)
def tables(path: str) -> Tables:
    """Reads a model file on the driver."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        raw = f.read()
    model = pb.ModelProto()
    model.ParseFromString(raw)
    norm = model.normalizer_spec
    if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with identity normalisation that keep white space are supported")
    kinds = {1: False, 2: True}
    if model.trainer_spec.model_type not in kinds:
        raise ValueError("only unigram and BPE models are supported")
    bpe, pieces = kinds[model.trainer_spec.model_type], model.pieces
    if any(p.type in (USER, UNUSED) for p in pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    normal = [(i, p.piece, p.score) for i, p in enumerate(pieces) if p.type == NORMAL and p.piece]
    if any(SPACE in p.lstrip(SPACE) for _, p, _ in normal):
        raise ValueError("pieces that go on after a space are not supported")
    ids = {p: i for i, p, _ in normal}
    n = len(pieces)
    order = np.full(n, -1, dtype=np.int64)
    rank = {p: k for k, (_, p, _) in enumerate(sorted((x for x in normal if len(x[1]) > 1), key=lambda x: (-x[2], x[0])))}
    left, right = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    usable, pairs = [], {}
    for i, p, _ in normal:
        if bpe and len(p) > 1:
            split = _bpe(p, rank)
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    pairs[ids[p[:k]] * n + ids[p[k:]]] = rank[p]
            if not split or split[0] not in ids or split[1] not in ids:
                continue
            order[i], left[i], right[i] = rank[p], ids[split[0]], ids[split[1]]
        usable.append((i, p))
    chars = np.array(sorted({ord(c) for _, p in usable for c in p}), dtype=np.int64)
    codes = np.zeros((len(usable), max((len(p) for _, p in usable), default=1)), dtype=np.int64)
    for k, (_, p) in enumerate(usable):
        codes[k, : len(p)] = np.searchsorted(chars, [ord(c) for c in p]) + 1
    byte_ids = np.full(256, -1, dtype=np.int64)
    surface = [b""] * n
    for i, p in enumerate(pieces):
        if p.type == BYTE:
            byte_ids[int(p.piece[3:-1], 16)] = i
            surface[i] = bytes([int(p.piece[3:-1], 16)])
        elif p.type == NORMAL:
            surface[i] = p.piece.replace(SPACE, " ").encode()
        elif p.type == UNKNOWN:
            surface[i] = (model.trainer_spec.unk_surface or " ⁇ ").encode()
    keys = np.array(sorted(pairs), dtype=np.int64)
    return Tables(hashlib.sha256(raw).hexdigest(), bpe, n, model.trainer_spec.unk_id, norm.add_dummy_prefix, chars, codes, (codes > 0).sum(1), np.array([i for i, _ in usable]), np.array([p.score for p in pieces]), order, left, right, keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.int64), byte_ids, surface)


def beside(t: Tables, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging would leave piece b right after piece a (ids; t.size stands for a character without a piece).

    Going back through the merges of both, latest first, no pair that ever met at the border may have joined before
    the merge that next changed one of its sides.
    """
    ok = np.ones(len(a), dtype=bool)
    live = np.flatnonzero((a < t.size) & (b < t.size))
    x, y, limit = a[live], b[live], np.full(len(live), 1 << 60)
    while len(live):
        key = x * t.size + y
        at = np.minimum(np.searchsorted(t.pairs, key), max(0, len(t.pairs) - 1))
        joined = (t.pairs[at] == key) & (t.joins[at] < limit) if len(t.pairs) else np.zeros(len(key), bool)
        ok[live[joined]] = False
        ox, oy = t.order[x], t.order[y]
        go = ~joined & ((ox >= 0) | (oy >= 0))
        live, x, y, ox, oy = live[go], x[go], y[go], ox[go], oy[go]
        first = ox > oy  # the left piece was formed last; at a tie the left one is formed first
        limit = np.where(first, ox, oy + 1)
        x, y = np.where(first, t.right[x], x), np.where(first, y, t.left[y])
    return ok


def _occurrences(t: Tables, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (start, row of t.codes) of all occurrences of pieces in codes (values under width), by a suffix array."""
    bits = max(1, int(width).bit_length())
    per = 62 // bits
    longest = t.codes.shape[1]
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(longest + per, dtype=np.int64)])
    keys = []
    for first in range(0, longest, per):
        k = np.zeros(n, dtype=np.int64)
        for j in range(per):
            k = (k << bits) | padded[first + j : first + j + n]
        keys.append(k)
    suffixes = np.lexsort(keys[::-1])
    ranked = [k[suffixes] for k in keys]
    here = np.flatnonzero(((t.lut[t.codes] > 0) | (t.codes == 0)).all(1)) if len(t.codes) else np.zeros(0, np.int64)
    want = np.where(t.codes[here] > 0, t.lut[t.codes[here]], 0)
    fill = np.where(t.codes[here] > 0, want, (1 << bits) - 1)
    bounds = []
    for table, right in ((want, False), (fill, True)):
        table = np.concatenate([table, np.full((len(here), per), (1 << bits) - 1 if right else 0)], axis=1)
        parts = []
        for first in range(0, longest, per):
            k = np.zeros(len(here), dtype=np.int64)
            for j in range(per):
                k = (k << bits) | table[:, first + j]
            parts.append(k)
        low, high = np.searchsorted(ranked[0], parts[0], "left"), np.searchsorted(ranked[0], parts[0], "right")
        for r, p in zip(ranked[1:], parts[1:]):
            # binary search of the next characters inside the range of equal characters so far
            a, b, c = low.copy(), high.copy(), low
            d = high
            for side in ("left", "right"):
                lo, hi = a.copy(), b.copy()
                while (lo < hi).any():
                    mid = (lo + hi) >> 1
                    v = r[np.minimum(mid, n - 1)]
                    up = ((v < p) if side == "left" else (v <= p)) & (lo < hi)
                    lo, hi = np.where(up, mid + 1, lo), np.where(up | (lo >= hi), hi, mid)
                if side == "left":
                    c = lo
                else:
                    d = lo
            low, high = c, d
        bounds.append(high if right else low)
    # A short piece has no further characters to compare: its range ends with the last suffix that starts with it.
    count = np.maximum(0, bounds[1] - bounds[0])
    row = np.repeat(here, count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return suffixes[np.repeat(bounds[0], count) + offset], row


class Matcher:
    """Encodes lists of texts; keeps the encodings of segments."""

    def __init__(self, t: Tables):
        self.t = t
        self.kind = "<u2" if t.size <= 1 << 16 else "<u4"
        lone = re.escape("".join(c for c in "\n\r\t" if ord(c) not in t.chars))  # no piece holds these: cuts as well
        self.cut = re.compile(f" *[^ {lone}]+| +" + (f"|[{lone}]+" if lone else "")).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before `known` was begun anew
        self.width = np.array([len(x) for x in t.surface], dtype=np.int64)
        self.at = np.cumsum(self.width) - self.width
        self.every = np.frombuffer(b"".join(t.surface), np.uint8)

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        return self.cut((" " if self.t.prefix else "") + text.replace(SPACE, " "))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as integers of self.kind."""
        cuts = [self.segments(x) for x in texts]
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        wanted = set().union(*cuts) - self.known.keys()
        again = wanted & self.older.keys()
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        new = list(wanted - again)
        part, held = [], 0
        for s in new:
            if part and held + len(s) > CHUNK:
                self.learn(part)
                part, held = [], 0
            part.append(s)
            held += len(s) + 1
        if part:
            self.learn(part)
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cuts]

    def learn(self, segments: list[str]) -> None:
        self.known.update(zip(segments, self.match(segments)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a text's ids, with the space that the model puts before it."""
        ids = ids.astype(np.int64)
        n = self.width[ids]
        return self.every[np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()

    def faithful(self, text: str, ids: np.ndarray) -> bool:
        """Whether these ids decode to the whole text (with U+2581 read as a space)."""
        return self.decode(ids) == ((" " if self.t.prefix and text else "") + text.replace(SPACE, " ")).encode("utf-8", "surrogatepass")

    def match(self, segments: list[str]) -> list[bytes]:
        t = self.t
        points = np.frombuffer("\0".join([*segments, ""]).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.array([len(s) for s in segments], dtype=np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        ends = starts + lengths
        n = len(points)
        # Codes of this text: 0 between segments, 1 for characters without a piece, then the characters of pieces.
        seen, code = np.unique(points, return_inverse=True)
        at = np.minimum(np.searchsorted(t.chars, seen), len(t.chars) - 1)
        known = t.chars[at] == seen
        local = np.where(known, np.cumsum(known) + 1, 1)
        codes = local[code]
        codes[ends] = 0
        t.lut = np.zeros(len(t.chars) + 1, dtype=np.int64)
        t.lut[at[known] + 1] = local[known]
        begin, row = _occurrences(t, codes, int(known.sum()) + 2)
        piece, stop = t.ids[row], begin + t.length[row]
        # A character without an edge of its own gets one that every piece can follow.
        lone = np.ones(n, dtype=bool)
        lone[begin[t.length[row] == 1]] = False
        lone[ends] = False
        lone = np.flatnonzero(lone)
        begin, piece, stop = (np.concatenate(x) for x in ((begin, lone), (piece, np.full(len(lone), t.size)), (stop, lone + 1)))
        first = np.repeat(starts, lengths + 1)  # start of the segment of each position
        wave = stop - first[begin]
        order = np.argsort(wave, kind="stable")
        begin, piece, stop = begin[order], piece[order], stop[order]
        cuts = np.searchsorted(wave[order], np.arange(1, int(lengths.max()) + 2))
        last, back = np.full(n + 1, -1, dtype=np.int64), np.full(n + 1, -1, dtype=np.int64)
        best = np.full(n + 1, -np.inf)
        best[starts] = 0.0
        floor = float(t.score.min()) - 10.0
        for a, b in zip(cuts[:-1], cuts[1:]):
            s, p, e = begin[a:b], piece[a:b], stop[a:b]
            if t.bpe:
                before = last[s]
                take = beside(t, np.where(before < 0, t.size, before), p)
                take &= (before >= 0) | (s == first[s])
                s, p, e = s[take], p[take], e[take]
            else:
                total = best[s] + np.where(p < t.size, t.score[np.minimum(p, t.size - 1)], floor)
                keep = np.lexsort((-s, total, e))
                keep = keep[np.append(e[keep][1:] != e[keep][:-1], True)] if len(keep) else keep
                s, p, e = s[keep], p[keep], e[keep]
                best[e] = total[keep]
            last[e], back[e] = p, s
        # Walk back from the ends of all segments together.
        at, seg, found = ends.copy(), np.arange(len(segments)), []
        while len(at):
            go = at > starts[seg]
            at, seg = at[go], seg[go]
            if not len(at):
                break
            found.append((seg, back[at], last[at]))
            at = back[at]
        if not found:
            return [b""] * len(segments)
        seg, pos, tok = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((pos, seg))
        seg, pos, tok = seg[order], pos[order], tok[order]
        odd = np.flatnonzero(tok == t.size)
        if len(odd):
            spelled = {c: list(chr(c).encode("utf-8", "surrogatepass")) for c in np.unique(points[pos[odd]]).tolist()}
            ids_of = {c: [int(t.byte_ids[x]) for x in b] if (t.byte_ids[b] >= 0).all() else [t.unk] for c, b in spelled.items()}
            count = np.ones(len(tok), dtype=np.int64)
            count[odd] = [len(ids_of[c]) for c in points[pos[odd]].tolist()]
            where = np.cumsum(count) - count
            flat = np.repeat(tok, count)
            for c, own in ids_of.items():
                mine = where[odd[points[pos[odd]] == c]]
                for j, x in enumerate(own):
                    flat[mine + j] = x
            seg, tok = np.repeat(seg, count), flat
        packed = tok.astype(self.kind).tobytes()
        width = int(self.kind[2])
        edge = np.searchsorted(seg, np.arange(len(segments) + 1)) * width
        return [packed[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


#: The matcher of a Python worker, which goes on from task to task with what it knows.
_HELD: dict[str, Matcher] = {}


def _matcher(t: Tables) -> Matcher:
    if t.name not in _HELD:
        _HELD.clear()
        _HELD[t.name] = Matcher(t)
    return _HELD[t.name]


def decode_ids(t: Tables, ids) -> str:
    """The text of a list of ids; control ids are silent."""
    raw = b"".join([t.surface[i] for i in ids])
    text = raw.decode("utf-8", "replace")
    return text[1:] if t.prefix and text.startswith(" ") else text


def coded(matcher: Matcher, texts: list[str]) -> list:
    """Counts, ids, checksums and round trips of texts. The ids that are returned are the ones decoded."""
    packed = [np.frombuffer(x, matcher.kind).astype("<u4") for x in matcher.encode(texts)]
    ends = np.cumsum([0, *map(len, packed)])
    flat = (np.concatenate(packed) if packed else np.zeros(0, "<u4")).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
    same = [matcher.faithful(x, flat[a:b]) for x, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist())]
    return [np.diff(ends), lists, np.array([zlib.crc32(i.tobytes()) for i in packed], dtype=np.int64), np.array(same, dtype=bool)]


def encode(docs: DataFrame, model: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """`keep` (doc_id) with n_tokens, ids (array of int), ids_crc32 (of little-endian unsigned integers of 32 bits) and
    round_trip: whether the ids decode to the text (with U+2581 read as a space)."""
    shared = docs.sparkSession.sparkContext.broadcast(tables(model))  # tables of one vocabulary

    def start():
        matcher = _matcher(shared.value)

        def run(texts: list[str]) -> list:
            return coded(matcher, texts)

        return run

    return map_text(docs, text, [("n_tokens", "bigint"), ("ids", "array<int>"), ("ids_crc32", "bigint"), ("round_trip", "boolean")], start, keep)


def decode(coded: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
    """`keep` (doc_id) and text: the texts of a column ids. Null ids and null elements count as none."""
    keep = ["doc_id"] if keep is None else keep
    shared = coded.sparkSession.sparkContext.broadcast(tables(model))
    rows = coded.select(*keep, "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", text string"

    def run(batches):
        t = shared.value
        for batch in batches:
            texts = [decode_ids(t, [i for i in ids or [] if i is not None]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.mapInArrow(run, schema)
