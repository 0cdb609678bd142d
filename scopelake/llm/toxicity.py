"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a whole text are rates: weighted lexicon density, distinct lexicon entries, second-person words and how
often one stands near a lexicon hit, capitals, shouted words, punctuation, and obfuscated spellings (letters mixed with
digits or symbols, stretched letters, spelled-out words). The lexicon is a short fixed list plus the words and word
beginnings that the labelled rows show to be toxic. Labels, language, source and id are never inputs of a score.

The model is fitted on a bounded sample of labelled rows (SAMPLE_TOXIC and SAMPLE_CLEAN rows at most, chosen by a hash
of the id; row weights restore the share of each class): FIT_SHARE of them fit lexicon and trees, the others the
calibration. Everything else scores every row, one pass over the texts and no shuffle of them.

Edge cases: null and empty texts have the features of no words and get the score of such a text. If the labelled rows
lack one of the classes, every score is 0.0. Labels that are null are ignored; of several labels for an id the highest
counts. Rows without an id are scored; repeated rows are scored each. Empty tables give empty ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, slices

SAMPLE_TOXIC, SAMPLE_CLEAN, FIT_SHARE = 6000, 14000, 0.7
THRESHOLD = 0.7
#: Insults of common use, and second-person words of English, German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb imbecile jerk".split()
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros os".split())
STEMS = (4, 5, 6)
NEAR = 5
FEATURES = ("hit_density", "hit_count", "hit_kinds", "hit_top", "you_density", "you_near_hit", "capital_rate", "shout_rate", "mark_rate", "exclaim_rate", "symbol_rate", "obfuscated_rate", "stretched_rate", "spelled_rate", "digit_rate", "log_words")
_WORD = re.compile(r"\w+")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$*#!|+]+[^\W\d_]+|[^\W\d_]*[@$*][^\W\d_]+")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_SPELLED = re.compile(r"\b[^\W\d_](?:[ .\-_*][^\W\d_]\b){2,}")


def terms(word: str) -> list[str]:
    """What the lexicon may know a word by: itself and its beginnings."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


class Weights(dict):
    """Lexicon weight of words, found once for each."""

    def __init__(self, lexicon: dict[str, float], most: int = 300_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0)
        return found


def features(text: str, weights: Weights) -> list[float]:
    """The dense features of one whole text, in the order of FEATURES."""
    words = _WORD.findall(text.lower())
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    worth = np.fromiter(map(weights.__getitem__, words), dtype=np.float32, count=n)
    hits = np.flatnonzero(worth)
    you = np.flatnonzero(np.fromiter(map(YOU.__contains__, words), dtype=bool, count=n))
    near = 0
    if len(hits) and len(you):
        at = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(hits - you[np.minimum(at, len(you) - 1)]), np.abs(hits - you[np.maximum(at - 1, 0)]))
        near = int((gap <= NEAR).sum())
    raw = text.encode("utf-8", "surrogatepass")
    codes = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    letters = max(1, codes[65:91].sum() + codes[97:123].sum())
    marks = codes[33:48].sum() + codes[58:65].sum() + codes[91:97].sum() + codes[123:127].sum()
    size = max(1, len(raw))
    return [
        float(worth.sum()) / n * 100,
        math.log1p(len(hits)),
        math.log1p(len({words[i] for i in hits.tolist()})),
        float(worth.max()),
        len(you) / n * 100,
        near / n * 100,
        float(codes[65:91].sum()) / letters,
        sum(map(str.isupper, filter(lambda x: len(x) > 2, text.split()))) / n,
        float(marks) / size,
        float(codes[33] + codes[63]) / size,
        float(codes[[35, 36, 37, 38, 42, 60, 62, 64, 94, 124, 126]].sum()) / size,
        len(_MIXED.findall(text)) / n if codes[[33, 35, 36, 42, 43, 64, 124]].sum() + codes[48:58].sum() else 0.0,
        sum(1 for _ in _STRETCHED.finditer(text)) / n,
        sum(1 for _ in _SPELLED.finditer(text)) / n,
        float(codes[48:58].sum()) / size,
        math.log1p(n),
    ]


@dataclass
class Trees:
    """Boosted trees that ask one question per level: feature[t, d] > cut[t, d]; leaf[t] holds the 2^depth values."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            out += leaf[((x[:, f] > c) << np.arange(len(f))).sum(1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 2.0) -> Trees:
    """Trees of logistic loss, grown level by level over feature histograms."""
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    code = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T)], 1)  # code > k: value > edges[k]
    mean = float(np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4))
    base = math.log(mean / (1 - mean))
    f = np.full(len(y), base)
    feats, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = w * (y - p), w * p * (1 - p)
        node, tf, tc = np.zeros(len(y), dtype=np.int64), [], []
        for level in range(depth):
            best = (-np.inf, 0, 0)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                k, wide = node * (len(e) + 1) + code[:, j], (len(e) + 1) << level
                sums = [np.bincount(k, v, wide).reshape(-1, len(e) + 1).cumsum(1) for v in (g, h)]
                gl, hl, gt, ht = sums[0][:, :-1], sums[1][:, :-1], sums[0][:, -1:], sums[1][:, -1:]
                gain = (gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2)).sum(0)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], j, i)
            _, j, i = best
            node += (code[:, j] > i).astype(np.int64) << level
            tf.append(j)
            tc.append(edges[j][i] if len(edges[j]) else np.inf)
        leaf = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + l2)
        f += leaf[node]
        feats.append(tf)
        cuts.append(tc)
        leaves.append(leaf)
    return Trees(base, np.array(feats), np.array(cuts, dtype=float), np.array(leaves))


def isotonic(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on p, by pooling adjacent violators."""
    at, group = np.unique(p, return_inverse=True)
    weight = np.bincount(group, w)
    pools: list[list[float]] = []  # mean, weight, last p, first p
    for a, b, c in zip(at.tolist(), (np.bincount(group, w * y) / weight).tolist(), weight.tolist()):
        pools.append([b, c, a, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, v, last, _ = pools.pop()
            q = pools[-1]
            q[0], q[1], q[2] = (q[0] * q[1] + m * v) / (q[1] + v), q[1] + v, last
    xs = np.array([x for q in pools for x in (q[3], q[2])])
    return xs, np.array([q[0] for q in pools for _ in range(2)])


@dataclass
class Model:
    """A fitted scorer; small, so tasks get it with their code. trees None: no labels of both classes."""

    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.zeros(len(x))
        p = 1 / (1 + np.exp(-self.trees.margin(x)))
        # The raw probability breaks the ties of calibrated steps.
        return np.clip(0.999 * np.interp(p, *self.knots) + 0.001 * p, 0.0, 1.0)


def held_out(col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count_terms(sample: DataFrame, only: frozenset | None) -> DataFrame:
    """(term, n): in how many texts each term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    seen = {t for w in set(_WORD.findall((text or "").lower())) for t in terms(w)}
                    found.update(seen if only is None else seen & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    return sample.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN) -> Model:
    """A scorer from docs(doc_id, text) and labels(doc_id, toxic); rows of the held-out fold are never read."""
    known = labels.filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {bool(r.toxic): r["count"] for r in known.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    if not counts.get(True) or not counts.get(False):
        return Model({}, None, None)
    rows = known.filter("toxic > 0").orderBy(F.xxhash64("doc_id")).limit(toxic_rows).union(known.filter("toxic <= 0").orderBy(F.xxhash64("doc_id")).limit(clean_rows))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(1000)) < int(FIT_SHARE * 1000)
    chosen = rows.select("doc_id", (F.col("toxic") > 0).cast("double").alias("y"), part.alias("fits")).cache()  # toxic_rows + clean_rows rows at most
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    lexicon = dict.fromkeys(INSULTS, 1.0)
    sizes = {r.y: r["count"] for r in chosen.filter("fits").groupBy("y").count().collect()}
    n_toxic, n_clean = sizes.get(1.0, 0), sizes.get(0.0, 0)
    least = max(4, n_toxic // 250)
    bad = {r.term: r.n for r in _count_terms(sample.filter("fits and y = 1"), None).filter(F.col("n") >= least).collect()}
    if bad and n_clean:
        good = {r.term: r.n for r in _count_terms(sample.filter("fits and y = 0"), frozenset(bad)).collect()}
        for term, n in bad.items():
            odds = math.log((n + 0.5) / (n_toxic + 1)) - math.log((good.get(term, 0) + 0.5) / (n_clean + 1))
            if odds > 2.5:
                lexicon[term] = max(lexicon.get(term, 0.0), min(odds, 8.0) / 4)
        # A beginning adds nothing to a list of words that all stand for themselves, but catches the words not yet seen.
    got = feature_rows(sample, lexicon, ["doc_id", "y", "fits"]).toPandas().sort_values("doc_id", kind="stable")
    chosen.unpersist()
    if not len(got) or got.y.nunique() < 2 or got[got.fits].y.nunique() < 2:
        return Model({}, None, None)
    x, y, fits = np.stack(got.x.to_list()), got.y.to_numpy(), got.fits.to_numpy()
    w = np.where(y > 0, counts[True] / max(1, (y > 0).sum()), counts[False] / max(1, (y == 0).sum()))
    w /= w.mean()
    trees = boost(x[fits], y[fits], w[fits])
    rest = ~fits if len(set(y[~fits])) > 1 else np.ones(len(y), dtype=bool)
    p = 1 / (1 + np.exp(-trees.margin(x[rest])))
    return Model(lexicon, trees, isotonic(p, y[rest], w[rest]))


def feature_rows(docs: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    """`keep` and x, the array of features of each whole text."""

    def start():
        weights = Weights(lexicon)
        return lambda texts: [[features(t, weights) for t in texts]]

    return map_text(docs, "text", [("x", "array<double>")], start, keep)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """`keep` (doc_id) with the score of each whole text."""

    def start():
        weights = Weights(model.lexicon)

        def scores(texts: list[str]) -> list:
            x = np.array([features(t, weights) for t in texts], dtype=float).reshape(-1, len(FEATURES))
            return [pa.array(model.scores(x))]

        return scores

    return map_text(docs, "text", [("score", "double")], start, keep)


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, model or fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of docs whose text scores under the threshold, in one pass."""
    model = fit(docs, labels)
    scored = score(docs.withColumn("__keep", F.struct(*(F.col(f"`{c}`") for c in docs.columns))), model, ["__keep"])
    return scored.filter(F.col("score") < threshold).select("__keep.*")
