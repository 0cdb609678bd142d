"""Mixing to target weights with soft membership: a classifier says how much of each domain a document is, and document
rates are fitted so that the expected tokens of the domains match their targets.

1. A softmax regression over hashed words and word beginnings is trained on a bounded sample of labelled rows
   (SAMPLE_ROWS at most, chosen by a hash of the id) and predicts domain posteriors p of every whole text.
2. With token counts n and rates r >= 0, the expected tokens of domain k are sum(r n p_k). Projected gradient descent
   lowers the weighted squared distance of these totals to the targets, from r = 1: each step needs only the totals of
   the step before, one aggregation over a narrow table; the gradient is preconditioned by the Gram matrix of the
   domains, so a step length of 1 is safe. A row's rate is a closed expression over the history of these totals, so
   nothing per document is collected, joined or rewritten between steps.

Tokens are runs of word characters and runs of other marks. Equal documents get equal rates.

Edge cases: null and empty texts have no tokens; they get a posterior and a rate like any text but add nothing to the
totals. Labels of unknown domains are ignored; domains that no labelled row has get a posterior of 0 (without any
labels all posteriors are equal) and cannot reach a target above 0. Repeated rows count each. Targets are scaled to sum
to 1. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_text

BITS = 13
BUCKETS, SAMPLE_ROWS = 1 << BITS, 8000
_WORD = re.compile(r"\w+|[^\w\s]+")
#: Texts with other characters than these (Latin letters, usual signs and blanks) are cut by _WORD itself.
_OTHER = r"[^\t\n\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{2044}\x{20ac}]"


class Hashed(dict):
    """Feature buckets of words: of the word itself and of its beginning, in one number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        self[word] = found = crc32(raw) % BUCKETS << BITS | crc32(b"^" + word[:5].encode("utf-8", "surrogatepass")) % BUCKETS
        return found


def words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The lower-cased tokens of texts, one after the other, and the text that each is of."""
    other = pc.match_substring_regex(texts, _OTHER)
    usual, rest = np.flatnonzero(~other.to_numpy(zero_copy_only=False)), np.flatnonzero(other.to_numpy(zero_copy_only=False))
    apart = pc.replace_substring_regex(pc.utf8_lower(texts.take(pa.array(usual))), r"([^\p{L}\p{N}_\t\n\r ]+)", r" \1 ")
    cut = pc.ascii_split_whitespace(apart)
    own = [_WORD.findall(t.lower()) for t in texts.take(pa.array(rest)).to_pylist()]
    found = pa.concat_arrays([cut.flatten(), pa.array([w for x in own for w in x], pa.string())])
    of = np.concatenate([np.repeat(usual, pc.list_value_length(cut).to_numpy()), np.repeat(rest, [len(x) for x in own])]).astype(np.int64)
    full = pc.not_equal(found, "")  # blanks at either end of a text
    return of[full.to_numpy(zero_copy_only=False)], found.filter(full).dictionary_encode()


@dataclass
class Features:
    """Of a batch of texts: buckets and weights by text (`row`), and the number of tokens of each text."""

    row: np.ndarray
    idx: np.ndarray
    val: np.ndarray
    tokens: np.ndarray

    def lists(self) -> tuple[pa.Array, pa.Array]:
        order = np.argsort(self.row, kind="stable")
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(self.row, minlength=len(self.tokens)))]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(self.idx[order], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(self.val[order], pa.float32()))


def features(texts: pa.Array, hashed: Hashed) -> Features:
    """Distinct tokens weigh by the logarithm of their counts, to length one. Two more buckets tell how often a text's
    words repeat. A bucket may be named twice; its weights add up."""
    of, coded = words(texts)
    code = np.fromiter(map(hashed.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(coded.dictionary))
    distinct = max(1, len(code))
    key, n = np.unique(of * distinct + coded.indices.to_numpy(), return_counts=True)
    row, code = key // distinct, code[key % distinct] if len(key) else np.zeros(0, np.int64)
    tokens = np.bincount(of, minlength=len(texts))
    weight = np.log1p(n)
    weight /= np.sqrt(2 * np.bincount(row, weight * weight, len(texts)))[row]
    some = np.flatnonzero(tokens)
    kinds = np.bincount(row, minlength=len(texts))[some]
    most = np.maximum.reduceat(n, np.cumsum(kinds) - kinds) if len(some) else np.zeros(0)
    extra = np.ones(len(some), dtype=np.int64)
    return Features(
        np.concatenate([row, row, some, some]),
        np.concatenate([code >> BITS, code & (BUCKETS - 1), BUCKETS * extra, (BUCKETS + 1) * extra]),
        np.concatenate([weight, weight, most / tokens[some], kinds / tokens[some]]).astype(np.float32),
        tokens,
    )


@dataclass
class Classifier:
    """Softmax regression; domains without labelled rows have weights of their own that never win."""

    domains: tuple[str, ...]
    weights: np.ndarray  # (BUCKETS + 2) x domains
    bias: np.ndarray

    def posteriors(self, f: Features) -> np.ndarray:
        """A row for each text, a column for each domain."""
        z = np.stack([np.bincount(f.row, f.val * self.weights[f.idx, k], len(f.tokens)) for k in range(len(self.domains))], 1) + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], rows: int = SAMPLE_ROWS, steps: int = 150, l2: float = 1e-5) -> Classifier:
    """From docs(doc_id, text) and labelled(doc_id, domain)."""
    none = Classifier(tuple(domains), np.zeros((BUCKETS + 2, len(domains))), np.zeros(len(domains)))
    known = labelled.filter(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = known.orderBy(F.xxhash64("doc_id")).limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `rows` rows at most
    got = feature_rows(sample, ["doc_id", "domain"]).toArrow().sort_by("doc_id")  # flat arrays, no object per number
    if not len(got):
        return none
    y = pc.index_in(got["domain"], pa.array(domains, got["domain"].type)).to_numpy()
    size = pc.list_value_length(got["idx"]).to_numpy()
    row, idx, val = np.repeat(np.arange(len(got), dtype=np.int32), size), pc.list_flatten(got["idx"]).to_numpy(), pc.list_flatten(got["val"]).to_numpy()
    del got
    k = len(domains)
    prior = np.bincount(y, minlength=k) / len(y)
    w, b = np.zeros((BUCKETS + 2, k)), np.log(np.maximum(prior, 1e-12))
    hot = np.eye(k)[y]
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(k), np.zeros(k)
    for t in range(1, steps + 1):
        z = np.stack([np.bincount(row, val * w[idx, j], len(y)) for j in range(k)], 1) + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        r = (p - hot) / len(y)
        gw = np.stack([np.bincount(idx, val * r[row, j], BUCKETS + 2) for j in range(k)], 1) + l2 * w
        gb = np.where(prior > 0, r.sum(0), 0.0)
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.15 * (1 - 0.9**t) ** -1
        w -= rate * mw / (np.sqrt(vw / (1 - 0.99**t)) + 1e-8)
        b -= rate * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    b[prior == 0] = -1e9
    w[:, prior == 0] = 0
    return Classifier(tuple(domains), w, b)


def feature_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    def start():
        hashed = Hashed()

        def run(texts: pa.Array) -> list:
            found = features(texts, hashed)
            return [*found.lists(), found.tokens]

        return run

    return map_text(docs, "text", [("idx", "array<int>"), ("val", "array<float>"), ("n_tokens", "bigint")], start, keep, arrow=True)


def memberships(docs: DataFrame, model: Classifier, keep: list[str] | None = None) -> DataFrame:
    """`keep` (doc_id) with n_tokens and p, the posteriors of each whole text in the order of the model's domains."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x domains numbers

    def start():
        hashed, m = Hashed(), shared.value

        def run(texts: pa.Array) -> list:
            found = features(texts, hashed)
            p = m.posteriors(found)
            ends = pa.array(np.arange(len(texts) + 1) * p.shape[1], pa.int32())
            return [found.tokens, pa.ListArray.from_arrays(ends, pa.array(p.reshape(-1), pa.float64()))]

        return run

    return map_text(docs, "text", [("n_tokens", "bigint"), ("p", "array<double>")], start, keep, arrow=True)


@dataclass
class Fit:
    """Fitted rates: the history of steps, the totals they end with, and whether these met the targets or moved no more."""

    steps: list[np.ndarray]
    totals: np.ndarray
    targets: np.ndarray
    settled: bool = False

    def rate(self, p: str = "p") -> F.Column:
        r = F.lit(1.0)
        for u in self.steps:
            r = F.greatest(F.lit(0.0), r - sum((F.col(p)[k] * float(x) for k, x in enumerate(u)), F.lit(0.0)))
        return r


def fit_rates(members: DataFrame, targets: dict[str, float], domains: tuple[str, ...], budget: float = 1.0, steps: int = 40, tolerance: float = 1e-6) -> Fit:
    """Rates for members(n_tokens, p) whose expected totals are budget * all tokens * target of each domain.

    members is read once per step, so it should be a stored table.
    """
    k = len(domains)
    share = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("double")
    first = members.agg(F.coalesce(F.sum(n), F.lit(0.0)), *(F.coalesce(F.sum(n * F.col("p")[i] * F.col("p")[j]), F.lit(0.0)) for i in range(k) for j in range(k))).first()
    want = share / (share.sum() or 1.0) * budget * first[0]
    gram = np.array(first[1:]).reshape(k, k)
    inverse = np.linalg.pinv(gram + np.eye(k) * 1e-9 * max(np.trace(gram), 1e-12))
    found = Fit([], np.zeros(k), want)
    for _ in range(steps + 1):
        r = found.rate()
        found.totals = np.array(members.agg(*(F.coalesce(F.sum(n * r * F.col("p")[i]), F.lit(0.0)) for i in range(k))).first(), dtype=float)
        off = found.totals - want
        step = inverse @ off
        found.settled = bool(np.abs(off).max() <= tolerance * max(first[0], 1.0) or np.abs(step).max() < 1e-12)
        if found.settled or len(found.steps) == steps:
            break
        found.steps.append(step)
    return found


def quality_domains(labels: DataFrame) -> DataFrame:
    """labelled(doc_id, domain) from labels(doc_id, quality, toxic): high for good and harmless documents, else low."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.filter("quality is not null").groupBy("doc_id").agg(F.when(F.min(good.cast("int")) == 1, "high").otherwise("low").alias("domain"))


#: Domains of quality_domains, and their production targets.
TARGETS = {"high": 0.97, "low": 0.03}


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = 1.0) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate and settled of every document; settled is false on all rows if the fit stopped at
    its number of steps before the totals met the targets or ceased to move."""
    domains = tuple(targets)
    members = cut(memberships(docs, fit(docs, labelled, domains)))
    found = fit_rates(members, targets, domains, budget)
    return members.select("doc_id", "n_tokens", *(F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(domains)), found.rate().alias("rate"), F.lit(found.settled).alias("settled"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = 1.0) -> DataFrame:
    """The rows and columns of docs, each as often as its rate says: floor(rate), and once more with the probability of
    the rest, drawn by a hash of its id and text, so that every run draws the same."""
    domains = tuple(targets)
    model = fit(docs, labelled, domains)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    placed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("__h"))
    members = cut(memberships(placed, model, ["doc_id", "__h"]))
    found = fit_rates(members, targets, domains, budget)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "__h"), 11) / float(1 << 53)
    copies = members.select(F.col("doc_id").alias("__d"), F.col("__h").alias("__k"), F.floor(found.rate() + draw).cast("int").alias("__n")).distinct()
    rows = docs.select(whole.alias("__row"), F.xxhash64("doc_id", "text").alias("__h"), F.col("doc_id").alias("__id"))
    joined = rows.join(copies, (F.col("__h") == F.col("__k")) & F.col("__id").eqNullSafe(F.col("__d"))).filter("__n > 0")
    return joined.select("__row", F.explode(F.sequence(F.lit(1), F.col("__n")))).select("__row.*")
