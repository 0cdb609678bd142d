"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation finds how far each can be
trusted, and a span classifier learns from what the votes come to.

1. One pass over whole texts finds candidates: everything the base patterns take, what they take and then drop (a bad
   checksum, too many digits), and looser forms: mail addresses spelled out or with letters beyond ASCII, IPv6, phone and
   card numbers without the strict form, names, and numbers of identity cards and bank accounts. Six labelers vote yes,
   no or nothing on each: two regex labelers (form, check), a gazetteer (domains, networks, issuers, country codes, given
   names), two of context (cue words before the span, for and against) and one for the edges of the span.
2. Votes are counted by kind and pattern over all documents (KINDS x 3^6 numbers at most). A two-class model of
   independent labelers is fitted to the counts by EM, per kind, with a prior that takes labelers to be better than chance.
3. Features of the span itself (length, digits, separators, neighbours: BITS bits) are counted with the expected label, per
   kind and feature set (KINDS x 2^BITS numbers at most), and a logistic regression per kind is fitted to these sums, so
   every candidate of every document trains it.
4. Base spans stay whatever the classifier says. It adds candidates from ADD_FROM on that overlap no base span; of
   overlapping ones the likelier stays.

The base patterns are found in linear time: around each @ and +, and as maximal chains of digits. Candidates of a document
stay in its row; nothing is shuffled but the two small counts. Candidates lie in the shared folder between the passes.

Edge cases: null and empty texts have no spans; each row is judged alone, so repeated and null ids need no rule. With no
candidates at all nothing is added. Columns are kept by name, whatever else the table has.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, map_text, release, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "id")
LABELERS = ("form", "check", "gazetteer", "cue", "against", "edges")
YES, NO = 1, 2
BITS = 14
ADD_FROM = 0.9
CANDIDATES = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:int,bits:int>>"
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>"

#: Gazetteers, short lists of common knowledge; all are parameters of Gazetteer.
DOMAINS = frozenset("com org net edu gov mil int info biz io co dev app ai me name de fr es it nl be at ch uk eu us ca mx br ar cl pe pl cz dk se no fi pt gr ro hu ie ru ua tr il in cn jp kr au nz za".split())
SUFFIXES = frozenset("png jpg jpeg gif svg js css html htm php txt pdf zip py java json xml".split())
GIVEN = frozenset(
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Maria Peter Paul Hans Klaus Wolfgang Monika Ursula Pierre Jean Michel Philippe Marie Nathalie Isabelle José Juan Carlos Luis Javier Carmen Lucía Sofía Antonio Manuel Laura Julia Emma Olivia Noah Liam Lukas Leon Ahmed Mohammed Fatima Wei Yuki Ivan Olga Giulia Marco".split()
)
TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 98 212 213 216 351 352 353 354 358 359 370 371 372 380 385 386 420 421 971 972".split())
ACCOUNTS = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
CUES = {
    "email": ("mail", "contact", "write to", "kontakt", "courriel", "correo"),
    "ip": ("ip", "host", "address", "server", "login", "adresse", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "contact", "anruf", "telefon", "appel", "llam"),
    "name": ("name", "contact", "by ", "from", "dear", "sincerely", "signed", "herr", "frau", "mr", "mrs", "dr"),
    "id": ("ssn", "social security", "iban", "account", "konto", "compte", "cuenta", "passport"),
}
AGAINST = ("version", "isbn", "issn", "doi", "build", "release", "order", "invoice", "page", "figure", "table", "section", "chapter", "line ", "total", "sum", "pi ", "e.g.", "serial", "model", "item", "sku", "year")

_IP = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOOSE_LOCAL = re.compile(r"[\w.!#$%&'*+/=?^`{|}~-]+")
_LOOSE_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_SPELLED = re.compile(r"(?<![\w.])\w[\w.+-]{0,63} ?[\[({](?:at|AT)[\])}] ?[\w-]{1,63}(?: ?(?:[\[({](?:dot|DOT)[\])}]|\.) ?[\w-]{1,63})+")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_NUMBER = re.compile(r"(?<![\w.@/+-])\(?[0-9]{2,5}\)?(?:[ .-]\(?[0-9]{2,5}\)?){1,5}+(?![\w@/-])")
_SOCIAL = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_NAME = re.compile(r"(?<![\w.])(?:[A-ZÀ-Þ][a-zà-ÿ]{0,6}\. |[A-ZÀ-Þ][a-zà-ÿ]+ )[A-ZÀ-Þ][a-zà-ÿ]+(?: [A-ZÀ-Þ][a-zà-ÿ]+)?(?!\w)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the base pattern: each holds one @ that letters of a mailbox stand before, so they are looked for from there."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(taken, dropped) spans of the four base patterns, each kind leftmost and without overlap."""
    taken, dropped = [("email", *x) for x in emails(text)], []
    for m in _IP.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)
            (taken if fits else dropped).append(("ip", at, end))
            at = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19:
                (taken if luhn(digits) else dropped).append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            (taken if 9 <= len(_digits(m.group())) <= 15 else dropped).append(("phone", *m.span()))
    return taken, dropped


def _loose(text: str) -> Iterator[tuple[str, int, int]]:
    """Candidates of freer forms."""
    at = text.find("@")
    while at >= 0:
        m = _LOOSE_DOMAIN.match(text, at + 1)
        start = at
        while start > max(0, at - 64) and _LOOSE_LOCAL.match(text[start - 1]):
            start -= 1
        if m and start < at:
            yield "email", start, m.end()
        at = text.find("@", at + 1)
    low = text.lower()
    if any(x in low for x in ("(at)", "[at]", "{at}")):
        yield from (("email", *m.span()) for m in _SPELLED.finditer(text))
    if ":" in text:
        yield from (("ip", *m.span()) for m in _IP6.finditer(text) if "::" in m.group() or m.group().count(":") == 7)
    for m in _NUMBER.finditer(text):
        n = len(_digits(m.group()))
        if 7 <= n <= 15:
            yield "phone", *m.span()
        if 12 <= n <= 19:
            yield "card", *m.span()
    yield from (("id", *m.span()) for m in _SOCIAL.finditer(text))
    yield from (("id", *m.span()) for m in _IBAN.finditer(text))
    for m in _NAME.finditer(text):
        if (head := m.group().split()[0]) in GIVEN or head.rstrip(".") in TITLES:
            yield "name", *m.span()


def _iban(text: str) -> bool:
    raw = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def judge(text: str, kind: str, start: int, end: int, form: int) -> tuple[int, int]:
    """(votes, bits) of a candidate: the labelers' votes as digits to the base 3, and the features of the span."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 1]
    digits, low = _digits(span), before.lower()
    check = known = 0
    if kind == "email":
        top = span.rpartition(".")[2].lower().strip(" )]}")
        check = YES if len(top) > 1 and top.isalpha() else NO
        known = YES if top in DOMAINS else NO if top in SUFFIXES else 0
    elif kind == "ip":
        try:
            ip = ipaddress.ip_address(".".join(str(int(p)) for p in span.split(".")) if "." in span else span)
            check, known = YES, NO if ip.is_private or ip.is_loopback or ip.is_unspecified else 0
        except ValueError:
            check = NO
    elif kind == "card":
        check, known = YES if luhn(digits) else NO, YES if digits[0] in "3456" else NO
    elif kind == "phone":
        check = YES if 9 <= len(digits) <= 15 else NO
        known = YES if span[0] == "+" and any(digits[:n] in CALLING for n in (1, 2, 3)) else 0
    elif kind == "name":
        head = span.split()[0].rstrip(".")
        check, known = YES if head in TITLES else 0, YES if head in GIVEN else 0
    else:
        check = (YES if _iban(span) else NO) if span[0].isalpha() else NO if span[:3] in ("000", "666") or span[0] == "9" else YES
        known = YES if span[:2] in ACCOUNTS else 0
    cue = YES if any(c in low for c in CUES[kind]) else 0
    against = NO if any(c in low for c in AGAINST) else 0
    edges = NO if before[-1:].isalnum() or after.isalnum() else YES
    votes = sum(v * 3**i for i, v in enumerate((form, check, known, cue, against, edges)))
    gaps = {c for c in span if not c.isalnum()}
    flags = (
        len(span) < 9, 9 <= len(span) < 15, len(span) >= 20, 2 * len(digits) > len(span), any(c.isalpha() for c in span), bool(gaps), len(gaps) == 1, before[-1:].isspace() or not before, after.isspace() or not after,
        before.rstrip()[-1:] == ":" or bool(cue), bool(against), bool(digits) and len(set(digits)) <= 2, check == YES, form == YES,
    )
    return votes, sum(1 << i for i, x in enumerate(flags) if x)


def candidates(text: str) -> list[tuple[int, int, int, bool, int, int]]:
    """(kind, start, end, base, votes, bits) of a whole text; kinds by number. Looser forms that overlap a base span are none."""
    taken, dropped = base_spans(text)
    found: dict[tuple, int] = {x: YES for x in taken}
    for x in dropped:
        found.setdefault(x, NO)
    base, ends = set(taken), sorted((e, s) for _, s, e in taken)
    for x in _loose(text):
        first = bisect_right(ends, (x[1], x[2]))  # base spans that end after its start
        if x in found or not any(s < x[2] for _, s in ends[first : first + len(BASE)]):
            found.setdefault(x, 0)
    return sorted((KINDS.index(x[0]), x[1], x[2], x in base, *judge(text, *x, form)) for x, form in found.items())


def found_in(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (doc_id) and the candidates of each whole text."""
    kind = to_arrow_type(docs.sparkSession.createDataFrame([], f"c {CANDIDATES}").schema["c"].dataType)

    def start():
        names = [kind.value_type.field(i).name for i in range(6)]
        return lambda texts: [pa.array([[dict(zip(names, c)) for c in candidates(t)] for t in texts], kind)]

    return map_text(docs, text, [("candidates", CANDIDATES)], start, keep)


@dataclass
class Model:
    """prior[kind] and rates[kind, class, labeler, vote] by EM; weights[kind, bit] (the last is the constant) of the classifier."""

    prior: np.ndarray = field(default_factory=lambda: np.full(len(KINDS), 0.5))
    rates: np.ndarray = field(default_factory=lambda: np.full((len(KINDS), 2, len(LABELERS), 3), 1 / 3))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((len(KINDS), BITS + 1)))

    def reliability(self) -> dict[str, dict[str, float]]:
        """How often a labeler that votes on a kind is right, by kind and labeler."""
        out = {}
        for k, kind in enumerate(KINDS):
            p = np.array([1 - self.prior[k], self.prior[k]])
            right = p[1] * self.rates[k, 1, :, YES] + p[0] * self.rates[k, 0, :, NO]
            voted = (p[:, None] * self.rates[k, :, :, 1:].sum(-1)).sum(0)
            out[kind] = dict(zip(LABELERS, (right / np.maximum(voted, 1e-12)).tolist()))
        return out

    def probability(self, kind: np.ndarray, bits: np.ndarray) -> np.ndarray:
        x = np.column_stack([(bits[:, None] >> np.arange(BITS)) & 1, np.ones(len(bits))])
        return 1 / (1 + np.exp(-(x * self.weights[kind]).sum(1)))


def expect(votes: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of votes, one per labeler) that occur n times: (prior, rates[class, labeler, vote], posterior
    of each pattern). Starts from the majority; pseudo-counts take labelers to be right more often than not."""
    total = n.sum()
    lean = (votes == YES).sum(1) - (votes == NO).sum(1)
    post = 1 / (1 + np.exp(-lean.astype(float)))
    extra = max(1.0, 0.01 * total) * np.array([[1.0, 0.4, 1.6], [1.0, 1.6, 0.4]]) / 3
    prior, rates = 0.5, None
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post])
        rates = np.stack([[[(w[c] * (votes[:, j] == v)).sum() + extra[c, v] for v in range(3)] for j in range(votes.shape[1])] for c in (0, 1)])
        rates /= rates.sum(-1, keepdims=True)
        prior = float(np.clip((w[1].sum() + 1) / (total + 2), 1e-6, 1 - 1e-6))
        logs = np.log(rates)[:, np.arange(votes.shape[1]), votes].sum(-1)
        gap = np.clip(logs[1] - logs[0] + np.log(prior / (1 - prior)), -60, 60)
        now = 1 / (1 + np.exp(-gap))
        done, post = np.abs(now - post).max() < 1e-9, now
        if done:
            break
    return prior, rates, post


def regress(x: np.ndarray, n: np.ndarray, yes: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression of expected labels: rows of x stand n times, of which `yes` are expected true (Newton's method)."""
    w = np.zeros(x.shape[1])
    own = ridge * np.eye(x.shape[1])
    own[-1, -1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + own, x.T @ (yes - n * p) - own @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(found: DataFrame) -> Model:
    """Labelers' rates and the classifier from the candidates of all documents."""
    each = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.bits")
    patterns = each.groupBy("kind", "votes").count().collect()  # KINDS x 3^LABELERS rows at most
    model, places = Model(), 3 ** np.arange(len(LABELERS))
    table = np.full(len(KINDS) * 3 ** len(LABELERS), 0.5)
    for k in range(len(KINDS)):
        own = sorted((r.votes, r["count"]) for r in patterns if r.kind == k)
        if own:
            code, n = (np.array(x) for x in zip(*own))
            model.prior[k], model.rates[k], post = expect(code[:, None] // places % 3, n.astype(float))
            table[k * 3 ** len(LABELERS) + code] = post
    expected = F.element_at(F.lit(table.tolist()), F.col("kind") * 3 ** len(LABELERS) + F.col("votes") + 1)
    sums = each.groupBy("kind", "bits").agg(F.count("*").alias("n"), F.sum(expected).alias("yes")).collect()  # KINDS x 2^BITS rows at most
    for k in range(len(KINDS)):
        own = [(r.bits, r.n, r.yes) for r in sums if r.kind == k]
        if own:
            bits, n, yes = (np.array(x) for x in zip(*own))
            model.weights[k] = regress(np.column_stack([(bits[:, None] >> np.arange(BITS)) & 1, np.ones(len(bits))]).astype(float), n.astype(float), yes)
    return model


def chosen(found: list[tuple], model: Model) -> list[tuple[str, int, int, bool, float]]:
    """(kind, start, end, base, score) of the spans that stay, by start, then kind."""
    if not found:
        return []
    kind, bits = (np.array([c[i] for c in found]) for i in (0, 5))
    score = model.probability(kind, bits).tolist()
    out = [(c[1], c[0], c[2], True, p) for c, p in zip(found, score) if c[3]]
    more = sorted((-p, c[1], c[0], c[2]) for c, p in zip(found, score) if not c[3] and p >= ADD_FROM)
    if more:
        taken = np.zeros(max(c[2] for c in found) - (low := min(c[1] for c in found)), dtype=bool)
        for s, _, e, *_ in out:
            taken[s - low : e - low] = True
        for p, s, k, e in more:
            if not taken[s - low : e - low].any():
                taken[s - low : e - low] = True
                out.append((s, k, e, False, -p))
    return [(KINDS[k], s, e, b, p) for s, k, e, b, p in sorted(out)]


def spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """Columns `keep` (doc_id) and `spans` of each whole text: kind, start and end in code points (end exclusive), whether a
    base pattern took it, and the classifier's score; by start, then by the order of KINDS."""
    keep = ["doc_id"] if keep is None else keep
    found = cut(found_in(docs, text, keep))
    model = model or fit(found)
    kind = to_arrow_type(docs.sparkSession.createDataFrame([], f"c {SPANS}").schema["c"].dataType)
    names = [kind.value_type.field(i).name for i in range(5)]
    kept = found.select(*(F.col(f"`{c}`") for c in keep)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(names, x)) for x in chosen([tuple(c.values()) for c in row], model)] for row in batch.column("candidates").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, kind)], names=[*keep, "spans"])

    return found.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"spans {SPANS}"]))


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a mark of its kind, like <email>, in place of each span of `text`, in one pass; of overlapping spans the
    first names the mark. A null text stays null."""
    others = [c for c in docs.columns if c != text]
    narrow = docs.select(F.struct(*(F.col(f"`{c}`") for c in others), F.lit(0).alias("__none")).alias("__row"), F.col(f"`{text}`").alias("__text"))

    def marked(raw: str) -> str:
        out, at = [], 0
        for kind, start, end, *_ in chosen(candidates(raw), model):
            if start >= at:
                out += [raw[at:start], f"<{kind}>"]
            at = max(at, end)
        return "".join([*out, raw[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = [None if t is None else marked(t) for t in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("__row"), pa.array(texts, pa.string())], names=["__row", "__text"])
        release()

    done = narrow.mapInArrow(run, narrow.schema)
    return done.select(*(F.col("__text").alias(c) if c == text else F.col("__row")[c].alias(c) for c in docs.columns))
