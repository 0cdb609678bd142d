"""Personal data: base spans against the plain expressions, the vote model on made votes, and what the classifier adds."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scopelake.llm import pii
from scopelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind: str, span: str) -> bool:
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text: str) -> list[tuple[str, int, int]]:
    found = [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fits(k, m.group())]
    return sorted(found, key=lambda x: (x[1], list(PATTERNS).index(x[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.+- ()0é\n", max_size=60))
def test_base_spans(text):
    taken = pii.base_spans(text)[0]
    assert sorted(taken) == sorted(plain(text))


def test_base_spans_on_real_forms():
    text = "Mail a.b+c@x.example.com, b@c.de@f.gh; 10.0.0.256 10.1.2.3.4.5.6.7, 4111 1111 1111 1111, 4111-1111-1111-1112; call +1 (614) 555-8001 or +49-30-123456."
    assert sorted(pii.base_spans(text)[0]) == sorted(plain(text)) and len(plain(text)) == 7
    long = "1" * 200_000 + "." * 1000 + "a" * 200_000 + "@" * 1000 + "+" * 1000 + "x@y.z"
    assert sorted(pii.base_spans(long)[0]) == [("email", len(long) - 1005, len(long))]  # linear time


def test_expectation_maximisation():
    """Votes drawn from known reliabilities: they and the hidden labels are found again."""
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    right = [0.95, 0.9, 0.8, 0.7, 0.6, 0.85]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, 0, np.where(rng.random(len(truth)) < r, np.where(truth, 1, 2), np.where(truth, 2, 1))) for r in right], 1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    prior, rates, post = pii.expect(patterns, n.astype(float))
    assert abs(prior - 0.3) < 0.02
    for j, r in enumerate(right):
        assert abs(rates[1, j, 1] / rates[1, j, 1:].sum() - r) < 0.03
    known = {tuple(p): q for p, q in zip(patterns.tolist(), post)}
    assert np.mean([(known[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth)]) > 0.95


def test_regression():
    """Sums over equal feature rows give the same weights as the rows one by one."""
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 8, 3000)
    x = np.column_stack([(bits[:, None] >> np.arange(3)) & 1, np.ones(3000)]).astype(float)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(x @ [2, -1, 0.5, -0.3])))).astype(float)
    kinds = np.unique(bits)
    grouped = pii.regress(np.array([x[bits == b][0] for b in kinds]), np.array([(bits == b).sum() for b in kinds], dtype=float), np.array([y[bits == b].sum() for b in kinds]))
    assert np.allclose(grouped, pii.regress(x, np.ones(3000), y), atol=1e-6) and np.allclose(grouped, [2, -1, 0.5, -0.3], atol=0.3)


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, candidates int")


def test_adds_looser_forms(spark):
    """Forms that no base pattern takes are learned from their votes; numbers of another kind are left alone."""
    rows = [(i, f"Contact: user{i}@host{i}.example.com or +49 30 {1000000 + i * 37}.", "", 0) for i in range(60)]
    rows += [(100 + i, f"Call (614) 555-{8000 + i} today.", "", 0) for i in range(20)]
    rows += [(200 + i, f"name: Anna Schmidt{'abcdefghijklmnopqrst'[i]}, mail jörg{i}@post.de", "", 0) for i in range(20)]
    rows += [(300 + i, f"Order 8123456{1000000 + i}x and version 3.{i}.7 of page {i}", "", 0) for i in range(20)]
    got = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in pii.spans(_docs(spark, rows)).collect()}
    assert all(got[i] == [("email", True), ("phone", True)] for i in range(60))
    assert all(("name", False) in got[200 + i] for i in range(20)) and all(any(k == "email" for k, _ in got[200 + i]) for i in range(20))
    assert all(base for i in range(20) for _, base in got[300 + i])


def test_edges(spark):
    rows = [(1, None, "", 0), (None, "a@b.cd", "x", 1), (1, "", "", 0), (1, "a@b.cd", "y", 2), (1, "a@b.cd", "y", 2), (2, "no data " * 30_000 + "é a@b.cd", "", 0)]
    got = [(r.doc_id, r.text, [(s.kind, s.start, s.end, s.base) for s in r.found]) for r in pii.spans(_docs(spark, rows), keep=["doc_id", "text"]).withColumnRenamed("spans", "found").collect()]
    want = [(d, t, [("email", len(t) - 6, len(t), True)] if t and "@" in t else []) for d, t, *_ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pii.spans(_docs(spark, [])).collect() == []
    plain_only = pii.spans(_docs(spark, [(1, "nothing here", "", 0)])).collect()
    assert [r.spans for r in plain_only] == [[]]


def test_redact(spark):
    docs = _docs(spark, [(1, "x a@b.cd y 10.1.2.3", "s", 5), (2, None, "t", 6)])
    got = {r.doc_id: (r.text, r.spans, r.candidates) for r in pii.redact(docs, pii.Model()).collect()}
    assert got == {1: ("x <email> y <ip>", "s", 5), 2: (None, "t", 6)}


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op11_pii"](spark, SF).collect()}
    assert set(got) == set(docs)
    for d, text in docs.items():
        want = plain(text)
        line = [":".join(map(str, x)) for x in want]
        assert [got[d][f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]
        assert got[d].base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert set(line) <= set(filter(None, got[d].spans.split(",")))
