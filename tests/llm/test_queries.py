"""Every registered query of the corpus operators over a whole small table, against a plain computation."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from tokenizers import Tokenizer

from scopelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float), np.array([r.label for r in rows])


def test_op1(spark, docs):
    import base64

    want = Counter()
    for v in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        with open(public_tokenizers.path(f"{v}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for r in docs.values():
            for name, n in (("docs", 1), ("tokens", len(enc.encode_ordinary(r.text or ""))), ("chars", len(r.text or ""))):
                want[r.source, r.lang, v, name] += n
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens, r.n_chars) for r in QUERIES["op1_token_counts"](spark, SF).collect()}
    assert got == {k[:3]: tuple(want[(*k[:3], n)] for n in ("docs", "tokens", "chars")) for k in want}


def test_op2(spark, docs):
    rows = QUERIES["op2_mixing"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        assert r.n_tokens == len(re.findall(r"\w+|[^\w\s]+", (docs[r.doc_id].text or "").lower())) and r.rate >= 0 and abs(r.p_high + r.p_low - 1) < 1e-9
    total = sum(r.n_tokens for r in rows)
    assert not rows[0].settled or abs(sum(r.rate * r.n_tokens * r.p_low for r in rows) / total - 0.03) < 1e-3


def test_op3(spark, docs):
    rows = QUERIES["op3_toxicity"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and toxic.get(r.doc_id) is not None]
    ones, zeros = [s for s, t in held if t], [s for s, t in held if not t]
    if ones and zeros:
        assert np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros]) > 0.8


def test_op4(spark, docs):
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = QUERIES["op4_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.ids == m.encode(docs[r.doc_id].text or "") and r.n_tokens == len(r.ids) and r.round_trip


def test_op5(spark, vectors):
    ids, x, _ = vectors
    got = {}
    for r in QUERIES["op5_nearest_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    asked = [i for i in ids if i % 20 == 0]
    assert set(got) == set(asked)
    hit = 0
    for q in asked:
        score = (x * x[ids == q][0]).sum(1)
        want = ids[np.lexsort((ids, -np.where(ids == q, -np.inf, score)))[:20]].tolist()
        assert sorted(got[q]) == list(range(1, 21)) and all(abs(s - score[ids == i][0]) < 1e-12 for i, s in got[q].values())
        hit += len(set(want) & {i for i, _ in got[q].values()})
    assert hit >= 0.9 * 20 * len(asked)


def test_op6(spark, docs):
    tok, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op6_token_files"](spark, SF).collect()}
    for i in sorted(docs):
        ids = np.array([*tok.encode(docs[i].text or "", add_special_tokens=False).ids, 0], "<u4")
        assert got.pop(i) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_op7(spark, docs):
    def print_of(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0

    prints = {i: print_of(r.text) for i, r in docs.items()}
    root = dict(zip(prints, prints))
    changed = True
    while changed:
        changed = False
        for a in prints:
            low = min(root[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2)
            changed, root[a] = changed or low < root[a], min(low, root[a])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash_near_dedup"](spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in docs}


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def test_op8(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op8_url_filters"](spark, SF).collect()
    assert {r.page_id for r in rows} == set(urls) and len(rows) == len(urls)
    for r in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h) + len(p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fit)[2] if fit else None)
        assert r.verdict == max(fit)[1] if fit else r.verdict in ("allow", "block")


def test_op9(spark, docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    rows = QUERIES["op9_license_scans"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), docs[r.doc_id].text or ""))
        at = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in phrases}
        every, base = sorted(i for x in at.values() for i in x), sorted(phrases[p] for p, x in at.items() if x)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(every), min(every, default=None), max(every, default=None), ",".join(base))
        assert set(base) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_op10(spark, vectors):
    ids, x, label = vectors
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = ids.copy()
    for _ in range(len(ids)):
        low = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(1))
        if (low == root).all():
            break
        root = low
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op10_embedding_near_dedup"](spark, SF).collect()}
    assert got == {int(i): (int(near[k].sum()), int(root[k]), bool(root[k] == i)) for k, i in enumerate(ids)}
