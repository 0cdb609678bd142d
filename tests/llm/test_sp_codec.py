import random

import numpy as np
import public_tokenizers
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from scopelake.llm import sp_codec as C

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", " a", "  a  b ", "hello world\nNew line\r\n\ttab", "a" * 3000, "ab" * 700 + " " * 50, "北京 😀 \x00 é ﷽", "▁x y", "1234 5,6", "==== ---- //// \\\\\\\\", "    int main() {\n        return 0;\n    }", "naïve Ünïcode…“quoted”"]


def texts(seed=3, n=1500):
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz   \n.,éà1"
    parts = ["a", "b", "ab", " ", "th", "he", "in", "er", "  ", "\n", "ing", "Ω", "ß"]
    return TEXTS + ["".join(r.choice(letters if i % 2 else parts) for _ in range(r.randint(1, 70))) for i in range(n)]


def test_ids_equal_the_library():
    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    t = C.tables(PATH)
    for chunk in (500_000, 700):
        C.CHUNK, before = chunk, C.CHUNK
        got = [np.frombuffer(x, "<u2").tolist() for x in C.Matcher(t).encode(texts())]
        C.CHUNK = before
        assert got == m.encode(texts(), num_threads=1)
    assert [C.decode_ids(t, g) for g in got] == m.decode(got)


def test_decoding_any_ids():
    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    t, r = C.tables(PATH), random.Random(0)
    for _ in range(200):
        ids = [r.randrange(3, 32000) for _ in range(r.randrange(1, 12))]
        text = m.decode(ids)
        if "\ufffd" not in text:
            assert C.decode_ids(t, ids) == text


def test_unigram_best_path(tmp_path):
    r = random.Random(1)
    model = pb.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = False
    del model.pieces[:]
    vocab = sorted({"".join(r.choice("abc▁") for _ in range(r.randint(1, 4))) for _ in range(60)} | set("abc▁"))
    vocab = [v for v in vocab if "▁" not in v.lstrip("▁")]
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((v, -r.random() * 8 - 1, 1) for v in vocab)]:
        p = model.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    path = tmp_path / "u.model"
    path.write_bytes(model.SerializeToString())
    m, t = sentencepiece.SentencePieceProcessor(model_file=str(path)), C.tables(str(path))
    many = ["".join(r.choice("abc ") for _ in range(r.randint(0, 25))) for _ in range(300)]
    score = lambda ids: sum(m.get_score(i) for i in ids)  # noqa: E731  ties may be cut either way
    for x, got in zip(many, C.Matcher(t).encode(many)):
        got = np.frombuffer(got, "<u2").tolist()
        assert m.decode(got) == m.decode(m.encode(x)) and abs(score(got) - score(m.encode(x))) < 1e-3


def test_query_shape(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (None, "no id", "x"), (1, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    coded = C.encode(docs, PATH)
    got = sorted(((str(r.doc_id), r.ids, r.n_tokens, r.round_trip) for r in coded.collect()), key=str)
    assert got == sorted(((str(i), m.encode(t or ""), len(m.encode(t or "")), True) for i, t, _ in rows), key=str)
    back = sorted((str(r.doc_id), r.text) for r in C.decode(coded, PATH).collect())
    assert back == sorted((str(i), (t or "").replace("▁", " ")) for i, t, _ in rows)
    assert C.encode(docs.limit(0), PATH).count() == 0


def test_round_trip_decodes_the_ids_returned():
    m = C.Matcher(C.tables(PATH))
    many = texts(n=40)
    counts, lists, _, same = C.coded(m, many)
    assert same.all() and counts.tolist() == [len(x) for x in lists.to_pylist()]
    encode, m.encode = m.encode, lambda x: encode(x)[::-1]  # ids of another text: a fault in joining
    assert C.coded(m, ["one text", "another"])[3].tolist() == [False, False]
    m.encode = lambda x: [i[2:] for i in encode(x)]  # a lost id
    assert not C.coded(m, ["one text"])[3].any()
