import random

import pytest
import sentencepiece

import corpus_pipeline
from scopelake.llm import toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(4)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 7))) for _ in range(400)]
    junk = ["".join(r.choice("xzqkw") for _ in range(5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(600):
        kind = "toxic" if i % 6 == 0 else "low" if i % 6 == 1 else "high"
        text = [r.choice(junk if kind == "low" else words) for _ in range(r.randint(30, 80))]
        if kind == "toxic":
            for _ in range(4):
                text.insert(r.randrange(len(text)), r.choice(["zorgal", "idiot", "moron"]))
        docs.append((i, " ".join(text), "en", f"s{i % 3}", 1))
        labels.append((i, int(kind != "low"), int(kind == "toxic")))
    docs += [(1000 + i, docs[2][1], "en", "s0", 1) for i in range(30)] + [(2000, None, "en", "s0", 0), (2001, "", "en", "s0", 0), (None, "words without an id", None, None, None)]
    base = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels[::2] + labels[1::4], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, {d: (t, k) for (d, t, *_), k in zip(docs, ["toxic", "low", "high", "high", "high", "high"] * 100)}


def test_run(spark, folder):
    base, truth = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "mixing", "sentencepiece"]
    rows = corpus_pipeline.run(spark, base).collect()
    m = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    count = {}
    for r in rows:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
        if r.doc_id in truth:
            assert r.ids == m.encode(truth[r.doc_id][0] or "") and r.round_trip
    for kind, least, most in (("toxic", 0, 0.1), ("low", 0, 0.6), ("high", 0.98, 1)):
        ids = [i for i, (_, k) in truth.items() if k == kind]
        assert least <= sum(i in count for i in ids) / len(ids) <= most, kind
    assert not any(1000 <= (i or 0) < 1030 for i in count)  # copies of document 2


def test_stages_keep_the_columns(spark, folder):
    base, _ = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(50), base).columns == docs.columns
    assert toxicity.without_toxic(docs.limit(0), spark.read.parquet(f"{base}/labels.parquet")).count() == 0


def test_an_empty_table_runs_through(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    assert corpus_pipeline.run(spark, base).collect() == []
