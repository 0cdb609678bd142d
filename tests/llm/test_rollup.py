from collections import Counter

import public_tokenizers as P
from pyspark.sql import functions as F

from scopelake.llm import rollup as R
from scopelake.llm.common import work_path

FILES = {"byte_bpe_50k": P.path("byte_bpe_50k.tiktoken"), "byte_bpe_multi_50k": P.path("byte_bpe_multi_50k.tiktoken")}


def encoders():
    return {v: R._rank_counter(p, P.PATTERN)() for v, p in FILES.items()}


def brute(rows):
    enc, out = encoders(), Counter()
    for _, text, lang, source, _ in rows:
        for v, e in enc.items():
            out[source, lang, v, "d"] += 1
            out[source, lang, v, "t"] += len(e(text or ""))
            out[source, lang, v, "c"] += len(text or "")
    return {k[:3]: (out[*k[:3], "d"], out[*k[:3], "t"], out[*k[:3], "c"]) for k in out}


def totals(roll):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens, r.n_chars) for r in roll.totals().collect()}


ROWS = [(i, f"Some text number {i}, with words — and ümlauts <|endoftext|>. " * (i % 5), "en" if i % 2 else None, f"s{i % 3}", 7) for i in range(40)] + [(100, None, "de", None, None), (3, "twice", "en", "s0", 1), (101, "w " * 50000, "en", "s0", 1)]


def test_deltas_follow_the_corpus(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_docs long")
    counts = R.token_counts(docs, FILES, P.PATTERN)
    roll = R.Rollup(spark, work_path(spark, "r"))
    assert totals(roll) == {} and not roll.has("a")
    assert roll.commit("a", R.inserts(counts))
    assert totals(roll) == brute(ROWS)
    assert not roll.commit("a", R.inserts(counts)) and not roll.commit("a", R.deletes(counts))  # known: nothing changes
    assert totals(roll) == brute(ROWS)
    assert roll.commit("b/ü", R.deletes(counts.filter("doc_id < 10")))
    assert totals(roll) == brute([r for r in ROWS if r[0] >= 10])
    assert roll.commit("none", R.inserts(counts.limit(0))) and roll.has("none")
    later = R.Rollup(spark, roll.path).compact(work_path(spark, "r"))
    assert totals(later) == totals(roll) and not later.commit("b/ü", R.inserts(counts))
    assert later.commit("rest", R.deletes(counts.filter("doc_id >= 10"))) and totals(later) == {}


def test_revisions_and_whole_states(spark):
    docs = spark.createDataFrame([r for r in ROWS if r[0] != 3 or r[1] != "twice"], "doc_id long, text string, lang string, source string, n_docs long")
    counts = R.token_counts(docs, FILES, P.PATTERN).cache()
    guess = counts.withColumn("n_tokens", F.col("n_chars")).withColumn("source", F.lit("unknown"))
    roll = R.Rollup(spark, work_path(spark, "r"))
    roll.commit("guess", R.inserts(guess))
    roll.commit("exact", R.revisions(guess, counts))
    want = brute([r for r in ROWS if r[1] != "twice"])
    assert totals(roll) == want
    other = counts.filter("doc_id <> 5").withColumn("lang", F.when(F.col("doc_id") == 6, "xx").otherwise(F.col("lang")))
    roll.commit("next", R.changes(counts, other))
    fresh = R.Rollup(spark, work_path(spark, "r"))
    fresh.commit("all", R.inserts(other))
    assert totals(roll) == totals(fresh) and R.changes(counts, counts).count() == 0
