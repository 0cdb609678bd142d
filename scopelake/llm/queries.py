"""The registered queries of this package; each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embed_dedup, licenses, mixing, periodic, pii, resample, rollup, simhash, sp_codec, token_files, toxicity, urls
from .common import cut, work_path


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are loaded with a guess of their tokens, loaded once more by mistake, withdrawn again, and revised to exact
    counts; every batch is sent twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = {v: public_tokenizers.path(f"{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    exact = cut(rollup.token_counts(docs, files, public_tokenizers.PATTERN))
    guess = exact.withColumn("n_tokens", F.ceil(F.col("n_chars") / 4))
    kept = rollup.Rollup(spark, work_path(spark, "rollup"))
    for _ in range(2):
        kept.commit("load", rollup.inserts(guess))
        kept.commit("mistake", rollup.inserts(exact))
        kept.commit("withdraw", rollup.deletes(exact))
        kept.commit("count", rollup.revisions(guess, exact))
    return kept.totals()


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mixing.rates(docs, mixing.quality_domains(labels), mixing.TARGETS)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = work_path(spark, "token-files")
    token_files.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read(token_files.keys_of(docs), path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), urls.fit(urls.labelled_urls(spark)))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda of: F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, chosen by the crc32 of the id, gets a periodic tail first."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("__echo", F.when(h % 10 == 0, F.floor(h / 10)))
    found = periodic.collapse(docs, seed="__echo").withColumn("top", periodic.longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    exponent = F.floor(F.col("top.length") * 1000 / F.col("top.period")).alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.*", exponent, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_mixing, op3_toxicity, op4_sentencepiece, op5_nearest_neighbours, op6_token_files, op7_simhash_near_dedup, op8_url_filters, op9_license_scans, op10_embedding_near_dedup, op11_pii, op12_resampling, op13_periodic_runs)}
ORACLES: dict[str, str] = {}
