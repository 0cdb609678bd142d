"""A corpus pipeline: toxic documents go, one of each group of near-duplicates stays, the mix is drawn to its target
weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and reads
it again as the docs of the next, so a lost executor never costs more than the stage at work.

Edge cases, as the stages have them: a null text counts as empty; it is scored and mixed like any text, all empty texts are
copies of each other, and one is encoded to no ids. Rows without an id are scored, and stay where their group has no
other; rows repeated under one id are copies. Documents that no label names are scored all the same; without labels of
both classes nothing is toxic, and without quality labels documents are mixed by equal posteriors. Very long texts are
whole everywhere. An empty table runs through to an empty result. Further columns are kept up to the last stage, which
returns doc_id, lang and source with the ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scopelake.llm import mixing, simhash, sp_codec
from scopelake.llm import toxicity as tox
from scopelake.llm.common import work_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    return tox.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group."""
    return simhash.kept(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says."""
    labelled = mixing.quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mixed(docs, labelled, mixing.TARGETS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and source with the ids of each text."""
    return sp_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "lang", "source"])


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", simhash_near_dedup), ("mixing", mix), ("sentencepiece", sentencepiece)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = work_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
