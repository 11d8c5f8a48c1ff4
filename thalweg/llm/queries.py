"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, merkle, mixing, neardup, packing, resample, secrets, sharding, tokenbin, topk, toxicity, urls
from .common import doc_crc, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of every document, read back."""
    return tokenbin.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter of the ids is held out of training."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(doc_crc(), F.lit(4)) == 2, F.lit(False))
    found = langid.predict(docs, langid.fit(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth of the ids is held out of training."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(doc_crc(), F.lit(5)) == 0, F.lit(False))
    found = toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of every document: three-word shingles, similarity 0.85."""
    return neardup.groups(table(spark, sf_dir, "documents"), 3, 85)


#: The rules of op6.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for each query vector; queries are the ids divisible by 100."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of near-equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, and its place in the draw."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether it verifies after some were tampered with."""
    return merkle.audit(table(spark, sf_dir, "documents"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_token_ids": op1_token_ids,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_near_dedup": op5_near_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_exact_topk": op7_exact_topk,
    "op8_secrets": op8_secrets,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_source_mixing": op13_source_mixing,
}

ORACLES: dict[str, str] = {"op5_near_dedup": neardup.ORACLE, "op7_exact_topk": topk.ORACLE, "op9_sharding": sharding.ORACLE, "op11_importance_resampling": resample.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
