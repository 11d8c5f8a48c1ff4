"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. run() writes each stage's result as Parquet in the shared folder
and reads it again as the next one's input.

Cases: a null text is rejected by the language stage, since it has no letter; every row is
kept or dropped by its own text, also where rows share a doc_id or have none; of equal rows
one stays, and of a group the row of the smallest id, rows without an id coming last; an
empty table goes through; columns beside those of documents are carried along.
"""

from __future__ import annotations

import atexit

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm import decontam, langid, neardup, packing, secrets
from thalweg.llm.common import checkpoints_dropped, columns_of, cut, drop_folder, scratch, shuffles_dropped, table

#: Words in a shingle and the similarity, in percent, of near duplicates.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that the model rejects go. It learns from the rows' own labels."""
    return langid.accepted(docs, langid.fit(docs))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of each row by its id and text, and that column's name. Equal rows share it."""
    name = "_row_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.withColumn(name, F.xxhash64("doc_id", "text")), name


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    keyed, key = _keyed(docs)
    found = neardup.groups(keyed.select(F.col(key).alias("doc_id"), "text"), SHINGLE, PERCENT).select("doc_id", "component_id").distinct()
    ids = keyed.select(F.col(key).alias("k"), F.col("doc_id").alias("id")).groupBy("k").agg(F.min("id").alias("id"), F.count("*").alias("copies"))  # united before they are sent
    rows = cut(ids.join(found.withColumnRenamed("doc_id", "k"), "k"))
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k")).alias("f"))
    gone = cut(rows.join(first.select(F.col("f.k").alias("k")), "k", "left_anti").select("k"))
    repeated = cut(rows.where("copies > 1").join(gone, "k", "left_anti").select("k"))
    once = keyed.join(gone.unionByName(repeated).withColumnRenamed("k", key), key, "left_anti")
    # Equal rows may differ in columns beside id and text: that which is the smallest as JSON stays.
    again = keyed.join(repeated.withColumnRenamed("k", key), key, "left_semi").select(F.struct(*columns_of(docs)).alias("own"))
    one = again.groupBy("own.doc_id", "own.text").agg(F.min_by("own", F.to_json("own")).alias("own")).select("own.*")
    return once.select(*columns_of(docs)).unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    keyed, key = _keyed(docs)
    found = decontam.contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(cut(found.select(F.col("doc_id").alias(key)).distinct()), key, "left_anti").select(*columns_of(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced; n_chars follows the new text."""
    masked = secrets.mask(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

#: The stages are not expressible in SQL; tests hold run() against a version by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    folder = scratch(spark, "pipeline")
    atexit.register(_drop, spark, folder)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with checkpoints_dropped(spark):
            made = stage(spark, docs, sf_dir)
            with shuffles_dropped(spark):
                made.write.parquet(f"{folder}/{k}")
        if k:
            drop_folder(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        drop_folder(spark, folder)
    except Exception:  # the session has ended before; its folder is the caller's to clear
        return
