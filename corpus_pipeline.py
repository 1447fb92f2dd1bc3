"""The corpus pipeline: five stages from raw documents to piece ids.

Each stage takes what its predecessor kept, written as Parquet and read again,
and returns the columns of ``documents``; the last returns the encoded rows.
``run`` applies them to the ``documents`` table.

1. ``language_id``: documents without a language go (null or letterless texts,
   and texts in which nothing of a learned language occurs).
2. ``near_dedup``: one document of each group of near-duplicates stays (word
   shingles of five, similarity of 0.8 and more).
3. ``decontamination``: documents with a window of ten benchmark words go.
4. ``secret_scan``: every finding is replaced by ``[SECRET]``; ``n_chars``
   follows the text.  No document goes.
5. ``sentencepiece``: doc_id, n_pieces, ids, and the digest of the text decoded
   from the ids.

SQL can express neither the trained classifier nor the piece ids, so
``ORACLE_SQL`` is None and the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoseries.llm import decontamination, langid, minhash, secrets, sentencepieces
from geoseries.session import cut_lineage, drop_staged

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_unidentified(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.mask(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encode(docs, forms=("ids", "text"))
    return encoded.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_pieces"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminate),
          ("secret_scan", secret_scan), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut_lineage(stage(spark, docs, sf_dir), name)
        drop_staged(before)
    return STAGES[-1][1](spark, docs, sf_dir)
