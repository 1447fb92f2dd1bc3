"""Registered queries of the operators: thin digests of each operator's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoseries.llm import decontamination, langid, lmscore, minhash, mixing, recompression, secrets, sentencepieces, sharding, syncmers, tokencount, trie, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those not held out."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 2-word shingle sets are 80 % alike, over all documents."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, by a planned slot map."""
    placed = sharding.shard(_table(spark, sf_dir, "documents"), n_shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of all documents and of their edits."""
    return syncmers.compare_edited(_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the text decoded from them, as digests."""
    encoded = sentencepieces.encode(_table(spark, sf_dir, "documents"), forms=("packed", "text"))
    return encoded.select("doc_id", (F.octet_length("packed") / 4).cast("long").alias("n_pieces"), F.sha2("packed", 256).alias("ids_sha256"),
                          F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"), "n_chunks")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, with ownership counted over all sources."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in all documents."""
    found = decontamination.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontamination.report(found)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of all documents against those labelled good."""
    return lmscore.cross_entropy_difference(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 50 words and more removed from all documents."""
    return recompression.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents under the byte-level BPE, flagged beyond 512."""
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the near word each is taken for."""
    return variants.group_variants(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, rebuilt, with subtree totals."""
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of all words takes of each document."""
    return mixing.taken(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_minhash_dedup, op3_sharding, op4_fingerprints, op5_sentencepiece, op6_secrets,
                                   op7_decontamination, op8_lm_score, op9_substring_dedup, op10_token_counts,
                                   op11_spelling_variants, op12_prefix_trie, op13_source_mix)}
