"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import op1_licenses, op2_quality, op3_packing, op4_decontamination, op5_shards, op6_simhash, op7_token_counts, op8_toxicity, op9_urls, op10_token_files, op11_warc, op12_phrases, op13_conversations
from skeinwork.llm.common import work_dir

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = [f"shard-{k:03d}" for k in range(256)]
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_licenses.scan(table(spark, sf_dir, "documents"), least=0.8)


def op2_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op2_quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep_text=False)
    counts = [f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance")]
    return found.select("doc_id", *counts, "kept")


def op3_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_packing.digest(op3_packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, size=2048, end_id=1))


def op4_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_decontamination.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shingle=5, threshold=0.8)


def op5_lookup_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_shards.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op6_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op6_simhash.dedup_ids(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_two_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_token_counts.counts(table(spark, sf_dir, "documents"), PIECE_BPE, limit=4096)


def op8_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_toxicity.score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op9_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = op9_urls.UrlModel(op9_urls.labelled_table(spark))
    return op9_urls.judge(table(spark, sf_dir, "pages"), URL_RULES, model)


def op10_token_files_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_token_files.write_and_read(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0)


def op11_seekable_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    op11_warc.write(table(spark, sf_dir, "pages"), folder, least_bytes=0)
    found = op11_warc.read(spark, folder, payload=False)
    return found.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op12_top_order_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_phrases.collocations(table(spark, sf_dir, "documents"), longest=5, least=100, top=2000)


def op13_checkpointed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_conversations.repair(op13_conversations.damage(table(spark, sf_dir, "conversations")), present="present")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_patience_licenses": op1_patience_licenses,
    "op2_mcd_outliers": op2_mcd_outliers,
    "op3_sum_of_squares": op3_sum_of_squares,
    "op4_minhash_containment": op4_minhash_containment,
    "op5_lookup_shards": op5_lookup_shards,
    "op6_simhash_tiles": op6_simhash_tiles,
    "op7_two_tier_counts": op7_two_tier_counts,
    "op8_noisy_channel": op8_noisy_channel,
    "op9_url_model": op9_url_model,
    "op10_token_files": op10_token_files_,
    "op11_seekable_bundles": op11_seekable_bundles,
    "op12_top_order_phrases": op12_top_order_phrases,
    "op13_checkpointed_repair": op13_checkpointed_repair,
}
ORACLES: dict[str, str] = {"op4_minhash_containment": op4_decontamination.SQL, "op11_seekable_bundles": op11_warc.SQL, "op12_top_order_phrases": op12_phrases.SQL}
