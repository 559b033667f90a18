"""The queries opN_<name> over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, decontaminate, jaccard, licenses, oracle, pii, quality, shards, substring, suffix_tree, toxicity
from weft.llm.common import documents, id_crc

#: The public vocabularies that the queries use.
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _is(value: str) -> Callable[[Column], Column]:
    return lambda x: x == value


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    count = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return out.select("doc_id", *count, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, toxicity.training(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = toxicity.score(docs, model)
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return out.select("doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", predicted.alias("predicted"), "evidence", F.size("passages").alias("n_passages"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op4_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = {"n_chars": shards.log_scale(F.col("n_chars")), "lang": shards.category(F.col("lang"))}
    out = shards.shards(documents(spark, sf_dir), dims, leaves=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(documents(spark, sf_dir), BPE_RANKS, public_tokenizers.PATTERN))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = id_crc(F.col("doc_id")) % 7 == 2
    out = suffix_tree.score(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(documents(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op9_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), BPE_RANKS, public_tokenizers.PATTERN, PIECES)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = decontaminate.by_document(docs, found)
    spans = F.transform("hits", lambda h: F.concat_ws(":", h["item_id"].cast("string"), h["start"].cast("string"), h["end"].cast("string"), h["edits"].cast("string")))
    items = F.array_distinct(F.transform("hits", lambda h: h["item_id"]))
    return out.select("doc_id", "contaminated", F.size(items).cast("long").alias("n_items"), F.array_join(items.cast("array<string>"), ",").alias("items"), F.array_join(spans, ",").alias("spans"))


# --- parts of the above that SQL can express: what the methods add is left out ----


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pii_weak_supervision(spark, sf_dir).drop("spans")


def shard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law of op4: all rows and bytes, 8 shards of nearly equal size, slots
    without gaps, copies together."""
    out = op4_kd_tree_shards(spark, sf_dir)
    by = out.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b"), (F.max("slot") + 1 - F.count_distinct("slot")).alias("gaps"))
    copies = out.groupBy("text_crc32", "size").agg(F.count_distinct("shard").alias("k")).where("k > 1").agg(F.count("*").alias("split_copies"))
    # A cut leaves up to about one document on the wrong side; two cuts above it do, too.
    even = F.max("b") - F.min("b") <= F.lit(4) * out.agg(F.max("size")).scalar()
    return by.agg(F.sum("n").alias("n_rows"), F.sum("b").alias("bytes"), F.count("*").alias("shards"), F.sum("gaps").alias("gaps"), even.alias("near_equal")).withColumn("split_copies", copies.scalar())


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_kd_tree_shards(spark, sf_dir).select("doc_id", "size", "text_crc32", "law")


def bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def language_model_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op7_suffix_tree_lm(spark, sf_dir)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_tokeniser_fertility(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


PARTS = (pii_base, shard_totals, shard_sizes, bpe_decoded, language_model_base, license_base, quality_base)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return own | {f.__name__: f for f in PARTS}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.ORACLE)
