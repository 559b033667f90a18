"""From raw documents to token ids: five stages over whole tables.

Each stage takes all rows that the one before it kept; an empty table passes
through all of them.  Columns beyond those of documents are carried along.  A stage
with Python workers that follows another first frees the executors' heaps.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, decontaminate, jaccard, pii, toxicity
from weft.llm.common import documents, forget, named, relieve, written

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.  Null and empty texts stay;
    rows that repeat are judged alike; other columns stay as they are; without
    labels nothing goes."""
    labels = toxicity.training(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep(docs, toxicity.learn(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard similarity of at least 0.8 on five words,
    the least id stays.  Null and empty texts and rows without id stay; rows that
    share an id stay or go together; other columns stay as they are."""
    relieve(spark)
    return jaccard.keep_first(docs, percent=80, width=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.  Null and empty texts stay; rows
    that share an id, null too, go together; other columns stay as they are; an
    empty benchmark takes nothing."""
    relieve(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become their kind in brackets; n_chars follows.  Every row
    stays; null texts stay null, with a null n_chars; other columns stay as they
    are."""
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text that they decode to, beside the other columns (but
    for those named ids or n_tokens, which give way).  Every row stays; null texts
    become empty ones without ids."""
    relieve(spark)
    extra = tuple(c for c in docs.columns if c not in ("doc_id", "text", "ids", "n_tokens"))
    out = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, extra=extra)
    return out.select("doc_id", *map(named, extra), F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("pii", mask_personal),
    ("byte_bpe", encode),
]

#: Learnt models and iterated joins: no SQL for the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir))
        forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
