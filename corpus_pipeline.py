"""A training corpus from ``documents``: each stage is written as Parquet and read again by the next.

Language ID rejects texts without a language, exact dedup and SimHash near-dedup keep one document
of each group, mixing repeats documents so that all sources weigh the same, and byte-level BPE
encodes what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlens.llm import bpe, exact_dedup, language_id, mixing, simhash_dedup
from plotlens.session import drop_staged, staged, staging_scope


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; null texts and texts without letters go, repeated rows and ids stay apart. An empty table stays empty."""
    return language_id.keep_known(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text without white space: the longest, then the smallest id; a null id is larger than any other. An empty table stays empty."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (0.92 of their words in common, told from five-word shingles): that of the smallest id; ties and repeated rows leave one. An empty table stays empty."""
    return simhash_dedup.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated so that all sources weigh the same; nulls and ties as in ``mixing.mix``. An empty table stays empty."""
    return mixing.mix(docs, copy_col=None)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row that is left; repeated rows are encoded each. An empty table stays empty."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = bpe.encode(docs, ranks, decoded=True)
    return out.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: Language ID, XXH64 and BPE have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; extra columns go through to the last stage, whatever they are called."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with staging_scope():  # what a stage staged for itself goes when it is written
            before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        if hasattr(before, "staged_path"):
            drop_staged(before)
    return docs
