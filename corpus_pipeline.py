"""From raw documents to packed training sequences, each stage reading what the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollgrid.llm import mixing, near_duplicates, packing, rows, secrets, toxicity

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None

TOKENIZER, CLOSING_ID, CONTEXT = "word_bpe_49k.json", 2, 4096
#: Jaccard of near copies in per cent, and chunks of MinHash values with which a pair at that shares no key with a chance of 8e-6.
NEAR, NEAR_CHUNKS = 80, 11
#: Sources are evened out as far as no document is drawn more than twice, and each at least once.
MIX = mixing.Target(budget=None, entropy=0.97, repetition=2.0)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold of their language."""
    labels = rows.labels(spark, sf_dir)
    return rows.shielded(docs, lambda d: toxicity.assess(d, labels, d.columns).where(~F.col("rejected")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the smallest id."""
    return rows.shielded(docs, lambda d: near_duplicates.keep_one(d, NEAR, NEAR_CHUNKS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with all secrets in its text masked and its length counted anew."""
    return rows.shielded(docs, secrets.masked)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources again as their weight asks, stored in the mixed order, which packing keeps."""
    return rows.shielded(docs, lambda d: mixing.in_order(mixing.mix(d, MIX)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), CLOSING_ID, CONTEXT)


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets),
    ("mixing", mix_sources), ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = rows.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = rows.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
