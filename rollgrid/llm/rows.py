"""Helpers of several operators: written intermediates, words in column expressions, offsets in groups."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollgrid import session

#: White space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


#: Setting under which Spark removes the shuffle files of a statement when it ends, not only once the driver collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and still there when an executor is lost.

    The table stands for the work before it, so the shuffle files that led to it are freed at once.
    """
    spark = df.sparkSession
    path = session.fresh_path(spark, label)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def blocks_for(rows: int) -> int:
    """As many blocks as a block has rows, so that neither the blocks nor a block are many at any size."""
    return max(1, math.isqrt(max(rows, 1)))


def block_of(rank: Column, bits: int, blocks: Column | int) -> Column:
    """Block of a hashed rank of ``bits`` bits; a higher rank is never in a lower block."""
    return F.floor(rank.cast("double") / F.lit(float(1 << bits)) * blocks).cast("long")


def running_before(group: list[str], order: list[str], amount: str) -> Column:
    """Sum of ``amount`` over the earlier rows of the group."""
    over = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(over), F.lit(0))


#: Columns of a documents table that operators know.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(docs: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``apply(docs)`` with the columns of ``docs``, whatever their names: others than the known ones are set aside."""
    aside = {c: f"other_column_{i}" for i, c in enumerate(docs.columns) if c not in KNOWN}
    out = apply(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
