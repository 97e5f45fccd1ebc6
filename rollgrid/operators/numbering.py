"""Gap-free row numbers that no single task has to produce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollgrid import session


def number_rows(df: DataFrame, keys: list[str], order_by: list[str | Column], as_col: str, parts: int | None = None) -> DataFrame:
    """Adds ``as_col`` = 1, 2, … per key in the given order (columns of any type, rising, or falling as ``F.desc``).

    ``row_number`` over a key that owns a third of all rows is one task. Here the rows are cut into ranges of
    (keys, order), at quantiles that Spark samples, so outliers and hot keys make no large range. The cut rows are
    written once; rows are counted per key and range, and numbered inside their range on top of the ranges before it.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    cut = df.repartitionByRange(parts or session.task_count(df.sparkSession), *keys, *order)
    ranged = session.written(cut.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_of_range"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_of_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return numbered.join(offsets, same).select(
        *df.columns, (F.col("_offset") + F.col("_rank")).cast("bigint").alias(as_col))
