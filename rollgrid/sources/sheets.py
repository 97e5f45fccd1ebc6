"""CSV exports of import sheets: every cell is text and every row knows its place in the sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRST_DATA_ROW = 2
_PART_BITS = 33


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The sheet with ``row_no`` (first data row = 2, as a person reading the sheet counts)."""
    rows = spark.read.option("header", True).option("multiLine", False).csv(path)
    return number_source_rows(rows)


def number_source_rows(rows: DataFrame, first: int = FIRST_DATA_ROW) -> DataFrame:
    """Numbers rows in file order from the rows per read task.

    ``monotonically_increasing_id`` holds the task in its upper bits and the place inside the task
    below; the rows of all earlier tasks are added as an offset, one small row per task.
    """
    marked = rows.withColumn("_at", F.monotonically_increasing_id())
    parts = marked.groupBy(F.shiftright("_at", _PART_BITS).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.col("_at") - F.shiftleft(F.col("_part"), _PART_BITS)
    return marked.withColumn("_part", F.shiftright("_at", _PART_BITS)).join(offsets, "_part").select(
        *rows.columns, (F.col("_before") + inside + first).alias("row_no"))
