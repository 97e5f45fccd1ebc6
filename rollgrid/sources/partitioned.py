"""Deletes and updates of partitioned tables as writes that touch only the partitions that hold a changed row (M1, M2)."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollgrid import session
from rollgrid.operators import maintenance


def _same(by: list[str]) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return same


def rewrite(spark: SparkSession, path: str, schema: str, by: list[str], touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
    """Replace the partitions (columns ``by``) of the ``touched`` rows by ``change`` of their rows; gives how many there were.

    The new rows are first written to the shared folder, so a run that breaks until then leaves the table as it was. They
    then replace their partitions in one dynamic overwrite, which Spark also stages and moves at the end. A partition that
    loses its last row is overwritten with an empty file. Files of other partitions are neither read nor renamed. All
    steps depend on the table's rows only: after a break the same call ends in the same table. One writer at a time.
    """
    table = spark.read.schema(schema).parquet(path)
    parts = session.written(touched.select([F.col(c).alias(f"_of_{c}") for c in by]).distinct(), "touched")
    count = parts.count()
    if not count:
        return 0
    held = table.join(parts, _same(by), "left_semi")
    folder = F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1)
    folders = session.written(table.select(*by, folder.alias("_folder")).join(parts, _same(by), "left_semi").distinct(), "folders")
    staged = session.written(change(held).select(table.columns), "staged")
    left = staged.select([F.col(c).alias(f"_of_{c}") for c in by]).distinct()
    emptied = [r["_folder"] for r in folders.join(left, _same(by), "left_anti").select("_folder").distinct().collect()]  # one per emptied partition
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    nothing = staged.drop(*by).limit(0)
    for gone in emptied:
        nothing.write.mode("overwrite").parquet(unquote(gone))  # _metadata gives a URI, in which a folder's % is %25
    return count


def delete_rows(spark: SparkSession, path: str, schema: str, by: list[str], keys: DataFrame, column: str = "id") -> int:
    """Delete the rows whose ``column`` is an ``id`` of ``keys``."""
    gone = session.written(keys.select(F.col("id").alias("_gone")).distinct(), "gone")
    table, hit = spark.read.schema(schema).parquet(path), F.col(column) == F.col("_gone")
    return rewrite(spark, path, schema, by, table.join(gone, hit, "left_semi"), lambda rows: rows.join(gone, hit, "left_anti"))


def clear_references(spark: SparkSession, path: str, schema: str, by: list[str], keys: DataFrame, column: str) -> int:
    """Set ``column`` to NULL where it is an ``id`` of ``keys``; ``column`` is no partition column."""
    gone = session.written(keys.select(F.col("id").alias("_gone")).distinct(), "gone")
    table, hit = spark.read.schema(schema).parquet(path), F.col(column) == F.col("_gone")

    def cleared(rows: DataFrame) -> DataFrame:
        kept = F.when(F.col("_gone").isNull(), F.col(column)).alias(column)
        return rows.join(gone, hit, "left").select([kept if c == column else F.col(c) for c in rows.columns])

    return rewrite(spark, path, schema, by, table.join(gone, hit, "left_semi"), cleared)


def update_rows(spark: SparkSession, path: str, schema: str, by: list[str], patches: DataFrame, key: list[str],
                fields: list[str], order: str | None = None) -> int:
    """``maintenance.apply_updates`` on the stored table; ``fields`` are no partition columns."""
    patches = session.written(patches, "patches")
    table = spark.read.schema(schema).parquet(path)
    touched = table.join(patches.select(*key).distinct(), key, "left_semi")
    return rewrite(spark, path, schema, by, touched, lambda rows: maintenance.apply_updates(rows, patches, key, fields, order))


def cascade(spark: SparkSession, tables: dict[str, tuple[str, str, list[str]]], parent: str, keys: DataFrame,
            rules: list[tuple[str, str, str]], set_null: list[tuple[str, str, str]] = ()) -> dict[str, int]:
    """Delete ``parent`` rows and everything below them from stored tables; ``tables``: name to (path, schema, by).

    Rules are as in ``maintenance.cascade_tree``. Everything that goes is found before anything is written, and children go
    before their parents, so a run that breaks and is repeated finds the same parents and ends in the same tables. Gives
    the partitions rewritten per table.
    """
    frames = {name: spark.read.schema(schema).parquet(path) for name, (path, schema, _) in tables.items()}
    gone = {name: session.written(ids, "gone") for name, ids in maintenance.lost_ids(frames, parent, keys, rules).items()}
    changed = {}
    for above, child, column in set_null:
        if above in gone:
            changed[child] = changed.get(child, 0) + clear_references(spark, *tables[child], gone[above], column)
    for name in reversed(list(gone)):
        changed[name] = changed.get(name, 0) + delete_rows(spark, *tables[name], gone[name])
    return changed
