"""Cascading deletes, partial updates and the integrity audit (M1-M3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade_delete(
    tables: dict[str, DataFrame], parent: str, keys: DataFrame,
    cascade: dict[str, str] | None = None, set_null: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Tables after deleting ``parent`` rows whose id is in ``keys``.

    ``cascade`` and ``set_null`` map a child table to its foreign-key column.
    """
    gone = keys.select(F.col("id").alias("_gone")).distinct()
    result = dict(tables)
    result[parent] = tables[parent].join(gone, F.col("id") == F.col("_gone"), "left_anti")
    for child, column in (cascade or {}).items():
        result[child] = tables[child].join(gone, F.col(column) == F.col("_gone"), "left_anti")
    for child, column in (set_null or {}).items():
        rows = result[child]
        kept = F.when(F.col("_gone").isNull(), F.col(column)).alias(column)
        result[child] = rows.join(gone, F.col(column) == F.col("_gone"), "left").select(
            *[kept if c == column else F.col(c) for c in rows.columns]
        )
    return result


def lost_ids(tables: dict[str, DataFrame], parent: str, keys: DataFrame, cascade: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """Ids that go from each table when ``parent`` rows go, parents before children."""
    gone = {parent: keys.select("id").distinct()}
    for above, child, column in cascade:
        if above not in gone:
            continue
        lost = tables[child].join(gone[above].withColumnRenamed("id", "_gone"), F.col(column) == F.col("_gone"), "left_semi").select("id")
        gone[child] = gone[child].union(lost).distinct() if child in gone else lost.distinct()
    return gone


def cascade_tree(
    tables: dict[str, DataFrame], parent: str, keys: DataFrame, cascade: list[tuple[str, str, str]],
    set_null: list[tuple[str, str, str]] = (),
) -> dict[str, DataFrame]:
    """Tables after deleting ``parent`` rows and everything below them, over any number of levels.

    Rules are (parent table, child table, foreign-key column); child tables that are parents themselves have ``id``.
    List a table's cascade rules after those of its own parents. A row goes if any of its parents goes.
    """
    gone = lost_ids(tables, parent, keys, cascade)
    result = dict(tables)
    for name, ids in gone.items():
        result[name] = tables[name].join(ids.withColumnRenamed("id", "_gone"), F.col("id") == F.col("_gone"), "left_anti")
    for above, child, column in set_null:
        if above in gone:
            rows = result[child]
            ids = gone[above].withColumnRenamed("id", "_gone")
            kept = F.when(F.col("_gone").isNull(), F.col(column)).alias(column)
            result[child] = rows.join(ids, F.col(column) == F.col("_gone"), "left").select(
                *[kept if c == column else F.col(c) for c in rows.columns])
    return result


def apply_updates(
    table: DataFrame, patches: DataFrame, key: list[str], fields: list[str], order: str | None = None,
) -> DataFrame:
    """Patched fields replace, absent fields stay.

    ``patches`` has the key columns, the fields, and for every field a boolean ``has_<field>``:
    with it a patch can set NULL on purpose. Put the tenant column into ``key`` to scope a patch. Of several patches
    for one key and field the last by ``order`` wins, the larger value where the order ties or is not given.
    """
    rank = F.col(order) if order else F.lit(0)
    last = lambda f: F.max(F.when(F.col(f"has_{f}"), F.struct(rank.alias("at"), F.col(f).alias("value"))))
    side = patches.groupBy(*key).agg(*[last(f).alias(f"_{f}") for f in fields]).select(
        *key, *[F.col(f"_{f}.value").alias(f"_new_{f}") for f in fields],
        *[F.col(f"_{f}").isNotNull().alias(f"_has_{f}") for f in fields])
    joined = table.join(side, key, "left")
    return joined.select(*[
        F.when(F.coalesce(f"_has_{c}", F.lit(False)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        if c in fields else F.col(c)
        for c in table.columns
    ])


def _counted(rows: DataFrame, table: str, rule: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_violations")).select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "n_violations"
    )


def repeated_keys(df: DataFrame, table: str, keys: list[str], where: Column | None = None) -> DataFrame:
    """Number of keys held by more than one row; ``where`` makes the rule partial."""
    rows = df if where is None else df.filter(where)
    return _counted(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"),
                    table, "unique " + ",".join(keys))


def failed_rows(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """Rows per broken row-level rule, every rule counted in one scan."""
    sums = df.agg(*[F.count_if(test).alias(f"r{i}") for i, test in enumerate(rules.values())])
    pairs = [F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("n")) for i, rule in enumerate(rules)]
    return sums.select(F.explode(F.array(*pairs)).alias("p")).select(
        F.lit(table).alias("table_name"), F.col("p.rule").alias("rule"), F.col("p.n").alias("n_violations")
    )


def dangling(df: DataFrame, table: str, column: str, parent: DataFrame, parent_col: str = "id") -> DataFrame:
    """Rows whose foreign key is set but has no parent."""
    keys = parent.select(F.col(parent_col).alias("_parent")).distinct()
    orphans = df.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent"), "left_anti")
    return _counted(orphans, table, f"dangling {column}")


def exactly_one(*columns: str) -> Column:
    """Violation test: not exactly one of the columns is set."""
    return sum(F.col(c).isNotNull().cast("int") for c in columns) != 1


def union_report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
