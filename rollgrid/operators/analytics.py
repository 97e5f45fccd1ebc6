"""Attendance rates and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRESENT = "Present"


def attendance_counts(attendance: DataFrame, key: str) -> DataFrame:
    """Rows and present rows per person; partial sums are taken before the shuffle."""
    return attendance.groupBy(F.col(key).alias("person_key")).agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(F.col("status") == PRESENT).alias("rows_present"),
    )


def attendance_detail(people: DataFrame, attendance: DataFrame, key: str) -> DataFrame:
    """Total, present, absent and rate per person; people without rows stay with zeros.

    The fact side is reduced to one row per person before it meets the people table, so the
    join never carries facts and a person with very many rows costs one partial row per task.
    """
    counts = attendance_counts(attendance, key)
    total = F.coalesce("rows_total", F.lit(0))
    present = F.coalesce("rows_present", F.lit(0))
    return people.join(counts, people["id"] == counts["person_key"], "left").select(
        *[people[c] for c in people.columns],
        total.alias("total"),
        present.alias("present"),
        (total - present).alias("absent"),
        F.when(total == 0, F.lit(0.0)).otherwise(100.0 * present / total).alias("rate"),
    )


def attendance_rate(people: DataFrame, attendance: DataFrame, key: str) -> DataFrame:
    return attendance_detail(people, attendance, key).drop("absent")


def most_absent(rates: DataFrame) -> DataFrame:
    """The person with the lowest rate, lowest id on ties; no row for empty input."""
    row = F.struct(*[F.col(c) for c in rates.columns])
    best = rates.agg(F.min_by(row, F.struct("rate", "id")).alias("best"))
    return best.filter("best IS NOT NULL").select("best.*")


def gallery_counts(gallery: DataFrame) -> DataFrame:
    """Live rows per school (role NULL) and per school and role, in one pass."""
    live = gallery.filter(~F.col("deleted"))
    return live.groupingSets(
        [[F.col("school_id")], [F.col("school_id"), F.col("role")]],
        F.col("school_id"), F.col("role"),
    ).agg(F.count(F.lit(1)).alias("n_live"))


def summarize(report: DataFrame) -> DataFrame:
    """Rows per verdict of an import report."""
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))
