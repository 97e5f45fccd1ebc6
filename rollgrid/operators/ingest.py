"""Roster and timetable import with one verdict per row (IO1-IO3).

The rules are column expressions over all rows at once; the reference tables are joined in, and the
first broken rule names the error. Accepted rows and the report come from one judged frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid import schemas
from rollgrid.functions.clock import clock_is_bad, clock_minutes, is_blank, stripped
from rollgrid.operators.bookings import DAY, WEEK, conflict_flag, earlier_overlap
from rollgrid.operators.directory import resolve, split_existing
from rollgrid.session import written

OK, SKIP, FAIL = "ok", "skip", "fail"
REPORT = ("row_no", "status", "error")


def require_columns(rows: DataFrame, names: tuple[str, ...]) -> None:
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def _trimmed(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return rows.withColumns({n: stripped(n) if n in rows.columns else F.lit(None).cast("string") for n in names})


def _first_rule(rules: list[tuple[Column, str, Column]]) -> tuple[Column, Column]:
    """Ordered (test, status, error) rules to a status and an error column."""
    status, error = F.lit(OK), F.lit(None).cast("string")
    for test, verdict, text in reversed(rules):
        status = F.when(test, verdict).otherwise(status)
        error = F.when(test, text).otherwise(error)
    return status.alias("status"), error.alias("error")


def _blank_rules(names: tuple[str, ...]) -> list[tuple[Column, str, Column]]:
    return [(is_blank(F.col(n)), FAIL, F.lit(f"{n} is blank")) for n in names]


def _fail_repeats(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Of several acceptable rows with one key the first stays ``ok``."""
    firsts = judged.filter(F.col("status") == OK).groupBy(*keys).agg(F.min("row_no").alias("_first"))
    late = (F.col("status") == OK) & (F.col("row_no") > F.col("_first"))
    return judged.join(firsts, keys, "left").withColumns({
        "error": F.when(late, "duplicate in file").otherwise(F.col("error")),
        "status": F.when(late, FAIL).otherwise(F.col("status")),
    }).drop("_first")


def _import_people(rows, branches, departments, existing, key, required, optional, lists=()):
    require_columns(rows, required)
    clean = _trimmed(rows, required + optional)
    known = resolve(clean, branches, {"branch": "name"}, "branch_id")
    known = resolve(known, departments, {"department": "name"}, "department_id")
    known = split_existing(known, existing, ["branch_id", key])
    rules = [
        (F.col("branch_id").isNull(), FAIL, F.concat(F.lit("unknown branch: "), F.coalesce("branch", F.lit("")))),
        *_blank_rules(tuple(n for n in required if n != "branch")),
        (F.col("stored"), SKIP, F.lit(None).cast("string")),
    ]
    status, error = _first_rule(rules)
    judged = _fail_repeats(known.withColumns({"status": status, "error": error}), ["branch_id", key])
    as_list = {c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")) for c in lists}
    accepted = judged.filter(F.col("status") == OK).withColumns(as_list).select(
        "branch_id", "department_id", *[n for n in required if n != "branch"], *lists)
    return accepted, judged.select(*REPORT)


def import_teachers(rows: DataFrame, branches: DataFrame, departments: DataFrame, existing: DataFrame):
    """``(accepted, report)``; pass the tables of one organization. ``rows`` needs ``row_no``."""
    return _import_people(rows, branches, departments, existing, "employee_id", schemas.TEACHER_SHEET,
                          schemas.TEACHER_SHEET_OPTIONAL, lists=("subjects", "can_teach_classes"))


def import_students(rows: DataFrame, branches: DataFrame, departments: DataFrame, existing: DataFrame):
    return _import_people(rows, branches, departments, existing, "roll_no", schemas.STUDENT_SHEET,
                          schemas.STUDENT_SHEET_OPTIONAL)


def import_timetable(
    rows: DataFrame, branches: DataFrame, teachers: DataFrame, classes: DataFrame, bookings: DataFrame,
    check_batch: bool = False,
):
    """``(accepted, report, new_classes)`` for the timetable sheet of one organization.

    Overlaps are checked against stored bookings; ``check_batch`` also fails a row that overlaps an
    earlier acceptable row of the same file.
    """
    require_columns(rows, schemas.TIMETABLE_SHEET)
    clean = _trimmed(rows, schemas.TIMETABLE_SHEET).withColumns({
        DAY: F.initcap(DAY),
        "start_min": clock_minutes(F.col("start_time")),
        "end_min": clock_minutes(F.col("end_time")),
    })
    known = resolve(clean, branches, {"branch": "name"}, "branch_id")
    known = resolve(known, teachers, {"teacher_employee_id": "employee_id"}, "teacher_id")
    on_class = {"branch_id": "branch_id", "class_name": "class_name", "section": "section"}
    known = resolve(known, classes, on_class, "school_class_id")
    known = conflict_flag(known, bookings, ["teacher_id", DAY], "_teacher_busy", odd_rows=False)
    known = conflict_flag(known, bookings, ["school_class_id", DAY], "_class_busy", odd_rows=False)

    nothing = F.lit(None).cast("string")
    rules = [
        (F.col("branch_id").isNull(), FAIL, F.concat(F.lit("unknown branch: "), F.coalesce("branch", F.lit("")))),
        *[(clock_is_bad(F.col(c)), FAIL, F.lit(f"bad {c}")) for c in ("start_time", "end_time")],
        (reduce(lambda a, b: a | b, [is_blank(F.col(c)) for c in ("subject", DAY, "teacher_employee_id")]),
         SKIP, nothing),
        (~F.col(DAY).isin(*WEEK), FAIL, F.concat(F.lit("unknown day: "), F.col(DAY))),
        (F.col("teacher_id").isNull(), FAIL,
         F.concat(F.lit("unknown teacher: "), F.col("teacher_employee_id"))),
        (F.col("start_min").isNull() | F.col("end_min").isNull(), FAIL, F.lit("start and end are required")),
        (F.col("start_min") >= F.col("end_min"), FAIL, F.lit("start is not before end")),
        (F.col("_teacher_busy"), FAIL, F.lit("teacher is booked")),
        (F.col("_class_busy"), FAIL, F.lit("class is booked")),
    ]
    status, error = _first_rule(rules)
    judged = known.withColumns({"status": status, "error": error})
    if check_batch:
        judged = written(judged, "judged")  # read several times below
        ok = F.col("status") == OK
        for keys, text in ((["teacher_id", DAY], "teacher is booked in this file"),
                           (["branch_id", "class_name", "section", DAY], "class is booked in this file")):
            judged = earlier_overlap(judged, keys, "row_no", "_late", ok)
            judged = judged.withColumns({
                "error": F.when(F.col("_late") & F.col("error").isNull(), text).otherwise(F.col("error")),
                "_failed": F.coalesce("_failed", F.lit(False)) | F.col("_late")
                if "_failed" in judged.columns else F.col("_late"),
            }).drop("_late")
        judged = judged.withColumn("status", F.when(F.col("_failed"), FAIL).otherwise(F.col("status")))
    accepted = judged.filter(F.col("status") == OK).select(
        "branch_id", "teacher_id", "school_class_id", "class_name", "section", "subject", DAY,
        "start_min", "end_min")
    new_classes = judged.filter("branch_id IS NOT NULL AND school_class_id IS NULL").select(
        "branch_id", "class_name", "section").distinct()
    return accepted, judged.select(*REPORT), new_classes
