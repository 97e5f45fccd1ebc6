"""Tenant scope, directory search, listings, paging and key lookups.

Broadcast decisions are left to Spark, which checks the size of a side before it broadcasts it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid.functions.clock import stripped
from rollgrid.operators.numbering import number_rows
from rollgrid.operators.ranks import OrderIndex

# What a filter sends when nothing is chosen.
IGNORED_BRANCH = ("", "undefined", "null")
IGNORED_TEXT = ("", "undefined")
DIRECTORY_PAGE = 10
TIMETABLE_PAGE = 50
TIMETABLE_PAGE_MAX = 200


def scope(df: DataFrame, branches: DataFrame, org_id: int, branch_col: str = "branch_id") -> DataFrame:
    """Rows whose branch belongs to the organization."""
    mine = branches.filter(F.col("organization_id") == org_id).select(F.col("id").alias(branch_col))
    return df.join(mine, branch_col, "left_semi").select(df.columns)


def lookup(df: DataFrame, branches: DataFrame, org_id: int, row_id) -> DataFrame:
    """One row by id, nothing when it belongs to another organization."""
    return scope(df.filter(F.col("id") == row_id), branches, org_id)


def _starts_with(column: str, text: str | None) -> Column | None:
    if text is None or text.strip() in IGNORED_TEXT:
        return None
    return F.lower(column).startswith(F.lower(F.lit(text)))


def _branch_number(branch) -> int | None:
    if branch is None or str(branch).strip() in IGNORED_BRANCH:
        return None
    text = str(branch).strip()
    return int(text) if text.isdecimal() else None


def search_directory(
    df: DataFrame, name: str | None = None, key: str | None = None, class_name: str | None = None,
    branch=None, key_col: str = "roll_no",
) -> DataFrame:
    """Case-insensitive prefixes; a blank, placeholder or non-numeric branch is ignored."""
    number = _branch_number(branch)
    tests = [
        _starts_with("name", name),
        _starts_with(key_col, key),
        _starts_with("class_name", class_name),
        (F.col("branch_id") == number) if number is not None else None,
    ]
    return reduce(lambda rows, test: rows.filter(test), [t for t in tests if t is not None], df)


def contains_any(df: DataFrame, text: str, cols: list[str]) -> DataFrame:
    """Case-insensitive substring of the columns joined with a space."""
    return df.filter(F.lower(F.concat_ws(" ", *cols)).contains(F.lower(F.lit(text))))


def list_timetable(
    timetable: DataFrame, branches: DataFrame, teachers: DataFrame, classes: DataFrame,
    branch: int | None = None, teacher: int | None = None, class_name: str | None = None,
    section: str | None = None, day: str | None = None,
    order_by: tuple[str, ...] = ("day_of_week", "start_min", "id"),
) -> DataFrame:
    """Bookings with names, optional exact filters, ordered by day name and start.

    The filters go onto the inputs, so they reach the scans instead of the joined rows.
    """
    if branch is not None:
        timetable = timetable.filter(F.col("branch_id") == branch)
    if teacher is not None:
        timetable = timetable.filter(F.col("teacher_id") == teacher)
    if day is not None:
        timetable = timetable.filter(F.col("day_of_week") == day)
    if class_name is not None:
        classes = classes.filter(F.col("class_name") == class_name)
    if section is not None:
        classes = classes.filter(F.col("section") == section)
    return enrich_timetable(timetable, branches, teachers, classes).orderBy(*order_by)


def page(
    df: DataFrame, order_by: list[str], number, size: int = DIRECTORY_PAGE, clamp: bool = True,
    max_size: int | None = None, deep_from: int = 100_000, index: OrderIndex | None = None,
) -> DataFrame:
    """One page of a total order.

    ``clamp=True`` reads anything that is no number as page 1 and any page out of range, on either
    side, as the last one; it adds ``page``, ``total`` and ``total_pages``. ``clamp=False`` slices as asked, with at most
    ``max_size`` rows, and adds ``total``. Order columns may have any type and direction. Early pages are a top-n; a
    page starting beyond ``deep_from`` is found by counted ranges of the order (``OrderIndex``; keep ``index`` for further
    pages of the same table), or cut by row number where a direction is given, with the same result: no task has to hold
    every row before the page.
    """
    total = sum(index.counts) if index else df.count()
    if clamp:
        pages = max(1, -(-total // size))
        text = str(number).strip()
        wanted = int(text) if text.removeprefix("-").isdecimal() else 1
        wanted = wanted if 1 <= wanted <= pages else pages
        start, count = (wanted - 1) * size, size
    else:
        count = min(size, max_size) if max_size else size
        start = max(0, (int(number) - 1) * count)
    if start + count <= deep_from:
        rows = df.orderBy(*order_by).offset(start).limit(count)
    elif all(isinstance(c, str) for c in order_by):
        rows = (index or OrderIndex(df, order_by, total, deep_from)).rows(start, count)
    else:
        rows = number_rows(df, [], order_by, "_row").filter(
            (F.col("_row") > start) & (F.col("_row") <= start + count)
        ).drop("_row").orderBy(*order_by)
    rows = rows.withColumn("total", F.lit(total).cast("bigint"))
    return rows.withColumns({"page": F.lit(wanted), "total_pages": F.lit(pages)}) if clamp else rows


def list_branches(branches: DataFrame, organizations: DataFrame, org_id: int) -> DataFrame:
    org = organizations.select(F.col("id").alias("organization_id"), F.col("name").alias("organization_name"))
    mine = branches.filter(F.col("organization_id") == org_id)
    return mine.join(org, "organization_id").select(*branches.columns, "organization_name").orderBy("name", "id")


def list_all(people: DataFrame) -> DataFrame:
    return people.orderBy("id")


def newest_images(images: DataFrame) -> DataFrame:
    return images.orderBy(F.col("created_at").desc(), F.col("embedding_id"))


def find_org(organizations: DataFrame, name: str) -> DataFrame:
    return organizations.filter(F.lower(stripped("name")) == F.lower(F.lit(name.strip())))


def enrich_people(people: DataFrame, branches: DataFrame, departments: DataFrame) -> DataFrame:
    """Branch name (inner) and department name (NULL when there is none)."""
    b = branches.select(F.col("id").alias("branch_id"), F.col("name").alias("branch_name"), "organization_id")
    d = departments.select(F.col("id").alias("department_id"), F.col("name").alias("department_name"))
    return people.join(b, "branch_id").join(d, "department_id", "left").select(
        *people.columns, "branch_name", "organization_id", "department_name"
    )


def enrich_timetable(
    timetable: DataFrame, branches: DataFrame, teachers: DataFrame, classes: DataFrame
) -> DataFrame:
    b = branches.select(F.col("id").alias("branch_id"), F.col("name").alias("branch_name"))
    t = teachers.select(F.col("id").alias("teacher_id"), F.col("name").alias("teacher_name"), "employee_id")
    c = classes.select(F.col("id").alias("school_class_id"), "class_name", "section")
    return timetable.join(b, "branch_id").join(t, "teacher_id").join(c, "school_class_id").select(
        *timetable.columns, "branch_name", "teacher_name", "employee_id", "class_name", "section"
    )


def dictionary(entries: DataFrame, on: list[str], id_col: str = "id") -> DataFrame:
    """One id per trimmed key, the highest where a key occurs twice."""
    keys = [stripped(c).alias(c) if t == "string" else F.col(c) for c, t in entries.dtypes if c in on]
    return entries.groupBy(*keys).agg(F.max(id_col).alias("_found"))


def resolve(
    rows: DataFrame, entries: DataFrame, on: dict[str, str], id_as: str, id_col: str = "id"
) -> DataFrame:
    """Adds ``id_as`` by looking trimmed text up in ``entries`` and keeps every row (NULL = unknown).

    ``on`` maps row columns to dictionary columns; columns that are not text are compared as they are.
    """
    found = dictionary(entries, list(on.values()), id_col)
    row_types, names = dict(rows.dtypes), list(on.items())
    test = reduce(
        lambda a, b: a & b,
        [(stripped(rows[r]) if row_types[r] == "string" else rows[r]) == found[d] for r, d in names],
    )
    return rows.join(found, test, "left").select(*[rows[c] for c in rows.columns], found["_found"].alias(id_as))


def split_existing(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``stored``: is the key already in the table? Repeated stored keys do not multiply rows."""
    known = existing.select(*keys).distinct().withColumn("_stored", F.lit(True))
    return rows.join(known, keys, "left").select(
        *rows.columns, F.coalesce("_stored", F.lit(False)).alias("stored")
    )


def flag_repeats(rows: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Adds ``repeated``: an earlier row of the same file has the key.

    The first row per key comes from an aggregation with partial minima, so a key that fills a
    third of the file is never gathered.
    """
    first = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(order_col).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(first, same).select(*rows.columns, (F.col(order_col) > F.col("_first")).alias("repeated"))


def backfill_images(
    images: DataFrame, students: DataFrame, teachers: DataFrame, default_branch: DataFrame
) -> DataFrame:
    """Missing branch of a face image from the table its person type names, else the default."""
    return _backfill(images, students, teachers, default_branch, by_type=True)


def backfill_facts(
    facts: DataFrame, students: DataFrame, teachers: DataFrame, default_branch: DataFrame
) -> DataFrame:
    """Missing branch of other facts: student first, then teacher, else the default."""
    return _backfill(facts, students, teachers, default_branch, by_type=False)


def lowest_branch(branches: DataFrame) -> DataFrame:
    return branches.agg(F.min("id"))


def _backfill(facts, students, teachers, default_branch, by_type):
    s = students.groupBy(F.col("roll_no").alias("person_id")).agg(F.max_by("branch_id", "id").alias("_s"))
    t = teachers.groupBy(F.col("employee_id").alias("person_id")).agg(F.max_by("branch_id", "id").alias("_t"))
    joined = facts.join(s, "person_id", "left").join(t, "person_id", "left")
    if by_type:
        known = F.when(F.col("person_type") == "student", F.col("_s")).when(
            F.col("person_type") == "teacher", F.col("_t"))
    else:
        known = F.coalesce("_s", "_t")
    filled = F.coalesce(F.col("branch_id"), known, default_branch.scalar()).alias("branch_id")
    return joined.select(*[filled if c == "branch_id" else F.col(c) for c in facts.columns])


def with_identity(hits: DataFrame, gallery: DataFrame, hit_id: str = "id") -> DataFrame:
    """Name, roll number, role and reliability of the matched gallery row, NULL when missing."""
    known = gallery.select(
        "school_id", F.col("id").alias(hit_id), F.col("name").alias("match_name"),
        F.col("roll_no").alias("match_roll_no"), F.col("role").alias("match_role"),
        F.col("reliability").alias("match_reliability"),
    )
    return hits.join(known, ["school_id", hit_id], "left").select(
        *hits.columns, "match_name", "match_roll_no", "match_role", "match_reliability"
    )
