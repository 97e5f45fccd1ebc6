"""Analytics and directory queries."""

from pyspark.sql import functions as F

from rollgrid.operators import analytics, directory, maintenance
from rollgrid.plans.registry import query
from rollgrid.session import fresh_path
from rollgrid.sources import partitioned

RATE_SQL = """
    SELECT p.id, p.name, count(a.{key}) AS total, count(a.{key}) FILTER (WHERE a.status = 'Present') AS present,
           round(CASE WHEN count(a.{key}) = 0 THEN 0.0
                 ELSE 100.0 * count(a.{key}) FILTER (WHERE a.status = 'Present') / count(a.{key}) END, 6) AS rate
    FROM {people} p LEFT JOIN {facts} a ON a.{key} = p.id GROUP BY p.id, p.name"""
STUDENT_RATE = RATE_SQL.format(people="student", facts="attendance", key="student_id")
TEACHER_RATE = RATE_SQL.format(people="teacher", facts="teacher_attendance", key="teacher_id")


def rounded(rates):
    return rates.withColumn("rate", F.round("rate", 6))


@query("a1_student_rate", "student attendance", STUDENT_RATE)
def a1(v):
    return rounded(analytics.attendance_rate(v.student.select("id", "name"), v.attendance, "student_id"))


@query("a2_teacher_rate", "teacher teacher_attendance", TEACHER_RATE)
def a2(v):
    return rounded(analytics.attendance_rate(v.teacher.select("id", "name"), v.teacher_attendance, "teacher_id"))


@query("a3_most_absent", "student attendance", f"SELECT * FROM ({STUDENT_RATE}) ORDER BY rate, id LIMIT 1")
def a3(v):
    return analytics.most_absent(a1(v))


@query("a4_student_detail", "student attendance", """
    SELECT p.id, count(a.id) AS total, count(a.id) FILTER (WHERE a.status = 'Present') AS present,
           count(a.id) - count(a.id) FILTER (WHERE a.status = 'Present') AS absent,
           round(CASE WHEN count(a.id) = 0 THEN 0.0
                 ELSE 100.0 * count(a.id) FILTER (WHERE a.status = 'Present') / count(a.id) END, 6) AS rate
    FROM student p LEFT JOIN attendance a ON a.student_id = p.id GROUP BY p.id""")
def a4(v):
    return rounded(analytics.attendance_detail(v.student.select("id"), v.attendance, "student_id"))


@query("a5_gallery_counts", "gallery", """
    SELECT school_id, role, count(*) AS n_live FROM gallery WHERE NOT deleted
    GROUP BY GROUPING SETS ((school_id), (school_id, role))""")
def a5(v):
    return analytics.gallery_counts(v.gallery)


@query("f1_scope", "branch student", """
    SELECT s.id, s.branch_id, s.name FROM student s JOIN branch b ON b.id = s.branch_id
    WHERE b.organization_id = 2""")
def f1(v):
    return directory.scope(v.student.select("id", "branch_id", "name"), v.branch, 2)


@query("f1_lookup", "branch teacher", """
    SELECT t.id, t.name, t.employee_id FROM teacher t JOIN branch b ON b.id = t.branch_id
    WHERE t.id = 7 AND b.organization_id = (SELECT b2.organization_id FROM teacher t2
          JOIN branch b2 ON b2.id = t2.branch_id WHERE t2.id = 7)
    UNION ALL
    SELECT t.id, t.name, t.employee_id FROM teacher t JOIN branch b ON b.id = t.branch_id
    WHERE t.id = 8 AND b.organization_id = 99""")
def f1_lookup(v):
    org = v.teacher.join(v.branch.withColumnRenamed("id", "branch_id").drop("name"), "branch_id") \
        .filter("id = 7").first()["organization_id"]
    people = v.teacher.select("id", "name", "employee_id", "branch_id")
    found = directory.lookup(people, v.branch, org, 7).unionByName(directory.lookup(people, v.branch, 99, 8))
    return found.drop("branch_id")


@query("f2_search_students", "student", """
    SELECT id, name, roll_no, class_name FROM student WHERE lower(name) LIKE 'customer#00000%' AND lower(roll_no) LIKE '00000%'
      AND lower(class_name) LIKE 'm%'""")
def f2(v):
    return directory.search_directory(v.student, name="cUSTOMER#00000", key="00000", class_name="m",
                                      branch="undefined").select("id", "name", "roll_no", "class_name")


@query("f2_search_teachers", "teacher", """
    SELECT id, name, employee_id FROM teacher WHERE lower(name) LIKE 'supplier%' AND branch_id = 3""")
def f2_teachers(v):
    return directory.search_directory(v.teacher, name="SUPPLIER", branch="3", key_col="employee_id") \
        .select("id", "name", "employee_id")


@query("f3_contains_any", "teacher", """
    SELECT id, name, employee_id FROM teacher
    WHERE contains(lower(name || ' ' || employee_id), '7 00000')""")
def f3(v):
    return directory.contains_any(v.teacher, "7 00000", ["name", "employee_id"]).select("id", "name", "employee_id")


LISTED = """
    SELECT t.*, b.name AS branch_name, e.name AS teacher_name, e.employee_id, c.class_name, c.section
    FROM timetable t JOIN branch b ON b.id = t.branch_id JOIN teacher e ON e.id = t.teacher_id
    JOIN school_class c ON c.id = t.school_class_id"""


@query("f4_list_timetable", "timetable branch teacher school_class",
       LISTED + " WHERE t.day_of_week = 'Monday' AND t.branch_id = 4 AND c.section = 'ECONOMY'")
def f4(v):
    return directory.list_timetable(v.timetable, v.branch, v.teacher, v.school_class,
                                    branch=4, day="Monday", section="ECONOMY")


@query("f5_page_directory", "student", """
    SELECT id, name, CAST(greatest(ceil((SELECT count(*) FROM student) / 10.0), 1) AS INT) AS page,
           (SELECT count(*) FROM student) AS total,
           CAST(greatest(ceil((SELECT count(*) FROM student) / 10.0), 1) AS INT) AS total_pages
    FROM student ORDER BY id LIMIT 10
    OFFSET (SELECT CAST(10 * (ceil(count(*) / 10.0) - 1) AS BIGINT) FROM student)""")
def f5_directory(v):
    return directory.page(v.student.select("id", "name"), ["id"], 10**9)


@query("f5_page_timetable", "timetable",
       "SELECT id, day_of_week, start_min, count(*) OVER () AS total FROM timetable ORDER BY start_min, id LIMIT 200 OFFSET 600")
def f5_timetable(v):
    return directory.page(v.timetable.select("id", "day_of_week", "start_min"), ["start_min", "id"], 4,
                          size=500, clamp=False, max_size=directory.TIMETABLE_PAGE_MAX)


@query("f5_page_deep", "timetable",
       "SELECT id, start_min, count(*) OVER () AS total FROM timetable ORDER BY start_min, id LIMIT 50 OFFSET 20000")
def f5_deep(v):
    return directory.page(v.timetable.select("id", "start_min"), ["start_min", "id"], 401,
                          size=directory.TIMETABLE_PAGE, clamp=False, deep_from=1000)


@query("f5_page_timetable_deep", "timetable", """
    SELECT id, day_of_week, start_min, count(*) OVER () AS total FROM timetable
    ORDER BY day_of_week, start_min, id LIMIT 50 OFFSET 30000""")
def f5_timetable_deep(v):
    return directory.page(v.timetable.select("id", "day_of_week", "start_min"), ["day_of_week", "start_min", "id"], 601,
                          size=directory.TIMETABLE_PAGE, clamp=False, deep_from=1000)


@query("f6_list_branches", "branch organization", """
    SELECT b.*, o.name AS organization_name FROM branch b JOIN organization o ON o.id = b.organization_id
    WHERE b.organization_id = 1 ORDER BY b.name, b.id""")
def f6(v):
    return directory.list_branches(v.branch, v.organization, 1)


@query("f6_list_all", "student", "SELECT id, name, roll_no FROM student ORDER BY id")
def f6_all(v):
    return directory.list_all(v.student.select("id", "name", "roll_no"))


@query("f6_newest_images", "", "SELECT event_id AS embedding_id, user_id AS person_id FROM events ORDER BY ts DESC, event_id")
def f6_images(v):
    images = v.events.selectExpr("event_id AS embedding_id", "user_id AS person_id", "ts AS created_at")
    return directory.newest_images(images).drop("created_at")


@query("f7_find_org", "organization", "SELECT * FROM organization WHERE lower(trim(name)) = lower(trim('  euROPE '))")
def f7(v):
    return directory.find_org(v.organization, "  euROPE ")


@query("j1_enrich_people", "student branch department", """
    SELECT s.id, s.name, b.name AS branch_name, b.organization_id, d.name AS department_name
    FROM student s JOIN branch b ON b.id = s.branch_id LEFT JOIN department d ON d.id = s.department_id""")
def j1(v):
    return directory.enrich_people(v.student, v.branch, v.department).select(
        "id", "name", "branch_name", "organization_id", "department_name")


@query("j1_enrich_timetable", "timetable branch teacher school_class", LISTED)
def j1_timetable(v):
    return directory.enrich_timetable(v.timetable, v.branch, v.teacher, v.school_class)


@query("j2_resolve_class", "timetable school_class", """
    WITH d AS (SELECT branch_id, trim(class_name) AS class_name, max(id) AS found FROM school_class GROUP BY 1, 2)
    SELECT c.id, c.branch_id, coalesce(d.found, -1) AS class_id FROM school_class c
    LEFT JOIN d ON d.branch_id = (c.branch_id * 7) % 30 AND d.class_name = trim(c.class_name)""")
def j2(v):
    rows = v.school_class.selectExpr("id", "branch_id", "(branch_id * 7) % 30 AS b", "concat('  ', class_name) AS c")
    return directory.resolve(rows, v.school_class, {"b": "branch_id", "c": "class_name"}, "class_id") \
        .select("id", "branch_id", F.coalesce("class_id", F.lit(-1)).alias("class_id"))


@query("j3_split_existing", "student teacher", """
    SELECT s.id, s.roll_no, EXISTS (SELECT 1 FROM teacher t WHERE t.branch_id = s.branch_id
           AND t.employee_id = s.roll_no) AS stored FROM student s""")
def j3(v):
    stored = v.teacher.withColumnRenamed("employee_id", "roll_no")
    return directory.split_existing(v.student, stored, ["branch_id", "roll_no"]).select("id", "roll_no", "stored")


@query("j3_flag_repeats", "timetable", """
    SELECT id, teacher_id, day_of_week, start_min,
           id > min(id) OVER (PARTITION BY teacher_id, day_of_week, start_min) AS repeated FROM timetable""")
def j3_repeats(v):
    rows = v.timetable.select("id", "teacher_id", "day_of_week", "start_min")
    return directory.flag_repeats(rows, ["teacher_id", "day_of_week", "start_min"], "id")


@query("j9_backfill_images", "student teacher branch", """
    WITH s AS (SELECT roll_no, arg_max(branch_id, id) AS b FROM student GROUP BY 1),
         t AS (SELECT employee_id, arg_max(branch_id, id) AS b FROM teacher GROUP BY 1),
         facts AS (SELECT l_orderkey AS embedding_id, right('00000000' || CAST(l_partkey % 1700 AS STRING), 9) AS p,
                   CASE WHEN l_linenumber % 2 = 0 THEN 'student' ELSE 'teacher' END AS person_type,
                   CASE WHEN l_linenumber = 1 THEN l_suppkey % 25 END AS branch_id FROM lineitem)
    SELECT f.embedding_id, f.p AS person_id, f.person_type,
           coalesce(f.branch_id, CASE f.person_type WHEN 'student' THEN s.b ELSE t.b END,
                    (SELECT min(id) FROM branch)) AS branch_id
    FROM facts f LEFT JOIN s ON s.roll_no = f.p LEFT JOIN t ON t.employee_id = f.p""")
def j9_images(v):
    return directory.backfill_images(_facts(v), v.student, v.teacher, directory.lowest_branch(v.branch))


@query("j9_backfill_facts", "student teacher branch", """
    WITH s AS (SELECT roll_no, arg_max(branch_id, id) AS b FROM student GROUP BY 1),
         t AS (SELECT employee_id, arg_max(branch_id, id) AS b FROM teacher GROUP BY 1),
         facts AS (SELECT l_orderkey AS embedding_id, right('00000000' || CAST(l_partkey % 1700 AS STRING), 9) AS p,
                   CASE WHEN l_linenumber % 2 = 0 THEN 'student' ELSE 'teacher' END AS person_type,
                   CASE WHEN l_linenumber = 1 THEN l_suppkey % 25 END AS branch_id FROM lineitem)
    SELECT f.embedding_id, f.p AS person_id, f.person_type,
           coalesce(f.branch_id, s.b, t.b, (SELECT min(id) FROM branch)) AS branch_id
    FROM facts f LEFT JOIN s ON s.roll_no = f.p LEFT JOIN t ON t.employee_id = f.p""")
def j9_facts(v):
    return directory.backfill_facts(_facts(v), v.student, v.teacher, directory.lowest_branch(v.branch))


def _facts(v):
    return v.lineitem.selectExpr(
        "l_orderkey AS embedding_id", "right(concat('00000000', CAST(l_partkey % 1700 AS STRING)), 9) AS person_id",
        "CASE WHEN l_linenumber % 2 = 0 THEN 'student' ELSE 'teacher' END AS person_type",
        "CASE WHEN l_linenumber = 1 THEN l_suppkey % 25 END AS branch_id")


@query("m1_cascade_delete", "student attendance", """
    SELECT 'student' AS table_name, id FROM student WHERE section <> 'B'
    UNION ALL
    SELECT 'attendance', a.id FROM attendance a
    WHERE a.student_id NOT IN (SELECT id FROM student WHERE section = 'B')""")
def m1(v):
    gone = v.student.filter("section = 'B'")
    left = maintenance.cascade_delete({"student": v.student, "attendance": v.attendance}, "student", gone,
                                      cascade={"attendance": "student_id"})
    return maintenance.union_report([
        t.select(F.lit(n).alias("table_name"), "id") for n, t in left.items()])


@query("m1_set_null", "student department", """
    SELECT s.id, coalesce(CASE WHEN d.name = 'BUILDING' THEN NULL ELSE s.department_id END, -1) AS department_id
    FROM student s LEFT JOIN department d ON d.id = s.department_id""")
def m1_null(v):
    gone = v.department.filter("name = 'BUILDING'")
    left = maintenance.cascade_delete({"student": v.student, "department": v.department}, "department", gone,
                                      set_null={"student": "department_id"})
    return left["student"].select("id", F.coalesce("department_id", F.lit(-1)).alias("department_id"))


TREE_SQL = """
    SELECT 'organization' AS table_name, id, 0 AS department_id FROM organization WHERE id <> 1
    UNION ALL SELECT 'branch', id, 0 FROM branch WHERE organization_id <> 1
    UNION ALL SELECT 'department', d.id, 0 FROM department d JOIN branch b ON b.id = d.branch_id WHERE b.organization_id <> 1
    UNION ALL SELECT 'student', s.id, CASE WHEN s.department_id IN (
                  SELECT d.id FROM department d JOIN branch x ON x.id = d.branch_id WHERE x.organization_id = 1) THEN -1 ELSE coalesce(s.department_id, -1) END
              FROM student s JOIN branch b ON b.id = s.branch_id WHERE b.organization_id <> 1
    UNION ALL SELECT 'attendance', a.id, 0 FROM attendance a WHERE a.branch_id NOT IN (SELECT id FROM branch WHERE organization_id = 1)
        AND coalesce(a.student_id, -1) NOT IN (SELECT s.id FROM student s JOIN branch b ON b.id = s.branch_id WHERE b.organization_id = 1)"""
TREE_RULES = [("organization", "branch", "organization_id"), ("branch", "department", "branch_id"), ("branch", "student", "branch_id"),
              ("branch", "attendance", "branch_id"), ("student", "attendance", "student_id")]
TREE_NULLS = [("department", "student", "department_id")]
TREE_TABLES = "organization branch department student attendance"


def _tree_rows(left):
    return maintenance.union_report([
        t.select(F.lit(n).alias("table_name"), "id", (F.coalesce("department_id", F.lit(-1)) if n == "student" else F.lit(0)).cast("bigint").alias("department_id"))
        for n, t in left.items()])


@query("m1_cascade_tree", TREE_TABLES, TREE_SQL)
def m1_tree(v):
    """An organization goes, and with it its branches, their departments, students and attendance."""
    tables = {n: getattr(v, n) for n in TREE_TABLES.split()}
    return _tree_rows(maintenance.cascade_tree(tables, "organization", v.organization.filter("id = 1"), TREE_RULES, TREE_NULLS))


def _stored(v, by):
    """The views as stored tables: name to (path, schema, partition columns)."""
    base, stored = fresh_path(v.spark, "stored"), {}
    for name, columns in by.items():
        rows = getattr(v, name)
        rows.write.partitionBy(*columns).parquet(f"{base}/{name}")
        stored[name] = (f"{base}/{name}", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), columns)
    return stored


@query("m1_cascade_written", TREE_TABLES, TREE_SQL)
def m1_written(v):
    """The same on stored tables: only partitions that hold a row that goes are written again."""
    stored = _stored(v, {"organization": ["name"], "branch": ["organization_id"], "department": ["branch_id"], "student": ["branch_id"],
                         "attendance": ["branch_id", "status"]})
    partitioned.cascade(v.spark, stored, "organization", v.organization.filter("id = 1"), TREE_RULES, TREE_NULLS)
    return _tree_rows({n: v.spark.read.schema(schema).parquet(path) for n, (path, schema, _) in stored.items()})


@query("m2_update_written", "student", """
    SELECT id, branch_id, CASE WHEN branch_id % 4 = 1 AND id % 3 = 0 THEN 'Renamed ' || CAST(id AS STRING) ELSE name END AS name,
           CASE WHEN branch_id % 4 = 1 AND id % 3 = 0 AND id % 2 = 0 THEN '-' ELSE class_name END AS class_name FROM student""")
def m2_written(v):
    stored = _stored(v, {"student": ["branch_id"]})["student"]
    patches = v.student.filter("branch_id % 4 = 1 AND id % 3 = 0").selectExpr(
        "id", "concat('Renamed ', id) AS name", "true AS has_name", "'-' AS class_name", "id % 2 = 0 AS has_class_name")
    partitioned.update_rows(v.spark, *stored, patches, ["id"], ["name", "class_name"])
    return v.spark.read.schema(stored[1]).parquet(stored[0]).select("id", "branch_id", "name", "class_name")


@query("m2_apply_updates", "student attendance", """
    WITH p AS (SELECT student_id AS id, min(status) AS s, max(id) AS m FROM attendance GROUP BY 1)
    SELECT s.id, s.branch_id, CASE WHEN p.id IS NOT NULL THEN 'Renamed ' || CAST(p.m AS STRING) ELSE s.name END AS name,
           CASE WHEN p.s = 'Absent' THEN NULL ELSE s.class_name END AS class_name
    FROM student s LEFT JOIN p ON p.id = s.id""")
def m2(v):
    patches = v.attendance.groupBy(F.col("student_id").alias("id")).agg(
        F.min("status").alias("s"), F.max("id").alias("m")).selectExpr(
        "id", "concat('Renamed ', m) AS name", "true AS has_name",
        "CAST(NULL AS STRING) AS class_name", "s = 'Absent' AS has_class_name")
    people = v.student.select("id", "branch_id", "name", "class_name")
    return maintenance.apply_updates(people, patches, ["id"], ["name", "class_name"])


@query("m3_audit", "attendance timetable school_class student department", """
    SELECT 'attendance' AS table_name, 'unique branch_id,student_id,date' AS rule, count(*) AS n_violations FROM (
        SELECT 1 FROM attendance WHERE student_id IS NOT NULL GROUP BY branch_id, student_id, date HAVING count(*) > 1)
    UNION ALL SELECT 'school_class', 'unique branch_id,class_name,section', count(*) FROM (
        SELECT 1 FROM school_class GROUP BY branch_id, class_name, section HAVING count(*) > 1)
    UNION ALL SELECT 'timetable', 'unique teacher_id,day_of_week,start_min,end_min', count(*) FROM (
        SELECT 1 FROM timetable GROUP BY teacher_id, day_of_week, start_min, end_min HAVING count(*) > 1)
    UNION ALL SELECT 'attendance', 'exactly one person', count(*) FROM attendance
        WHERE (student_id IS NULL) = (teacher_id IS NULL)
    UNION ALL SELECT 'attendance', 'status known', count(*) FROM attendance WHERE status NOT IN ('Present', 'Absent')
    UNION ALL SELECT 'timetable', 'start before end', count(*) FROM timetable WHERE start_min >= end_min
    UNION ALL SELECT 'timetable', 'day known', count(*) FROM timetable WHERE day_of_week NOT IN
        ('Monday','Tuesday','Wednesday','Thursday','Friday','Saturday')
    UNION ALL SELECT 'attendance', 'dangling student_id', count(*) FROM attendance
        WHERE student_id IS NOT NULL AND student_id NOT IN (SELECT id FROM student)
    UNION ALL SELECT 'timetable', 'dangling school_class_id', count(*) FROM timetable
        WHERE school_class_id IS NOT NULL AND school_class_id NOT IN (SELECT id FROM school_class WHERE class_name <> 'Brand#2')
    UNION ALL SELECT 'student', 'dangling department_id', count(*) FROM student
        WHERE department_id IS NOT NULL AND department_id NOT IN (SELECT id FROM department)""")
def m3(v):
    week = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
    return maintenance.union_report([
        maintenance.repeated_keys(v.attendance, "attendance", ["branch_id", "student_id", "date"],
                                  F.col("student_id").isNotNull()),
        maintenance.repeated_keys(v.school_class, "school_class", ["branch_id", "class_name", "section"]),
        maintenance.repeated_keys(v.timetable, "timetable", ["teacher_id", "day_of_week", "start_min", "end_min"]),
        maintenance.failed_rows(v.attendance, "attendance", {
            "exactly one person": maintenance.exactly_one("student_id", "teacher_id"),
            "status known": ~F.col("status").isin("Present", "Absent")}),
        maintenance.failed_rows(v.timetable, "timetable", {
            "start before end": F.col("start_min") >= F.col("end_min"),
            "day known": ~F.col("day_of_week").isin(*week)}),
        maintenance.dangling(v.attendance, "attendance", "student_id", v.student),
        maintenance.dangling(v.timetable, "timetable", "school_class_id",
                             v.school_class.filter("class_name <> 'Brand#2'")),
        maintenance.dangling(v.student, "student", "department_id", v.department),
    ])
