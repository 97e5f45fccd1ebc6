"""Import, booking, geography, capture-quality and sink queries."""

from pyspark.sql import functions as F

from rollgrid import session
from rollgrid.operators import analytics, bookings, capture, ingest, spatial
from rollgrid.plans.registry import query
from rollgrid.sources import sinks

# ---------------------------------------------------------------- bookings
NEW_SQL = """
    SELECT o_orderkey AS row_no, o_custkey % 100 AS teacher_id, o_custkey % 2000 AS school_class_id,
           {day} AS day_of_week, CAST(300 + (o_orderkey * 11) % 700 AS INT) AS start_min,
           CAST(340 + (o_orderkey * 11) % 700 + o_custkey % 15 AS INT) AS end_min
    FROM orders"""


def new_bookings(v):
    return v.orders.selectExpr(
        "o_orderkey AS row_no", "o_custkey % 100 AS teacher_id", "o_custkey % 2000 AS school_class_id",
        "date_format(o_orderdate, 'EEEE') AS day_of_week", "CAST(300 + (o_orderkey * 11) % 700 AS INT) AS start_min",
        "CAST(340 + (o_orderkey * 11) % 700 + o_custkey % 15 AS INT) AS end_min")


def _conflict_sql(key):
    return "WITH fresh AS (" + NEW_SQL.format(day="dayname(o_orderdate)") + f""")
    SELECT n.row_no, n.{key}, n.day_of_week, n.start_min, n.end_min FROM fresh n WHERE EXISTS (
        SELECT 1 FROM timetable b WHERE b.{key} = n.{key} AND b.day_of_week = n.day_of_week
        AND n.start_min < b.end_min AND n.end_min > b.start_min)"""


@query("j4_conflicts_teacher", "timetable", _conflict_sql("teacher_id"))
def j4_teacher(v):
    rows = new_bookings(v).select("row_no", "teacher_id", "day_of_week", "start_min", "end_min")
    return bookings.conflicts(rows, v.timetable, "teacher_id")


@query("j4_conflicts_class", "timetable", _conflict_sql("school_class_id"))
def j4_class(v):
    rows = new_bookings(v).select("row_no", "school_class_id", "day_of_week", "start_min", "end_min")
    return bookings.conflicts(rows, v.timetable, "school_class_id")


SELF_SQL = """
    WITH t AS (SELECT *, row_number() OVER () AS nr FROM timetable)
    SELECT a.id, a.{key}, count(*) AS n_conflicts FROM t a JOIN t b
      ON a.{key} = b.{key} AND a.day_of_week = b.day_of_week AND a.start_min < b.end_min AND a.end_min > b.start_min
     AND a.nr <> b.nr
    GROUP BY a.nr, a.id, a.{key}"""


@query("j5_self_conflicts_teacher", "timetable", SELF_SQL.format(key="teacher_id"))
def j5_teacher(v):
    return bookings.self_conflicts(v.timetable, "teacher_id").select("id", "teacher_id", "n_conflicts")


@query("j5_self_conflicts_class", "timetable", SELF_SQL.format(key="school_class_id"))
def j5_class(v):
    return bookings.self_conflicts(v.timetable, "school_class_id").select("id", "school_class_id", "n_conflicts")


ABSENCE_SQL = """
    WITH absence AS (SELECT DISTINCT teacher_id, date FROM teacher_attendance WHERE status = 'Absent')
    SELECT a.teacher_id, CAST(a.date AS STRING) AS date, count(*) AS n_periods, count(DISTINCT b.school_class_id) AS n_classes,
           min(b.start_min) AS first_start, max(b.end_min) AS last_end, max(c.class_name || ' ' || c.section) AS last_class
    FROM absence a JOIN timetable b ON b.teacher_id = a.teacher_id AND b.day_of_week = dayname(a.date)
    JOIN school_class c ON c.id = b.school_class_id GROUP BY 1, 2"""


def absences(v):
    """All absences of all teachers."""
    return v.teacher_attendance.filter("status = 'Absent'").select("teacher_id", "date").distinct()


@query("j6_absent_periods", "teacher_attendance timetable school_class", ABSENCE_SQL)
def j6(v):
    missed = bookings.absence_summary(absences(v), v.timetable, v.school_class)
    return missed.withColumn("date", F.col("date").cast("string"))


# ---------------------------------------------------------------- geography
@query("j7_geofence", "attempt branch", """
    WITH d AS (
        SELECT a.event_id, b.attendance_radius, 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) AS distance_m FROM (
            SELECT event_id, branch_id, pow(sin(radians(b.latitude - lat) / 2), 2) + cos(radians(lat))
                   * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - lon) / 2), 2) AS h
            FROM attempt JOIN branch b ON b.id = branch_id) a JOIN branch b ON b.id = a.branch_id)
    SELECT event_id, round(distance_m, 3) AS distance_m, distance_m <= attendance_radius AS inside FROM d""")
def j7(v):
    return spatial.geofence(v.attempt.select("event_id", "branch_id", "lat", "lon"), v.branch).select(
        "event_id", F.round("distance_m", 3).alias("distance_m"), "inside")


@query("j8_box_overlap", "box", """
    WITH p AS (SELECT a.frame, a.box_id AS a_id, b.box_id AS b_id,
             least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x) AS w,
             least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) AS h,
             CAST(a.width AS DOUBLE) * a.height + CAST(b.width AS DOUBLE) * b.height AS areas
        FROM box a JOIN box b ON a.frame = b.frame)
    SELECT frame, a_id, b_id, round(CAST(w AS DOUBLE) * h / (areas - CAST(w AS DOUBLE) * h), 6) AS iou
    FROM p WHERE w > 0 AND h > 0 AND CAST(w AS DOUBLE) * h / (areas - CAST(w AS DOUBLE) * h) >= 0.05""")
def j8(v):
    boxes = v.box.selectExpr("frame", "box_id", "named_struct('x', x, 'y', y, 'width', width, 'height', height) AS bbox")
    return spatial.box_overlap(boxes, boxes, ["frame"], 0.05).withColumn("iou", F.round("iou", 6))


@query("j8_box_overlap_crowded", "box", """
    WITH crowd AS (SELECT CASE WHEN box_id % 3 = 0 THEN 0 ELSE frame % 7 + 1 END AS frame, box_id,
               box_id % 9973 * 97 % 4000 AS x, box_id % 9967 * 89 % 4000 AS y, width % 60 + 5 AS width, height % 50 + 5 AS height FROM box),
    p AS (SELECT a.frame, a.box_id AS a_id, b.box_id AS b_id,
             least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x) AS w,
             least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) AS h,
             CAST(a.width AS DOUBLE) * a.height + CAST(b.width AS DOUBLE) * b.height AS areas
        FROM crowd a JOIN crowd b ON a.frame = b.frame AND b.x < a.x + a.width AND b.x + b.width > a.x AND b.y < a.y + a.height)
    SELECT frame, count(*) AS pairs, CAST(sum(a_id * 31 + b_id * 17) AS BIGINT) AS members, round(sum(round(CAST(w AS DOUBLE) * h / (areas - CAST(w AS DOUBLE) * h), 9)), 4) AS iou
    FROM p WHERE w > 0 AND h > 0 AND CAST(w AS DOUBLE) * h / (areas - CAST(w AS DOUBLE) * h) >= 0.3 GROUP BY frame""")
def j8_crowded(v):
    """A third of all boxes in one frame, cells split where they are dense; the pairs of a frame, summed."""
    boxes = v.box.selectExpr(
        "CASE WHEN box_id % 3 = 0 THEN 0 ELSE frame % 7 + 1 END AS frame", "box_id",
        "named_struct('x', box_id % 9973 * 97 % 4000, 'y', box_id % 9967 * 89 % 4000, 'width', width % 60 + 5, 'height', height % 50 + 5) AS bbox")
    pairs = spatial.box_overlap(boxes, boxes, ["frame"], 0.3, dense=200)
    return crowd_sums(pairs)


def crowd_sums(pairs):
    """Per frame the number of pairs, ``members`` and the sum of IoU. ``members`` is a BIGINT as long as every frame's sum is
    one; on tables whose sums are beyond it, where the checking SQL has no result, the exact sum as a DECIMAL(38, 0)."""
    summed = session.written(pairs.groupBy("frame").agg(
        F.count("*").alias("pairs"), F.sum(F.expr("a_id * 31 + b_id * 17").cast("decimal(20, 0)")).cast("decimal(38, 0)").alias("members"),
        F.round(F.sum(F.round("iou", 9)), 4).alias("iou")), "crowd-sums")
    narrow = F.expr("try_cast(members AS BIGINT)")
    beyond = not summed.filter(F.col("members").isNotNull() & narrow.isNull()).isEmpty()
    return summed if beyond else summed.withColumn("members", narrow)


# ---------------------------------------------------------------- imports
STUDENT_SHEET_SQL = """
    SELECT c_custkey + 2 AS row_no,
           CASE WHEN c_custkey % 29 = 4 THEN '   ' ELSE right('000000000' || CAST(c_custkey - CASE WHEN c_custkey % 31 = 7
                THEN 25 ELSE 0 END AS STRING), 9) END AS roll_no,
           c_name AS name, c_mktsegment AS class_name, 'A' AS section,
           '  NATION_' || CAST(CASE WHEN c_custkey % 17 = 3 THEN 99 ELSE (c_custkey % 25) END AS STRING) || ' ' AS branch,
           CASE WHEN c_custkey % 5 = 0 THEN 'no such' ELSE 'BUILDING ' END AS department
    FROM customer"""
STORED_STUDENT_SQL = """SELECT DISTINCT o_custkey * 2 % 25 AS branch_id, right('000000000' || CAST(o_custkey * 2 AS STRING), 9)
    AS roll_no FROM orders"""
JUDGED_STUDENT_SQL = f"""
    WITH sheet AS ({STUDENT_SHEET_SQL}), stored AS ({STORED_STUDENT_SQL}),
    known AS (SELECT s.*, b.id AS branch_id, d.id AS department_id, t.roll_no IS NOT NULL AS is_stored
        FROM sheet s LEFT JOIN branch b ON b.name = trim(s.branch)
        LEFT JOIN (SELECT name, max(id) AS id FROM department GROUP BY 1) d ON d.name = trim(s.department)
        LEFT JOIN stored t ON t.branch_id = b.id AND t.roll_no = trim(s.roll_no)),
    first_try AS (SELECT *, CASE WHEN branch_id IS NULL THEN 'fail' WHEN trim(roll_no) = '' THEN 'fail'
        WHEN is_stored THEN 'skip' ELSE 'ok' END AS s1 FROM known),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY branch_id, trim(roll_no), s1 ORDER BY row_no) AS n FROM first_try),
    judged AS (SELECT row_no, branch_id, department_id, trim(roll_no) AS roll_no, name,
        CASE WHEN s1 = 'ok' AND n > 1 THEN 'fail' ELSE s1 END AS status,
        CASE WHEN branch_id IS NULL THEN 'unknown branch: ' || trim(branch) WHEN trim(roll_no) = '' THEN 'roll_no is blank'
             WHEN s1 = 'ok' AND n > 1 THEN 'duplicate in file' END AS error FROM ranked)"""


def _student_import(v):
    rows = v.spark.sql(STUDENT_SHEET_SQL.replace("FROM customer", "FROM {source}"), source=v.customer)
    stored = v.spark.sql(STORED_STUDENT_SQL.replace("FROM orders", "FROM {source}"), source=v.orders)
    return ingest.import_students(rows, v.branch, v.department, stored)


@query("io2_import_students_report", "branch department",
       JUDGED_STUDENT_SQL + " SELECT row_no, status, error FROM judged")
def io2_report(v):
    return _student_import(v)[1]


@query("io2_import_students_accepted", "branch department", JUDGED_STUDENT_SQL + """
    SELECT branch_id, coalesce(department_id, -1) AS department_id, roll_no, name FROM judged WHERE status = 'ok'""")
def io2_accepted(v):
    return _student_import(v)[0].select(
        "branch_id", F.coalesce("department_id", F.lit(-1)).alias("department_id"), "roll_no", "name")


@query("a6_import_summary", "branch department",
       JUDGED_STUDENT_SQL + " SELECT status, count(*) AS n_rows FROM judged GROUP BY status")
def a6(v):
    return analytics.summarize(_student_import(v)[1])


TEACHER_SHEET_SQL = """
    SELECT s_suppkey + 2 AS row_no, right(s_name, 9) AS employee_id,
           CASE WHEN s_suppkey % 13 = 2 THEN '' ELSE s_name END AS name, 'NATION_' || CAST(s_nationkey AS STRING) AS branch,
           'FURNITURE' AS department,
           CASE s_suppkey % 4 WHEN 0 THEN '["Math", "Physics"]' WHEN 1 THEN 'not json' WHEN 2 THEN '' ELSE '[]' END AS subjects,
           CASE WHEN s_suppkey % 2 = 0 THEN '["C1"]' END AS can_teach_classes
    FROM supplier"""


def _teacher_import(v):
    rows = v.spark.sql(TEACHER_SHEET_SQL.replace("FROM supplier", "FROM {source}"), source=v.supplier)
    stored = v.lineitem.selectExpr(
        "l_suppkey * 3 % 25 AS branch_id", "right(concat('000000000', l_suppkey * 3), 9) AS employee_id")
    return ingest.import_teachers(rows, v.branch, v.department, stored)


TEACHER_STATUS_SQL = f"""
    WITH sheet AS ({TEACHER_SHEET_SQL}), stored AS (SELECT DISTINCT l_suppkey * 3 % 25 AS branch_id,
         right('000000000' || CAST(l_suppkey * 3 AS STRING), 9) AS employee_id FROM lineitem),
    judged AS (SELECT s.*, b.id AS branch_id, CASE WHEN s.name = '' THEN 'fail' WHEN t.branch_id IS NOT NULL THEN 'skip'
         ELSE 'ok' END AS status, CASE WHEN s.name = '' THEN 'name is blank' END AS error
         FROM sheet s JOIN branch b ON b.name = s.branch
         LEFT JOIN stored t ON t.branch_id = b.id AND t.employee_id = s.employee_id)"""


@query("io1_import_teachers_report", "branch", TEACHER_STATUS_SQL + " SELECT row_no, status, error FROM judged")
def io1_report(v):
    return _teacher_import(v)[1]


@query("io1_import_teachers_accepted", "branch", TEACHER_STATUS_SQL + """
    SELECT branch_id, employee_id, CASE WHEN subjects LIKE '["Math%' THEN 'Math|Physics' ELSE '' END AS subjects,
           CASE WHEN can_teach_classes IS NULL THEN 0 ELSE 1 END AS n_classes FROM judged WHERE status = 'ok'""")
def io1_accepted(v):
    return _teacher_import(v)[0].select(
        "branch_id", "employee_id", F.array_join("subjects", "|").alias("subjects"),
        F.size("can_teach_classes").alias("n_classes"))


TIMETABLE_SHEET_SQL = """
    SELECT o_orderkey + 2 AS row_no, 'NATION_' || CAST(CASE WHEN o_orderkey % 41 = 5 THEN 77 ELSE o_custkey % 25 END AS STRING)
           AS branch, 'Brand#' || CAST(o_custkey % 27 + 1 AS STRING) AS class_name, 'ECONOMY' AS section,
           CASE WHEN o_orderkey % 37 = 2 THEN ' ' ELSE 'History' END AS subject,
           right('000000000' || CAST(o_custkey % 103 AS STRING), 9) AS teacher_employee_id,
           CASE o_orderkey % 9 WHEN 0 THEN 'monday' WHEN 1 THEN 'TUESDAY' WHEN 2 THEN ' Friday' WHEN 3 THEN 'Noday'
                WHEN 4 THEN 'sunday' ELSE 'Thursday' END AS day_of_week,
           CASE WHEN o_orderkey % 23 = 1 THEN '25:00' WHEN o_orderkey % 23 = 2 THEN '' ELSE
                CAST(5 + o_orderkey % 4 AS STRING) || ':' || CAST(o_custkey % 60 AS STRING) END AS start_time,
           CASE WHEN o_orderkey % 19 = 3 THEN '5:00' ELSE '0' || CAST(6 + o_orderkey % 4 AS STRING) || ':30' END AS end_time
    FROM orders"""
BOOKED = "SELECT * FROM timetable"
TIMETABLE_STATUS_SQL = f"""
    WITH sheet AS ({TIMETABLE_SHEET_SQL}), booked AS ({BOOKED}),
    parsed AS (SELECT *, upper(trim(day_of_week))[1] || lower(trim(day_of_week))[2:] AS day,
        start_time = '25:00' AS bad_start,
        CASE WHEN start_time NOT IN ('', '25:00') THEN CAST(split_part(start_time, ':', 1) AS INT) * 60
             + CAST(split_part(start_time, ':', 2) AS INT) END AS s,
        CAST(split_part(end_time, ':', 1) AS INT) * 60 + CAST(split_part(end_time, ':', 2) AS INT) AS e FROM sheet),
    known AS (SELECT p.*, b.id AS branch_id, t.id AS teacher_id, c.id AS class_id FROM parsed p
        LEFT JOIN branch b ON b.name = p.branch LEFT JOIN teacher t ON t.employee_id = p.teacher_employee_id
        LEFT JOIN (SELECT branch_id, class_name, section, max(id) AS id FROM school_class GROUP BY 1, 2, 3) c
          ON c.branch_id = b.id AND c.class_name = p.class_name AND c.section = p.section),
    judged AS (SELECT *, CASE WHEN branch_id IS NULL THEN 'unknown branch: ' || branch
        WHEN bad_start THEN 'bad start_time' WHEN trim(subject) = '' THEN 'SKIP'
        WHEN day NOT IN ('Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday') THEN 'unknown day: ' || day
        WHEN teacher_id IS NULL THEN 'unknown teacher: ' || teacher_employee_id
        WHEN s IS NULL THEN 'start and end are required' WHEN s >= e THEN 'start is not before end'
        WHEN EXISTS (SELECT 1 FROM booked k WHERE k.teacher_id = known.teacher_id AND k.day_of_week = known.day
                     AND known.s < k.end_min AND known.e > k.start_min) THEN 'teacher is booked'
        WHEN EXISTS (SELECT 1 FROM booked k WHERE k.school_class_id = known.class_id AND k.day_of_week = known.day
                     AND known.s < k.end_min AND known.e > k.start_min) THEN 'class is booked' END AS verdict FROM known)"""


def _timetable_import(v, check_batch=False):
    rows = v.spark.sql(TIMETABLE_SHEET_SQL.replace("FROM orders", "FROM {source}"), source=v.orders)
    return ingest.import_timetable(rows, v.branch, v.teacher, v.school_class, v.timetable,
                                   check_batch)


@query("io3_import_timetable_report", "branch teacher school_class timetable", TIMETABLE_STATUS_SQL + """
    SELECT row_no, CASE WHEN verdict IS NULL THEN 'ok' WHEN verdict = 'SKIP' THEN 'skip' ELSE 'fail' END AS status,
           CASE WHEN verdict <> 'SKIP' THEN verdict END AS error FROM judged""")
def io3_report(v):
    return _timetable_import(v)[1]


@query("io3_import_timetable_classes", "branch teacher school_class timetable", TIMETABLE_STATUS_SQL + """
    SELECT DISTINCT branch_id, class_name, section FROM judged WHERE branch_id IS NOT NULL AND class_id IS NULL""")
def io3_classes(v):
    return _timetable_import(v)[2]


@query("io3_import_timetable_batch_check", "branch teacher school_class timetable", TIMETABLE_STATUS_SQL + """
    , good AS (SELECT * FROM judged WHERE verdict IS NULL),
    clash AS (SELECT g.row_no,
        EXISTS (SELECT 1 FROM good o WHERE o.teacher_id = g.teacher_id AND o.day = g.day AND o.row_no < g.row_no
                AND g.s < o.e AND g.e > o.s) AS t,
        EXISTS (SELECT 1 FROM good o WHERE o.branch_id = g.branch_id AND o.class_name = g.class_name
                AND o.section = g.section AND o.day = g.day AND o.row_no < g.row_no AND g.s < o.e AND g.e > o.s) AS c
        FROM good g)
    SELECT row_no, CASE WHEN t OR c THEN 'fail' ELSE 'ok' END AS status,
           CASE WHEN t THEN 'teacher is booked in this file' WHEN c THEN 'class is booked in this file' END AS error FROM clash
    UNION ALL
    SELECT row_no, CASE WHEN verdict = 'SKIP' THEN 'skip' ELSE 'fail' END, CASE WHEN verdict <> 'SKIP' THEN verdict END
    FROM judged WHERE verdict IS NOT NULL""")
def io3_batch(v):
    return _timetable_import(v, check_batch=True)[1]


# ---------------------------------------------------------------- sinks
@query("io7_upsert_attendance", "attendance", """
    WITH stored AS (SELECT DISTINCT student_id, branch_id, date FROM attendance WHERE date < DATE '1996-01-01'),
    first_mark AS (SELECT branch_id, student_id, date, min(time_min) AS time_min FROM attendance GROUP BY ALL)
    SELECT branch_id, student_id, CAST(date AS STRING) AS date, time_min FROM first_mark f
    WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.student_id = f.student_id AND s.branch_id = f.branch_id
                      AND s.date = f.date)""")
def io7(v):
    stored = v.attendance.filter("date < DATE'1996-01-01'")
    return sinks.new_attendance(v.attendance, stored).select(
        "branch_id", "student_id", F.col("date").cast("string").alias("date"), "time_min")


@query("io8_rejection_rows", "camera_match", """
    SELECT branch_id, 'duplicate_face' AS reason, 'student' AS role, person_id,
           coalesce(CASE WHEN event_id % 3 = 0 THEN 'admin-1' END, 'sub-' || CAST(branch_id AS STRING)) AS admin_id,
           round(similarity, 6) AS similarity, 0.75 AS threshold, 'match' AS message
    FROM camera_match WHERE similarity >= 0.75""")
def io8(v):
    rejected = v.camera_match.filter("similarity >= 0.75").selectExpr(
        "branch_id", "'duplicate_face' AS reason", "'student' AS role", "person_id",
        "CASE WHEN event_id % 3 = 0 THEN 'admin-1' END AS admin_id", "concat('sub-', branch_id) AS sub",
        "round(similarity, 6) AS similarity", "0.75D AS threshold", "'match' AS message")
    return sinks.rejection_rows(rejected)


# ---------------------------------------------------------------- capture quality
def _gate_sql(enrolment):
    extra = """WHEN blur < 60 THEN 'blur_not_allowed_enrollment'
               WHEN face_area_ratio < 0.08 THEN 'face_too_small_enrollment'""" if enrolment else ""
    limit = 0.70 if enrolment else 0.52
    return f"""
    WITH stopped AS (SELECT *, CASE WHEN blur < 10 THEN 'extreme_blur' WHEN contrast < 10 THEN 'low_contrast'
        WHEN face_area_ratio < 0.02 THEN 'face_too_small_extreme' WHEN blur < 40 THEN 'too_blurry_hard'
        WHEN brightness < 25 THEN 'extreme_low_light' WHEN face_area_ratio < 0.05 THEN 'face_too_small_hard'
        {extra} END AS stop FROM capture),
    scored AS (SELECT *, CASE WHEN stop IS NOT NULL THEN 0.0 ELSE
        (0.45 * pow(greatest(0.0, least(1.0, (blur - 50) / 150)), 1.2)
         + 0.30 * pow(greatest(0.0, least(1.0, (brightness - 50) / 100)), 1.1)
         + 0.25 * greatest(0.0, least(1.0, (face_area_ratio - 0.05) / 0.15)))
        * CASE WHEN blur < 70 THEN 0.75 ELSE 1.0 END * CASE WHEN brightness < 45 THEN 0.8 ELSE 1.0 END END AS raw FROM stopped),
    gated AS (SELECT capture_id, raw, round(raw, 6) AS score, stop IS NULL AND raw >= {limit} AS accept,
        CASE WHEN stop IS NOT NULL THEN stop WHEN raw >= {limit} THEN NULL WHEN blur < 70 THEN 'too_blurry'
             WHEN brightness < 50 THEN 'low_light' WHEN face_area_ratio < 0.1 THEN 'face_too_small'
             ELSE 'low_quality' END AS reason FROM scored)"""


def _tier_sql(enrolment):
    low = "'enrolment rejected: ' || coalesce(reason, 'low_quality')" if enrolment else \
        "'low quality: ' || coalesce(reason, 'unknown')"
    return _gate_sql(enrolment) + f"""
    SELECT capture_id, score, CASE WHEN raw >= 0.8 THEN 'High' WHEN raw >= 0.65 THEN 'Medium' WHEN raw >= 0.5 THEN 'Low'
           ELSE 'Reject' END AS tier, raw >= {0.65 if enrolment else 0.5} AS proceed,
           CASE WHEN raw >= 0.65 THEN NULL WHEN raw >= 0.5 THEN {low}
                ELSE 'image rejected: ' || coalesce(reason, 'unknown') END AS warning FROM gated"""


def _register_quality(enrolment, suffix):
    @query(f"q1_quality_gate_{suffix}", "capture",
           _gate_sql(enrolment) + " SELECT capture_id, score, accept, reason FROM gated")
    def gate(v):
        return capture.quality_gate(v.capture, enrolment).select(
            "capture_id", F.round("score", 6).alias("score"), "accept", "reason")

    @query(f"q2_quality_tier_{suffix}", "capture", _tier_sql(enrolment))
    def graded(v):
        scored = capture.quality_gate(v.capture, enrolment)
        return capture.quality_tier(scored, enrolment).select(
            "capture_id", F.round("score", 6).alias("score"), "tier", "proceed", "warning")


_register_quality(True, "enrol")
_register_quality(False, "attend")


@query("q3_best_candidate", "box", """
    WITH d AS (SELECT frame AS image_id, x, y, CAST(width AS DOUBLE) AS w, CAST(height AS DOUBLE) AS h,
                      (box_id % 100) / 1000.0 AS score FROM box),
    r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score * sqrt(w * h) DESC, x, y) AS n FROM d)
    SELECT image_id, x, y, w, h, round(score * sqrt(w * h), 6) AS weight FROM r
    WHERE n = 1 AND score * sqrt(w * h) >= 0.7 AND w >= 80 AND h >= 80 AND w / h BETWEEN 0.5 AND 1.8""")
def q3(v):
    faces = v.box.selectExpr("frame AS image_id", "x", "y", "CAST(width AS DOUBLE) AS w", "CAST(height AS DOUBLE) AS h",
                             "CAST(box_id % 100 AS DOUBLE) / 1000 AS score")
    return capture.best_candidate(faces).select("image_id", "x", "y", "w", "h", F.round("weight", 6).alias("weight"))


@query("q4_admit_images", "", """
    SELECT l_orderkey * 8 + l_linenumber AS image_id, w, h, w >= 100 AND h >= 100 AND w / h BETWEEN 0.3 AND 3.0 AS admitted,
           CAST(trunc(w * CASE WHEN greatest(w, h) > 1280 THEN 1280.0 / greatest(w, h) ELSE 1.0 END) AS INT) AS target_width,
           CAST(trunc(h * CASE WHEN greatest(w, h) > 1280 THEN 1280.0 / greatest(w, h) ELSE 1.0 END) AS INT) AS target_height
    FROM (SELECT *, CAST(50 + l_partkey % 2003 AS INT) AS w, CAST(60 + l_suppkey * 17 % 1507 AS INT) AS h FROM lineitem)""")
def q4(v):
    meta = v.lineitem.selectExpr("l_orderkey * 8 + l_linenumber AS image_id", "CAST(50 + l_partkey % 2003 AS INT) AS width",
                                 "CAST(60 + l_suppkey * 17 % 1507 AS INT) AS height")
    return capture.admit_images(meta).withColumnsRenamed({"width": "w", "height": "h"})


@query("q4_admit_profile_files", "", """
    SELECT l_orderkey * 8 + l_linenumber AS image_id, CAST(l_extendedprice * 60 AS BIGINT) AS size_bytes FROM lineitem
    WHERE CAST(l_extendedprice * 60 AS BIGINT) <= 2097152""")
def q4_files(v):
    return capture.admit_profile_files(v.lineitem.selectExpr(
        "l_orderkey * 8 + l_linenumber AS image_id", "CAST(round(l_extendedprice * 60) AS BIGINT) AS size_bytes"))


@query("q5_argmax_class", "", """
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE
        WHEN l_tax >= greatest(l_discount, l_quantity / 1000) THEN 2
        WHEN l_quantity / 1000 >= greatest(l_discount, l_tax) THEN 1 ELSE 0 END AS INT) AS class_index FROM lineitem""")
def q5(v):
    scores = v.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey",
                                   "array(l_discount, l_quantity / 1000, l_tax) AS scores")
    return capture.class_of(scores).drop("scores")
