import numpy as np
import pytest
from pyspark.sql import functions as F

from rollgrid.functions.clock import clock_is_bad, clock_minutes
from rollgrid.functions.geo import haversine_m, iou
from rollgrid.functions.quality import argmax_class
from rollgrid.operators import analytics, bookings, capture, directory, ingest, maintenance, spatial
from rollgrid.operators.numbering import number_rows
from rollgrid.sources import sheets, sinks


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


# ------------------------------------------------------------ analytics, directory
def test_rates_and_ties(spark):
    people = frame(spark, [(1, "a"), (2, "b"), (3, "c")], "id bigint, name string")
    facts = frame(spark, [(1, "Present"), (1, "Absent"), (2, "Absent")], "student_id bigint, status string")
    rates = analytics.attendance_rate(people, facts, "student_id")
    assert {r.id: (r.total, r.present, r.rate) for r in rates.collect()} == {1: (2, 1, 50.0), 2: (1, 0, 0.0), 3: (0, 0, 0.0)}
    assert analytics.most_absent(rates).first().id == 2
    assert analytics.most_absent(rates.filter("false")).count() == 0


def test_search_ignores_placeholder_branches(spark):
    people = frame(spark, [(1, "Ann", "7", "X", 1), (2, "anna", "8", "Y", 2)],
                   "id bigint, name string, roll_no string, class_name string, branch_id bigint")
    for branch in (None, "", "undefined", "null", "abc"):
        assert directory.search_directory(people, name="AN", branch=branch).count() == 2
    assert directory.search_directory(people, branch=" 2 ").first().id == 2


def test_pages(spark):
    rows = spark.range(23).withColumnRenamed("id", "n")
    def ids(page, **kw):
        return [r.n for r in directory.page(rows, ["n"], page, **kw).collect()]
    assert ids("x") == list(range(10)) and ids(3) == [20, 21, 22]
    assert ids(99) == ids(0) == ids(-5) == [20, 21, 22]
    assert ids(2, size=500, clamp=False, max_size=20) == [20, 21, 22] and ids(9, clamp=False) == []
    assert ids(2, size=7, clamp=False, deep_from=3) == list(range(7, 14))
    assert directory.page(rows.filter("false"), ["n"], 1).count() == 0


def test_row_numbers_of_a_skewed_key(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if rng.random() < 0.8 else "cold", float(rng.integers(0, 50)) ** 3, i) for i in range(400)]
    rows += [("hot", None, 1000), ("cold", None, 1001)]
    df = frame(spark, rows, "k string, t double, i bigint")
    got = number_rows(df.repartition(9), ["k"], ["t", "i"], "n", parts=7).collect()
    for key in ("hot", "cold"):
        mine = sorted((r for r in got if r.k == key), key=lambda r: (r.t is not None, r.t or 0, r.i))
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))


def test_row_numbers_by_text_falling_and_with_an_outlier(spark):
    rows = [(f"w{i % 37:02d}", i) for i in range(500)] + [("zz", 10**15)]
    df = frame(spark, rows, "w string, i bigint")
    got = {r.i: r.n for r in number_rows(df, [], [F.col("w").desc(), "i"], "n", parts=5).collect()}
    expected = sorted(rows, key=lambda r: (r[0], -r[1]), reverse=True)
    assert [got[i] for _, i in expected] == list(range(1, len(rows) + 1))
    ranged = number_rows(df, [], ["i"], "n", parts=5)
    assert [r.n for r in ranged.orderBy("i").collect()] == list(range(1, len(rows) + 1))


def test_pages_by_text_are_the_same_however_deep(spark):
    df = frame(spark, [(f"d{i % 7}", i % 50, i) for i in range(300)], "day string, start int, id bigint")
    for number in (1, 9, 40):
        top, deep = (directory.page(df, ["day", "start", "id"], number, size=8, clamp=False, deep_from=d).collect()
                     for d in (10**6, 0))
        assert top == deep and all(r.total == 300 for r in top)


def test_undefined_filters_nothing(spark):
    df = frame(spark, [(1, "Ann", "R1", "C1", 1)], "id int, name string, roll_no string, class_name string, branch_id int")
    assert directory.search_directory(df, name="undefined", key="undefined", class_name="undefined").count() == 1


def test_white_space_of_any_kind_is_stripped(spark):
    from rollgrid.functions.clock import clock_minutes, stripped

    df = frame(spark, [("\t\u00a0 Main \u2003\r\n", "\u00a09:05\t")], "name string, at string")
    row = df.select(stripped("name").alias("name"), clock_minutes(F.col("at")).alias("at")).first()
    assert (row.name, row.at) == ("Main", 545)


def test_repeated_patches_keep_the_rows(spark):
    table = frame(spark, [(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    patches = frame(spark, [(1, 1, "p", True, None, False), (1, 2, "q", True, 9, True), (1, 3, None, False, None, True)],
                    "id int, at int, x string, has_x boolean, y int, has_y boolean")
    got = maintenance.apply_updates(table, patches, ["id"], ["x", "y"], order="at")
    assert sorted(map(tuple, got.collect())) == [(1, "q", None), (2, "b", 2)]


def test_cascade_over_several_levels(spark):
    tables = {
        "organization": frame(spark, [(1,), (2,)], "id int"),
        "branch": frame(spark, [(10, 1), (20, 2)], "id int, organization_id int"),
        "student": frame(spark, [(100, 10, 5), (200, 20, 6)], "id int, branch_id int, department_id int"),
        "department": frame(spark, [(5, 10), (6, 10)], "id int, branch_id int"),
        "attendance": frame(spark, [(1000, 100), (2000, 200)], "id int, student_id int"),
    }
    rules = [("organization", "branch", "organization_id"), ("branch", "department", "branch_id"),
             ("branch", "student", "branch_id"), ("student", "attendance", "student_id")]
    left = maintenance.cascade_tree(tables, "organization", frame(spark, [(1,)], "id int"), rules, [("department", "student", "department_id")])
    assert {n: sorted(map(tuple, t.collect())) for n, t in left.items()} == {
        "organization": [(2,)], "branch": [(20, 2)], "student": [(200, 20, None)], "department": [], "attendance": [(2000, 200)]}


def test_scans_check_in_only_people_of_the_branch(spark):
    from rollgrid.operators import presence

    scans = frame(spark, [(1, "c", "007", 5)], "event_id bigint, code string, person string, us bigint")
    sessions = frame(spark, [("c", 2, 100, 0, False)], "code string, branch_id int, expires_us bigint, grace_seconds int, used boolean")
    students = frame(spark, [(70, 1, "007"), (71, 2, "007")], "id bigint, branch_id int, roll_no string")
    assert [r.student_id for r in presence.check_in(presence.validate_scans(scans, sessions), students).collect()] == [71]


def test_unreadable_snapshot_files_are_counted(spark, tmp_path):
    from rollgrid import schemas
    from rollgrid.sources import snapshots

    row = {"school_id": "s", "role": "student", "deleted": False, "embedding": [1.0, 0.0], "id": 1}
    gallery = spark.createDataFrame([row], "school_id string, role string, deleted boolean, embedding array<float>, id bigint")
    for field in schemas.GALLERY.split(", "):
        name, kind = field.split(" ", 1)
        if name not in gallery.columns:
            gallery = gallery.withColumn(name, F.lit(None).cast(kind))
    both = gallery.unionByName(gallery.withColumns({"school_id": F.lit("t"), "id": F.lit(2).cast("bigint")}))
    snapshots.write_snapshot(both, str(tmp_path), "v1")
    assert snapshots.unreadable_files(spark, str(tmp_path), "v1") == []
    broken = next(tmp_path.glob("version=v1/school_id=t/*/*.parquet"))
    broken.write_bytes(b"nothing")
    for crc in broken.parent.glob(".*.crc"):
        crc.unlink()
    assert snapshots.unreadable_files(spark, str(tmp_path), "v1") == [broken.name]
    assert snapshots.read_snapshot(spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, str(tmp_path), strict=True)


def test_stored_rows_are_read_for_the_dates_of_the_batch(spark, tmp_path):
    from rollgrid.sources import sinks

    stored = spark.range(6).selectExpr("id", "date_add(DATE'2024-01-01', CAST(id AS INT)) AS date")
    stored.write.partitionBy("date").parquet(str(tmp_path / "t"))
    batch = spark.sql("SELECT DATE'2024-01-03' AS date")
    kept = sinks.of_dates(spark.read.parquet(str(tmp_path / "t")), batch)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 1 and "PartitionFilters: [isnotnull(date" in plan and "2024-01-03" in plan


def test_odd_bookings_follow_the_plain_predicate(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 3)), "Monday", int(a), int(b)) for i, (a, b) in enumerate(rng.integers(500, 560, (120, 2)))]
    df = frame(spark, rows, "id bigint, teacher_id int, day_of_week string, start_min int, end_min int")
    meets = lambda a, b: a[1] == b[1] and a[3] < b[4] and a[4] > b[3]
    expected = {a[0]: n for a in rows if (n := sum(meets(a, b) for b in rows if a[0] != b[0]))}
    assert {r.id: r.n_conflicts for r in bookings.self_conflicts(df, "teacher_id").collect()} == expected
    new = df.filter("id < 40")
    stored = df.filter("id >= 40")
    hit = {r.id for r in bookings.conflicts(new, stored, "teacher_id").collect()}
    assert hit == {a[0] for a in rows[:40] if any(meets(a, b) for b in rows[40:])}


# ------------------------------------------------------------ bookings
def random_bookings(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        start = int(rng.integers(0, 200))
        rows.append((i, int(rng.integers(0, 3)), "Monday", start, start + int(rng.integers(1, 30))))
    return rows, frame(spark, rows, "id bigint, teacher_id bigint, day_of_week string, start_min int, end_min int")


@pytest.mark.parametrize("n", [5, 60])
def test_conflicts_equal_brute_force(spark, n):
    rows, booked = random_bookings(spark, n, n)
    asked, new = random_bookings(spark, 80, 99)
    hit = {a[0] for a in asked if any(a[1] == b[1] and a[3] < b[4] and a[4] > b[3] for b in rows)}
    assert {r.id for r in bookings.conflicts(new, booked, "teacher_id").collect()} == hit
    assert {r.id for r in bookings.free_rows(new, booked, ["teacher_id", "day_of_week"]).collect()} == {a[0] for a in asked} - hit
    counts = {a[0]: sum(a[0] != b[0] and a[1] == b[1] and a[3] < b[4] and a[4] > b[3] for b in rows) for a in rows}
    got = {r.id: r.n_conflicts for r in bookings.self_conflicts(booked, "teacher_id").collect()}
    assert got == {i: c for i, c in counts.items() if c}


def test_touching_is_no_conflict(spark):
    ddl = "teacher_id bigint, day_of_week string, start_min int, end_min int"
    booked = frame(spark, [(1, "Monday", 540, 600)], ddl)
    new = frame(spark, [(1, "Monday", 480, 540), (1, "Monday", 600, 660), (1, "Tuesday", 550, 560), (2, "Monday", 550, 560)], ddl)
    assert bookings.conflicts(new, booked, "teacher_id").count() == 0


# ------------------------------------------------------------ imports
def test_clock(spark):
    cases = [("9:00", 540), ("09:00", 540), (" 9:5 ", 545), ("23:59", 1439), ("0:00", 0), ("25:00", None), ("9:60", None),
             ("9", None), ("", None), (None, None), ("9:00:00", None)]
    df = frame(spark, cases, "t string, want int")
    for r in df.select("t", "want", clock_minutes(F.col("t")).alias("m"), clock_is_bad(F.col("t")).alias("bad")).collect():
        assert r.m == r.want
        assert r.bad == (r.want is None and bool((r.t or "").strip()))


BRANCHES = ([(1, "Main"), (2, "North "), (3, "Main")], "id bigint, name string")


def test_student_import_verdicts(spark):
    sheet = [(2, " 1 ", "Ann", "X", "A", " North ", "Sci"), (3, "1", "Bob", "X", "A", "North", None),
             (4, "2", None, "X", "A", "North", None), (5, "3", "Cy", "X", "A", "Nowhere", None),
             (6, "4", "Di", "X", "A", "Main", "none"), (7, "9", "Ed", "X", "A", "North", None), (8, "5", "Flo", "X", "A", None, None)]
    rows = frame(spark, sheet, "row_no bigint, roll_no string, name string, class_name string, section string, branch string, department string")
    stored = frame(spark, [(2, "9"), (2, "9")], "branch_id bigint, roll_no string")
    departments = frame(spark, [(7, "Sci")], "id bigint, name string")
    accepted, report = ingest.import_students(rows, frame(spark, *BRANCHES), departments, stored)
    got = {r.row_no: (r.status, r.error) for r in report.collect()}
    assert got == {2: ("ok", None), 3: ("fail", "duplicate in file"), 4: ("fail", "name is blank"),
                   5: ("fail", "unknown branch: Nowhere"), 6: ("ok", None), 7: ("skip", None), 8: ("fail", "unknown branch: ")}
    kept = {r.roll_no: (r.branch_id, r.department_id) for r in accepted.collect()}
    assert kept == {"1": (2, 7), "4": (3, None)}  # of two branches called Main the later one
    with pytest.raises(ValueError, match="section"):
        ingest.import_students(rows.drop("section"), frame(spark, *BRANCHES), departments, stored)


def test_timetable_import_verdicts(spark):
    def line(no, **changes):
        cells = {"branch": "Main", "class_name": "C", "section": "A", "subject": "Art", "teacher_employee_id": "T1",
                 "day_of_week": "monday", "start_time": "9:00", "end_time": "10:00", **changes}
        return (no, *cells.values())

    sheet = [
        line(2), line(3, start_time="9:30", end_time="10:30"), line(4, branch="X"), line(5, start_time="25:00", subject=""),
        line(6, subject=" "), line(7, day_of_week="Noday"), line(8, teacher_employee_id="T9"), line(9, start_time=None),
        line(10, start_time="10:00"), line(11, start_time="11:00", end_time="12:00"),
        line(12, teacher_employee_id="T2", start_time="11:30", end_time="12:30"), line(13, start_time="12:00", end_time="13:00"),
        line(14, section="New", day_of_week="SUNDAY"),
    ]
    ddl = "row_no bigint, branch string, class_name string, section string, subject string, teacher_employee_id string, " \
          "day_of_week string, start_time string, end_time string"
    teachers = frame(spark, [(1, "T1"), (2, "T2")], "id bigint, employee_id string")
    classes = frame(spark, [(5, 3, "C", "A")], "id bigint, branch_id bigint, class_name string, section string")
    booked = frame(spark, [(1, 9, "Monday", 690, 720), (2, 5, "Monday", 690, 720)],
                   "teacher_id bigint, school_class_id bigint, day_of_week string, start_min int, end_min int")
    def judge(check_batch):
        accepted, report, fresh = ingest.import_timetable(
            frame(spark, sheet, ddl), frame(spark, *BRANCHES), teachers, classes, booked, check_batch)
        return accepted, {r.row_no: (r.status, r.error) for r in report.collect()}, fresh
    accepted, got, fresh = judge(False)
    assert got == {
        2: ("ok", None), 3: ("ok", None), 4: ("fail", "unknown branch: X"), 5: ("fail", "bad start_time"), 6: ("skip", None),
        7: ("fail", "unknown day: Noday"), 8: ("fail", "unknown teacher: T9"), 9: ("fail", "start and end are required"),
        10: ("fail", "start is not before end"), 11: ("fail", "teacher is booked"), 12: ("fail", "teacher is booked"),
        13: ("ok", None), 14: ("ok", None)}
    assert [(r.class_name, r.section) for r in fresh.collect()] == [("C", "New")]
    assert accepted.count() == 4
    checked = judge(True)[1]
    assert checked[3] == ("fail", "teacher is booked in this file") and checked[2][0] == checked[13][0] == "ok"


def test_sheet_rows_are_numbered_in_file_order(spark, tmp_path):
    folder = tmp_path / "sheet"
    spark.range(100).selectExpr("id AS n", "'x' AS t").repartitionByRange(4, "n").sortWithinPartitions("n").write.option(
        "header", True).csv(str(folder))
    rows = sheets.read_sheet(spark, str(folder)).collect()
    assert sorted(r.row_no for r in rows) == list(range(2, 102))
    one = tmp_path / "one.csv"
    one.write_text("n,t\n" + "".join(f"{i},\n" for i in range(50)))
    assert [(r.n, r.row_no, r.t) for r in sheets.read_sheet(spark, str(one)).orderBy("row_no").collect()] == [
        (str(i), i + 2, None) for i in range(50)]


def test_list_columns_survive_bad_json(spark):
    rows = frame(spark, [(2, "1", "A", "Main", "", '["x", "y"]', "oops"), (3, "2", "B", "Main", "", None, "")],
                 "row_no bigint, employee_id string, name string, branch string, department string, subjects string, can_teach_classes string")
    none = frame(spark, [], "id bigint, name string")
    stored = frame(spark, [], "branch_id bigint, employee_id string")
    accepted, _ = ingest.import_teachers(rows, frame(spark, *BRANCHES), none, stored)
    assert {r.employee_id: (r.subjects, r.can_teach_classes) for r in accepted.collect()} == {"1": (["x", "y"], []), "2": ([], [])}


# ------------------------------------------------------------ geography, capture
def test_iou_fixtures(spark):
    box = "struct<x: int, y: int, width: int, height: int>"
    cases = [((0, 0, 10, 10), (20, 20, 10, 10), 0.0), ((5, 5, 20, 20), (5, 5, 20, 20), 1.0),
             ((0, 0, 10, 10), (5, 5, 10, 10), 25 / 175), ((0, 0, 10, 10), (10, 0, 10, 10), 0.0)]
    df = frame(spark, cases, f"a {box}, b {box}, want double")
    for r in df.withColumn("got", iou(F.col("a"), F.col("b"))).collect():
        assert r.got == pytest.approx(r.want)


@pytest.mark.parametrize("cell", [7, 64, 1000])
def test_box_overlap_equals_brute_force(spark, cell):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 2)), i, tuple(int(x) for x in (*rng.integers(-50, 100, 2), *rng.integers(0, 40, 2)))) for i in range(60)]
    boxes = frame(spark, rows, "frame bigint, box_id bigint, bbox struct<x: int, y: int, width: int, height: int>")
    def overlap(a, b):
        w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if w > 0 and h > 0 else 0
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and overlap(a[2], b[2]) >= 0.1}
    got = [(r.a_id, r.b_id) for r in spatial.box_overlap(boxes, boxes, ["frame"], 0.1, cell).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_geofence_without_coordinates(spark):
    points = frame(spark, [(1, 1, 0.0, 0.0), (2, 2, 0.0, 0.0), (3, 3, 0.0, 0.0), (4, 1, 0.001, 0.0)],
                   "event_id bigint, branch_id bigint, lat double, lon double")
    branches = frame(spark, [(1, 0.0, 0.0, 75), (2, None, None, 75)],
                     "id bigint, latitude double, longitude double, attendance_radius int")
    assert {r.event_id: r.inside for r in spatial.geofence(points, branches).collect()} == {1: True, 2: False, 3: False, 4: False}
    half = spark.range(1).select(haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0]
    assert half == pytest.approx(np.pi * 6_371_000)


def test_argmax_takes_the_last_of_equals(spark):
    df = frame(spark, [([0.1, 0.7, 0.7],), ([3.0],), ([],)], "s array<double>")
    assert [r[0] for r in df.select(argmax_class(F.col("s"))).collect()] == [2, 0, None]


def test_best_candidate_and_admission(spark):
    faces = frame(spark, [(1, 0, 0, 100.0, 100.0, 0.9), (1, 5, 0, 50.0, 50.0, 0.99), (2, 0, 0, 300.0, 100.0, 0.9), (3, 0, 0, 60.0, 60.0, 0.9)],
                  "image_id bigint, x int, y int, w double, h double, score double")
    assert [(r.image_id, r.w) for r in capture.best_candidate(faces).collect()] == [(1, 100.0)]
    images = frame(spark, [(2000, 1000), (99, 200), (100, 400), (640, 480)], "width int, height int")
    assert [(r.admitted, r.target_width, r.target_height) for r in capture.admit_images(images).collect()] == [
        (True, 1280, 640), (False, 99, 200), (False, 100, 400), (True, 640, 480)]


# ------------------------------------------------------------ sinks, maintenance
def test_attendance_sink_is_idempotent(spark, tmp_path):
    ddl = "branch_id bigint, student_id bigint, teacher_id bigint, timetable_id bigint, date date, time_min int, status string"
    day = F.to_date(F.lit("2024-01-02"))
    batch = frame(spark, [(1, 5, None, None, None, 500, "Present"), (1, 5, None, None, None, 480, "Present"),
                          (1, None, 5, None, None, 490, "Present"), (1, 5, 5, None, None, 1, "Present")], ddl).withColumn("date", day)
    path = str(tmp_path / "attendance")
    for _ in range(3):
        sinks.upsert_attendance(batch, path)
    rows = sinks.read_attendance(spark, path).collect()
    assert sorted((r.student_id or 0, r.teacher_id or 0, r.time_min) for r in rows) == [(0, 5, 490), (5, 0, 480)]


def test_rejections_carry_no_vectors(spark, tmp_path):
    rows = frame(spark, [(1, "duplicate_face", "student", "7", None, "s1", 0.9, 0.75, "m", [0.1])],
                 "branch_id bigint, reason string, role string, person_id string, admin_id string, sub string, similarity double, "
                 "threshold double, message string, embedding array<double>")
    sinks.log_rejections(rows, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert "embedding" not in back.columns and back.first().admin_id == "s1"


def test_patches_can_set_null(spark):
    table = frame(spark, [(1, "a", 5), (2, "b", 6)], "id bigint, name string, n int")
    patch = frame(spark, [(1, None, True, 9, False)], "id bigint, name string, has_name boolean, n int, has_n boolean")
    got = maintenance.apply_updates(table, patch, ["id"], ["name", "n"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, None, 5), (2, "b", 6)]


def test_backfill(spark):
    facts = frame(spark, [("s1", "student", None), ("t1", "teacher", None), ("x", "student", None), ("s1", "teacher", 9)],
                  "person_id string, person_type string, branch_id bigint")
    students = frame(spark, [(1, "s1", 4), (2, "s1", 5)], "id bigint, roll_no string, branch_id bigint")
    teachers = frame(spark, [(1, "t1", 6), (2, "s1", 7)], "id bigint, employee_id string, branch_id bigint")
    first = directory.lowest_branch(frame(spark, [(3,), (2,)], "id bigint"))
    images = directory.backfill_images(facts, students, teachers, first).collect()
    assert sorted((r.person_id, r.person_type, r.branch_id) for r in images) == [
        ("s1", "student", 5), ("s1", "teacher", 9), ("t1", "teacher", 6), ("x", "student", 2)]


def test_absences_are_summed_once_per_weekday(spark):
    """What is missed is the same on every Monday, so bookings are grouped before they meet the dates."""
    timetable = spark.createDataFrame(
        [(i, i % 3, i % 5, "Monday" if i % 2 else "Tuesday", 500 + i, 540 + i, "s") for i in range(60)],
        "id bigint, teacher_id bigint, school_class_id bigint, day_of_week string, start_min int, end_min int, subject string")
    classes = spark.createDataFrame([(i, f"c{i}", None if i == 3 else "x") for i in range(4)], "id bigint, class_name string, section string")
    absences = spark.range(200).selectExpr("id % 4 AS teacher_id", "date_add(DATE'2024-01-01', CAST(id AS INT)) AS date")
    got = bookings.absence_summary(absences, timetable, classes)
    want = bookings.absent_periods(absences, timetable, classes).groupBy("teacher_id", "date").agg(
        F.count("*").alias("n_periods"), F.count_distinct("school_class_id").alias("n_classes"), F.min("start_min").alias("first_start"),
        F.max("end_min").alias("last_end"), F.max(F.concat("class_name", F.lit(" "), "section")).alias("last_class"))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) != []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner, ((teacher_id") < plan.index("Aggregate [teacher_id")  # the dates join what is already grouped


def test_minutes_are_laid_out_per_slot(spark):
    rows = spark.createDataFrame([(n, 1, 480 + 10 * (n % 3), 500 + 10 * (n % 3)) for n in range(40)] + [(40, 1, 520, 530), (41, 2, 480, 490)],
                                 "row_no bigint, teacher_id bigint, start_min int, end_min int")
    flagged = bookings.earlier_overlap(rows, ["teacher_id"], "row_no", "late", F.col("row_no") != 1)
    got = {r.row_no for r in flagged.collect() if r.late}
    assert got == set(range(3, 40))
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.rindex("Generate"):]  # what is laid out is summed first


def test_self_conflicts_move_a_slot_not_its_edges(spark):
    from rollgrid.operators import bookings as b

    rows = [(1, 7, "Monday", 10, 20), (2, 7, "Monday", 10, 20), (3, 7, "Monday", 20, 30), (4, 7, "Monday", 5, 11),
            (5, 7, "Tuesday", 10, 20), (6, None, "Monday", 10, 20), (7, None, "Monday", 10, 20), (8, 8, "Monday", 0, 1440), (9, 8, "Monday", 19, 20)]
    table = spark.createDataFrame(rows, "id bigint, teacher_id bigint, day_of_week string, start_min int, end_min int")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = b.self_conflicts(table, "teacher_id").select("id", "n_conflicts")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in found.collect()} == {(1, 2), (2, 2), (4, 2), (8, 1), (9, 1)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning") <= 4 and "explode" in plan  # slots twice, bookings and numbers once


def test_sums_of_a_crowd_beyond_a_bigint(spark):
    """The sum of ids stays a BIGINT where it is one, and is exact where it is not."""
    from rollgrid.plans.booking_queries import crowd_sums

    small = [(1, 5, 6, 0.5), (1, 7, 8, 0.25), (2, None, 9, 0.5)]
    large = [(1, 2**57, 2**57, 0.5), (1, 2**57, 2**57 + 1, 0.25), (2, 3, 4, 0.5)]
    for rows, kind in ((small, "bigint"), (large, "decimal(38,0)")):
        got = crowd_sums(frame(spark, rows, "frame bigint, a_id bigint, b_id bigint, iou double"))
        assert got.dtypes == [("frame", "bigint"), ("pairs", "bigint"), ("members", kind), ("iou", "double")]
        want = {k: sum(a * 31 + b * 17 for f, a, b, _ in rows if f == k and a is not None) or None for k in (1, 2)}
        assert {r.frame: None if r.members is None else int(r.members) for r in got.collect()} == want
