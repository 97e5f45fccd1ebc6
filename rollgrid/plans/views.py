"""Domain views over the test tables.

Each view is one SELECT that Spark and DuckDB both understand; the few functions whose names
differ come from ``Dialect``. Spark runs the text over DataFrames, the checks put the same text
into WITH clauses, so both sides start from the same rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rollgrid.session import configure

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@dataclass(frozen=True)
class Dialect:
    micros: str
    dayname: str
    nudged: str
    pair: str
    words: str
    vectors: str

    def us(self, column: str) -> str:
        return self.micros.format(column)


SPARK = Dialect(
    micros="unix_micros(CAST({0} AS TIMESTAMP))",
    dayname="date_format({0}, 'EEEE')",
    nudged="transform(embedding, (x, i) -> CAST(x AS DOUBLE) + {0} * sin(i + {1}) / 8)",
    pair="array({0}, {1})",
    words="array({0}, {1})",
    vectors="$vectors",
)
DUCK = Dialect(
    micros="epoch_us({0})",
    dayname="dayname({0})",
    nudged="list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + {0} * sin((i - 1) + {1}) / 8)",
    pair="[{0}, {1}]",
    words="[{0}, {1}]",
    vectors="(SELECT count(*) FROM embeddings)",
)


def _views(d: Dialect) -> dict[str, str]:
    return {
        "organization": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region",
        "branch": """
            SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS organization_id,
                   n_name AS name, CAST(n_nationkey * 3 - 36 AS DOUBLE) AS latitude,
                   CAST(n_nationkey * 7 - 80 AS DOUBLE) AS longitude, 75 AS attendance_radius
            FROM nation""",
        "department": """
            SELECT DISTINCT CAST(c_nationkey * 100 + ascii(c_mktsegment) AS BIGINT) AS id,
                   CAST(c_nationkey AS BIGINT) AS branch_id, c_mktsegment AS name
            FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
        "student": """
            SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS branch_id,
                   CASE WHEN c_mktsegment <> 'MACHINERY'
                        THEN CAST(c_nationkey * 100 + ascii(c_mktsegment) AS BIGINT) END AS department_id,
                   c_name AS name, right(c_name, 9) AS roll_no, c_mktsegment AS class_name,
                   substring('ABC', CAST(c_custkey % 3 + 1 AS INT), 1) AS section
            FROM customer""",
        "teacher": f"""
            SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS branch_id, CAST(NULL AS BIGINT) AS department_id,
                   s_name AS name, right(s_name, 9) AS employee_id,
                   CASE WHEN s_suppkey % 10 <> 0 THEN CAST(0.5 + (s_suppkey % 50) * 0.01 AS DOUBLE) END
                       AS reliability_score,
                   CAST(s_suppkey % 6 AS INT) AS workload_score,
                   {d.words.format(
                       "substring('ANR', CAST(s_suppkey % 3 + 1 AS INT), 1) || '-F-' || CAST(s_suppkey % 7 + 1 AS STRING)",
                       "substring('NRA', CAST(s_suppkey % 3 + 1 AS INT), 1) || '-O-' || CAST(s_suppkey % 5 + 1 AS STRING)")}
                       AS subjects
            FROM supplier""",
        "staff": f"""
            SELECT c_custkey AS id, CAST(n_regionkey AS BIGINT) AS organization_id, c_name AS name,
                   CASE WHEN c_custkey % 10 <> 0 THEN CAST(0.5 + (c_custkey % 50) * 0.01 AS DOUBLE) END AS reliability_score,
                   CAST(c_custkey % 6 AS INT) AS workload_score, {d.words.format(
                       "c_mktsegment", "substring('1-URGENT2-HIGH  3-MEDIUM4-NOT SP5-LOW   ', CAST(c_custkey % 5 * 8 + 1 AS INT), 8)")}
                       AS subjects
            FROM customer JOIN nation ON n_nationkey = c_nationkey""",
        "staff_booking": f"""
            SELECT o_orderkey AS id, o_custkey AS teacher_id, o_orderpriority AS subject,
                   {d.dayname.format("o_orderdate")} AS day_of_week, CAST(480 + (o_orderkey * 7) % 480 AS INT) AS start_min,
                   CAST(510 + (o_orderkey * 7) % 480 + o_orderkey % 31 AS INT) AS end_min
            FROM orders""",
        "school_class": """
            SELECT p_partkey AS id, p_partkey % 25 AS branch_id, p_brand AS class_name, p_type AS section
            FROM part""",
        "timetable": f"""
            SELECT (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS id,
                   l_suppkey % 25 AS branch_id, l_partkey AS school_class_id, l_suppkey AS teacher_id,
                   l_returnflag || '-' || l_linestatus || '-' || CAST(l_linenumber AS STRING) AS subject,
                   {d.dayname.format("l_shipdate")} AS day_of_week,
                   CAST(480 + (l_orderkey * 7 + l_linenumber * 13) % 480 AS INT) AS start_min,
                   CAST(510 + (l_orderkey * 7 + l_linenumber * 13) % 480 + (l_orderkey + l_linenumber) % 31 AS INT)
                       AS end_min
            FROM lineitem""",
        "attendance": """
            SELECT o_orderkey AS id, o_custkey AS student_id, CAST(NULL AS BIGINT) AS teacher_id,
                   o_custkey % 25 AS branch_id, CAST(o_orderdate AS DATE) AS date,
                   CAST(420 + o_orderkey % 600 AS INT) AS time_min,
                   CASE WHEN o_orderstatus = 'F' THEN 'Present' ELSE 'Absent' END AS status
            FROM orders""",
        "teacher_attendance": """
            SELECT l_orderkey AS id, l_suppkey AS teacher_id, CAST(l_shipdate AS DATE) AS date,
                   CASE WHEN l_linestatus = 'F' THEN 'Present' ELSE 'Absent' END AS status
            FROM lineitem""",
        "gallery": """
            SELECT 'S' || CAST(vec_id % 4 AS STRING) AS school_id, vec_id AS id, vec_id + 100000 AS person_id,
                   'Person ' || CAST(vec_id AS STRING) AS name, 'R' || CAST(vec_id AS STRING) AS roll_no,
                   CASE WHEN vec_id % 10 = 0 THEN 'teacher' ELSE 'student' END AS role,
                   CAST(0.5 + (label % 5) * 0.1 AS DOUBLE) AS reliability,
                   vec_id % 13 = 5 AS deleted, embedding
            FROM embeddings""",
        "probe": f"""
            SELECT vec_id AS query_id, 'S' || CAST(vec_id % 4 AS STRING) AS school_id,
                   CASE WHEN vec_id % 10 = 0 THEN 'Teacher' ELSE 'pupil' END AS role,
                   vec_id + 100000 + CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS person_id,
                   {d.nudged.format("0.3 * (1 + vec_id % 12)", "vec_id")} AS embedding
            FROM embeddings""",
        "camera": """
            SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey % 4 AS BIGINT) AS branch_id,
                   'Camera ' || n_name AS name, n_nationkey % 5 <> 3 AS active
            FROM nation""",
        "camera_match": f"""
            SELECT event_id, user_id % 4 AS branch_id, CAST(user_id AS STRING) AS person_id,
                   (user_id % 4) + 4 * (event_id % 6) AS camera_id, ts,
                   {d.us("ts")} AS us, least(value / 300, 1.0) AS similarity
            FROM events""",
        "attempt": f"""
            SELECT event_id, CAST(user_id AS STRING) AS key, user_id % 25 AS branch_id, ts, {d.us("ts")} AS us,
                   CAST(user_id % 25 * 3 - 36 AS DOUBLE) + (event_id % 10) * 0.0001 AS lat,
                   CAST(user_id % 25 * 7 - 80 AS DOUBLE) AS lon
            FROM events""",
        "scan": f"""
            SELECT event_id, CAST(user_id * 37 % 2503 AS STRING) AS code, right('00000000' || CAST(user_id AS STRING), 9)
                   AS person, ts, {d.us("ts")} AS us
            FROM events""",
        "qr_session": f"""
            SELECT CAST(p_partkey AS STRING) AS code, p_partkey % 25 AS branch_id, p_size % 4 + 1 AS grace_seconds, p_partkey % 17 = 0 AS used,
                   {d.us("TIMESTAMP '2024-01-01 00:00:00'")} + CAST(p_partkey * 997 % 40 - 4 AS BIGINT) * 86400000000
                   AS expires_us
            FROM part""",
        "sighting": f"""
            SELECT event_id, user_id, 'S' || CAST(user_id % 4 AS STRING) AS school_id,
                   CASE WHEN event_id % 5 = 0 THEN 'teacher' ELSE 'student' END AS role, event_id % 8 AS camera_id,
                   ts, {d.us("ts")} AS us, CAST(user_id % 100 AS INT) AS x, CAST(event_id % 90 AS INT) AS y,
                   CAST(50 + user_id % 30 AS INT) AS width, CAST(60 + user_id % 20 AS INT) AS height,
                   {d.nudged.format("0.05 * (event_id % 8)", "event_id")} AS embedding
            FROM events JOIN embeddings ON vec_id = user_id % {d.vectors}""",
        "track_update": f"""
            SELECT event_id, user_id AS track_id, 'S' || CAST(user_id % 4 AS STRING) AS school_id, 'student' AS role,
                   ts, {d.us("ts")} AS us,
                   CAST(CASE WHEN event_id % 11 = 0 THEN -1 ELSE user_id * 10 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END
                        END AS BIGINT) AS match_person,
                   CAST(0.7 + 0.3 * sin(event_id) AS DOUBLE) AS score
            FROM events""",
        "capture": """
            SELECT (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS capture_id,
                   l_extendedprice % 250 AS blur, l_quantity * 4 AS brightness,
                   CAST(10 + l_linenumber * 5 AS DOUBLE) AS contrast, l_discount * 2 + 0.02 AS face_area_ratio
            FROM lineitem""",
        "box": """
            SELECT l_orderkey AS frame, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS box_id,
                   CAST(l_partkey % 400 AS INT) AS x, CAST(l_suppkey * 7 % 300 AS INT) AS y,
                   CAST(40 + l_quantity * 6 AS INT) AS width, CAST(50 + (l_partkey * 3) % 200 AS INT) AS height
            FROM lineitem""",
    }


SQL_VIEWS = _views(DUCK)
_SPARK_VIEWS = _views(SPARK)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Views:
    """``Views(spark, sf_dir).student`` is the student view over that folder's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return table(self.spark, self.sf_dir, name)
        if name not in _SPARK_VIEWS:
            raise AttributeError(name)
        text = _SPARK_VIEWS[name]
        if "$vectors" in text:  # a number, since a subquery in a join key would not be planned as a key
            text = text.replace("$vectors", str(self.embeddings.count()))
        sources = {}
        for base in BASE_TABLES:
            text, found = re.subn(rf"(FROM|JOIN) {base}\b", rf"\1 {{{base}}}", text)
            if found:
                sources[base] = getattr(self, base)
        return self.spark.sql(text, **sources)


def with_views(names: str, body: str) -> str:
    """DuckDB text: the named views as WITH clauses, then ``body`` (which may itself start WITH)."""
    clauses = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names.split())
    body = body.strip()
    lowered = body.lower()
    if lowered.startswith("with recursive "):
        return f"WITH RECURSIVE {clauses},\n{body[len('with recursive '):]}"
    if lowered.startswith("with "):
        return f"WITH {clauses},\n{body[len('with '):]}"
    return f"WITH {clauses}\n{body}"
