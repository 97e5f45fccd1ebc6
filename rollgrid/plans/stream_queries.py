"""Stream forms over the events table, run until everything there is processed.

A heartbeat event behind the last one moves the watermark past all events, so a result is whole.
"""

from pyspark.sql import functions as F

from rollgrid import session
from rollgrid.operators import presence
from rollgrid.operators.spatial import geofence
from rollgrid.plans.presence_queries import HOUR, RATE_SQL, SCAN_SQL, TTL_SQL, WALK
from rollgrid.plans.registry import ORACLES, query
from rollgrid.plans.views import SPARK
from rollgrid.sources import snapshots
from rollgrid.sources.events import HEARTBEAT, closing_heartbeat, read_events
from rollgrid.streaming import camera, checkin, late, runner, stateful

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def events(v):
    """The events and, in the same first micro-batch, the heartbeat."""
    return read_events(v.spark, v.sf_dir, EVENTS, pattern="events.parquet", closing=closing_heartbeat(v.spark, v.events))


def attempts(v):
    return events(v).select("event_id", F.col("user_id").cast("string").alias("key"), "ts", "us")


@query("io6_read_events", "attempt", "SELECT event_id, key, us FROM attempt")
def io6(v):
    return runner.run_and_read(attempts(v), "events").where(F.col("event_id") != HEARTBEAT).select("event_id", "key", "us")


@query("s1_rate_limit_stream", "attempt", RATE_SQL)
def s1_stream(v):
    stream = stateful.rate_limit_stream(attempts(v), ["key"], 2, 18 * HOUR, keep=["event_id"])
    return runner.run_and_read(stream, "rate").select("event_id", "nth", "allowed")


@query("s2_lockout_stream")
def s2_stream(v):
    stream = stateful.lockout_stream(attempts(v), ["key"], 3, 12 * HOUR, keep=["event_id"])
    return runner.run_and_read(stream, "lockout").select("event_id", "attempts", "blocked")


@query("s3_dedup_ttl_stream", "attempt", TTL_SQL)
def s3_stream(v):
    return runner.run_and_read(stateful.dedup_ttl_stream(attempts(v), ["key"], 6 * HOUR, keep=["event_id"]), "ttl").select(
        "event_id", "accepted")


@query("s4_once_per_day_stream")
def s4_stream(v):
    seen = events(v).selectExpr("event_id", "user_id % 4 AS branch_id", "CAST(user_id AS STRING) AS person_id", "ts", "us")
    result = runner.run_and_read(stateful.once_per_day_stream(seen, ["branch_id", "person_id"]), "day")
    return result.select("event_id", "branch_id", "person_id", "day")


@query("s7_lock_identity_stream")
def s7_stream(v):
    updates = events(v).selectExpr(
        "event_id", "user_id AS track_id", "ts", "us", """CAST(CASE WHEN event_id % 11 = 0 THEN -1 ELSE user_id * 10
            + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END END AS BIGINT) AS match_person""",
        "CAST(0.7 + 0.3 * sin(event_id) AS DOUBLE) AS score")
    found = runner.run_and_read(stateful.lock_identity_stream(updates, ["track_id"], keep=["event_id"]), "lock")
    return found.select("event_id", "hits", "person", F.round("confidence", 6).alias("confidence"), "locked")


@query("s10_verify_attendance_stream")
def s10_stream(v):
    requests = events(v).selectExpr(
        "event_id", "CAST(user_id AS STRING) AS key", "user_id % 25 AS branch_id", "ts", "us",
        "CAST(user_id % 25 * 3 - 36 AS DOUBLE) + (event_id % 10) * 0.0001 AS lat", "CAST(user_id % 25 * 7 - 80 AS DOUBLE) AS lon")
    stream = stateful.verify_attendance_stream(geofence(requests, v.branch), ["key"], 15 * HOUR, 2, 24 * HOUR, keep=["event_id"])
    return runner.run_and_read(stream, "verify").select("event_id", "status")


# -------------------------------------------------------------- arrival in slices, late rows
#: A slice is what eight days bring. Every tenth event comes three days after its time.
DELAYED = "us + CASE WHEN event_id % 10 = 3 THEN 259200000000 ELSE 0 END"
SLICE = f"CAST(floor(({DELAYED}) / 691200000000.0) AS BIGINT)"
#: Rows of ``attempt`` as a stream with a delay of ten minutes meets them, slice after slice.
ARRIVED = f"""
    arrived AS (SELECT event_id, key, us, {SLICE} AS slice FROM attempt),
    tops AS (SELECT slice, max(us) AS top FROM arrived GROUP BY slice),
    passed AS (SELECT slice, max(top) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM tops),
    told AS (SELECT event_id, key, us, slice, coalesce(us <= (floor(seen / 1000) - 600000) * 1000, false) AS late
             FROM arrived JOIN passed USING (slice))"""


def arrivals(v, columns, each):
    """Brings the events slice by slice, a micro-batch each, and calls ``each(stream)`` after every one; a run per slice, so
    every slice but the first starts from the checkpoint. Gives the folder of the split and the stream's schema."""
    base = session.fresh_path(v.spark, "arrivals")
    rows = v.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("slice", F.expr(SLICE)).drop("us")
    slices = [r["slice"] for r in rows.select("slice").distinct().orderBy("slice").collect()]  # one per eight days
    for at in slices:
        rows.where(F.col("slice") == at).drop("slice").write.mode("append").parquet(f"{base}/in")
        stream = read_events(v.spark, f"{base}/in", EVENTS).selectExpr(*columns)
        late.split_late(stream, base)
        each(late.on_time(v.spark, base, stream.schema), base)
    return base, stream.schema


@query("io6_late_events", "attempt", WALK.format(
    key="key", view="punctual", first="o.us AS opened, CAST(1 AS BIGINT) AS nth",
    then="""CASE WHEN o.us >= w.opened + 64800000000 THEN o.us ELSE w.opened END,
            CASE WHEN o.us >= w.opened + 64800000000 THEN 1 ELSE w.nth + 1 END""",
    select="SELECT event_id, nth, 'no' AS late FROM w UNION ALL SELECT event_id, NULL, 'yes' FROM told WHERE late").replace(
    "WITH RECURSIVE", f"WITH RECURSIVE {ARRIVED}, punctual AS (SELECT * FROM told WHERE NOT late),"))
def io6_late(v):
    """On-time rows folded (S1), late ones beside them."""
    base, schema = arrivals(v, ["event_id", "CAST(user_id AS STRING) AS key", "ts", "us"], lambda stream, base: None)
    whole = v.spark.readStream.schema(schema).parquet(f"{base}/on_time").select(schema.fieldNames()).unionByName(
        v.spark.readStream.schema(EVENTS).parquet(closing_heartbeat(v.spark, v.events)).selectExpr(
            "event_id", "CAST(user_id AS STRING) AS key", "CAST(ts AS TIMESTAMP) AS ts", "unix_micros(CAST(ts AS TIMESTAMP)) AS us"))
    folded = runner.run_and_read(stateful.rate_limit_stream(whole.withWatermark("ts", "10 minutes"), ["key"], 2, 18 * HOUR, keep=["event_id"]), "late-rate")
    behind = late.late_rows(v.spark, base, schema)
    return folded.select("event_id", "nth", F.lit("no").alias("late")).unionByName(
        behind.select("event_id", F.lit(None).cast("bigint").alias("nth"), F.lit("yes").alias("late")))


@query("s4_once_now_stream", "attempt", f"""
    WITH {ARRIVED}
    SELECT event_id, key, day FROM (SELECT *, row_number() OVER (PARTITION BY key, day ORDER BY slice, us, event_id) AS n FROM (
        SELECT *, CAST(floor(us / 86400000000.0) AS INT) AS day FROM told WHERE NOT late)) WHERE n = 1""")
def s4_now(v):
    """Marks as they are given, with no event behind them to move the watermark."""
    def mark(stream, base):
        runner.run_to_table(stateful.once_now_stream(stream, ["key"]), f"{base}/marks", f"{base}/checkpoint-marks")

    base, _ = arrivals(v, ["event_id", "CAST(user_id AS STRING) AS key", "ts", "us"], mark)
    return v.spark.read.parquet(f"{base}/marks").select("event_id", "key", "day")


@query("j10_validate_scans_stream", "scan qr_session", SCAN_SQL + " SELECT event_id, code, verdict FROM verdicts")
def j10_stream(v):
    """Sessions are made known up to 60 days before they expire, at the latest on the first day of events."""
    sessions = v.qr_session.selectExpr(
        "code", "CAST(timestamp_micros(least(expires_us, unix_micros(TIMESTAMP '2024-01-01')) - (expires_us % 7 + 1) * 86400000000) AS TIMESTAMP_NTZ) AS created_at",
        "CAST(timestamp_micros(expires_us) AS TIMESTAMP_NTZ) AS expires_at", "grace_seconds", "used")
    folder = session.fresh_path(v.spark, "sessions")
    sessions.write.parquet(folder)
    last = v.events.agg(F.max("ts").alias("ts")).selectExpr(
        "'heartbeat' AS code", "ts + INTERVAL 200 DAYS AS created_at", "ts AS expires_at", "CAST(0 AS INT) AS grace_seconds", "true AS used")
    last.coalesce(1).write.mode("append").parquet(folder)  # the sessions' own heartbeat; a null code would be filtered out ahead of the watermark
    known = read_events(v.spark, folder, "code STRING, created_at TIMESTAMP_NTZ, expires_at TIMESTAMP_NTZ, grace_seconds INT, used BOOLEAN",
                        time_col="created_at").drop("us").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    far = closing_heartbeat(v.spark, v.events, ahead="200 days")
    scans = read_events(v.spark, v.sf_dir, EVENTS, pattern="events.parquet", closing=far).selectExpr(
        "event_id", "CAST(user_id * 37 % 2503 AS STRING) AS code", "ts", "us")
    judged = runner.run_and_read(checkin.validate_scans_stream(scans, known, "90 days"), "scan-verdicts")
    return judged.where(F.col("event_id") != HEARTBEAT).select("event_id", "code", "verdict")


@query("s5_replay_guard_stream")
def s5_stream(v):
    vector = SPARK.nudged.format("0.05 * (event_id % 8)", "event_id")
    near = events(v).join(v.embeddings, F.expr(f"vec_id = user_id % {v.embeddings.count()}"))
    seen = near.selectExpr("event_id", "user_id", "ts", "us", f"{vector} AS embedding")
    return runner.run_and_read(stateful.replay_guard_stream(seen, ["user_id"], keep=["event_id"]), "replay").select("event_id", "kept")


@query("s8_camera_quorum_stream")
def s8_stream(v):
    matches = events(v).selectExpr("event_id", "user_id % 4 AS branch_id", "CAST(user_id AS STRING) AS person_id",
                                   "user_id % 4 + 4 * (event_id % 6) AS camera_id", "ts", "us")
    counted = runner.run_and_read(stateful.camera_count_stream(matches, ["branch_id", "person_id"], 36 * HOUR, keep=["event_id", "branch_id"]), "quorum")
    return presence.with_quorum(counted, v.camera).where(F.col("event_id") != HEARTBEAT).select("event_id", "n_cameras", "required", "quorum")


# A stream over all events equals its batch form, so the same SQL checks both.
for _name in ("s2_lockout", "s4_once_per_day", "s5_replay_guard", "s7_lock_identity", "s8_camera_quorum", "s10_verify_attendance"):
    ORACLES[f"{_name}_stream"] = ORACLES[_name]


METRICS = ("80 + event_id % 150 AS blur", "60 + value % 100 AS brightness", "30.0D AS contrast", "0.06 + (event_id % 20) * 0.01D AS face_area_ratio")


#: A detection made of an event, with the quality metrics of an event's number and ``value``.
DETECTION = (
    "event_id", "user_id", "ts", "us", "value", SPARK.nudged.format("0.05 * (event_id % 8)", "event_id") + " AS embedding", "concat('S', user_id % 4) AS school_id",
    "CASE WHEN event_id % 5 = 0 THEN 'teacher' ELSE 'student' END AS role", "CAST(user_id % 100 AS INT) AS x", "CAST(event_id % 90 AS INT) AS y",
    "CAST(50 + user_id % 30 AS INT) AS width", "CAST(60 + user_id % 20 AS INT) AS height", *METRICS)


def detected(near):
    return near.selectExpr(*DETECTION).withColumns({"camera_id": F.col("user_id") % 40, "embedding": F.col("embedding").cast("array<float>")})


@query("s11_camera_flow")
def s11(v):
    return camera.camera_flow(detections(v), v.gallery, max_age=12)


def detections(v):
    """Sightings with quality metrics made of the event's number and value; both are joined before there are vectors to move."""
    timed = v.events.select("event_id", "user_id", "ts").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    measured = timed.join(v.events.select("event_id", "value"), "event_id")
    return detected(measured.join(v.embeddings, F.expr(f"vec_id = user_id % {v.embeddings.count()}")))


@query("s11_camera_stream")
def s11_stream(v):
    """The track table of the live path, its gallery read from the newest snapshot of every micro-batch."""
    base = session.fresh_path(v.spark, "live")
    snapshots.write_snapshot(v.gallery.withColumn("reliability", F.col("reliability").cast("float")), f"{base}/gallery", "1")
    near = events(v).join(v.embeddings, F.expr(f"vec_id = pmod(user_id, {v.embeddings.count()})"))  # the heartbeat comes along
    seen = detected(near)
    camera.run_camera_stream(v.spark, seen, f"{base}/gallery", base, F.expr("CAST(substring(school_id, 2) AS BIGINT)"), max_age=12)
    return v.spark.read.parquet(f"{base}/tracks").drop("batch")
