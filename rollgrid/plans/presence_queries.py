"""Ordered and event-time queries over the events table.

The checking SQL of an ordered operator is a recursive query that walks every key row by row.
Limits are widened to the spacing of the test events (about ten hours between events of a user).
"""

from pyspark.sql import functions as F

from rollgrid.operators import presence
from rollgrid.plans.registry import query

HOUR = 3600
WALK = """
    WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY us, event_id) AS rn FROM {view}),
    w AS (SELECT o.event_id, o.{key} AS k, o.rn, {first} FROM o WHERE rn = 1
          UNION ALL
          SELECT o.event_id, o.{key} AS k, o.rn, {then} FROM w JOIN o ON o.{key} = w.k AND o.rn = w.rn + 1)
    {select}"""

# -------------------------------------------------------------- S1-S3
RATE_SQL = WALK.format(
    key="key", view="attempt", first="o.us AS opened, CAST(1 AS BIGINT) AS nth",
    then="""CASE WHEN o.us >= w.opened + 64800000000 THEN o.us ELSE w.opened END,
            CASE WHEN o.us >= w.opened + 64800000000 THEN 1 ELSE w.nth + 1 END""",
    select="SELECT event_id, nth, nth <= 2 AS allowed FROM w")


@query("s1_rate_limit", "attempt", RATE_SQL)
def s1(v):
    events = v.attempt.select("event_id", "key", "us")
    return presence.rate_limit(events, ["key"], 2, 18 * HOUR).select("event_id", "nth", "allowed")


@query("s1_rate_limit_hot_keys", "attempt", RATE_SQL)
def s1_hot(v):
    """Same result with keys above 20 rows handled as hot keys."""
    events = v.attempt.select("event_id", "key", "us")
    return presence.rate_limit(events, ["key"], 2, 18 * HOUR, hot_rows=20).select("event_id", "nth", "allowed")


@query("s2_lockout", "attempt", WALK.format(
    key="key", view="attempt", first="CAST(1 AS INT) AS attempts, o.us AS last_us, false AS blocked",
    then="""CAST(CASE WHEN o.us - w.last_us >= 43200000000 THEN 1 WHEN w.attempts >= 3 THEN w.attempts
                 ELSE w.attempts + 1 END AS INT),
            CASE WHEN o.us - w.last_us < 43200000000 AND w.attempts >= 3 THEN w.last_us ELSE o.us END,
            o.us - w.last_us < 43200000000 AND w.attempts >= 3""",
    select="SELECT event_id, attempts, blocked FROM w"))
def s2(v):
    events = v.attempt.select("event_id", "key", "us")
    return presence.lockout(events, ["key"], 3, 12 * HOUR).select("event_id", "attempts", "blocked")


@query("s2_lockout_hot_keys", "attempt", WALK.format(
    key="key", view="attempt", first="CAST(1 AS INT) AS attempts, o.us AS last_us, false AS blocked",
    then="""CAST(CASE WHEN o.us - w.last_us >= 2592000000000 THEN 1 WHEN w.attempts >= 2 THEN w.attempts
                 ELSE w.attempts + 1 END AS INT),
            CASE WHEN o.us - w.last_us < 2592000000000 AND w.attempts >= 2 THEN w.last_us ELSE o.us END,
            o.us - w.last_us < 2592000000000 AND w.attempts >= 2""",
    select="SELECT event_id, attempts, blocked FROM w"))
def s2_hot(v):
    """Locks of 30 days: nearly every chunk is entered locked, and the past reaches over all of them."""
    events = v.attempt.select("event_id", "key", "us")
    return presence.lockout(events, ["key"], 2, 30 * 24 * HOUR, hot_rows=20).select("event_id", "attempts", "blocked")


TTL_SQL = WALK.format(
    key="key", view="attempt", first="o.us AS last_us, true AS accepted",
    then="CASE WHEN o.us - w.last_us >= 21600000000 THEN o.us ELSE w.last_us END, o.us - w.last_us >= 21600000000",
    select="SELECT event_id, accepted FROM w")


@query("s3_dedup_ttl", "attempt", TTL_SQL)
def s3(v):
    events = v.attempt.select("event_id", "key", "us")
    return presence.dedup_ttl(events, ["key"], 6 * HOUR).select("event_id", "accepted")


@query("s3_dedup_ttl_hot_keys", "attempt", TTL_SQL)
def s3_hot(v):
    events = v.attempt.select("event_id", "key", "us")
    return presence.dedup_ttl(events, ["key"], 6 * HOUR, hot_rows=20).select("event_id", "accepted")


@query("s4_once_per_day", "camera_match", """
    SELECT event_id, branch_id, person_id, CAST(floor(us / 86400000000.0) AS INT) AS day FROM (
        SELECT *, row_number() OVER (PARTITION BY branch_id, person_id, floor(us / 86400000000.0)
                                     ORDER BY us, event_id) AS n FROM camera_match) WHERE n = 1""")
def s4(v):
    events = v.camera_match.select("event_id", "branch_id", "person_id", "us")
    return presence.once_per_day(events, ["branch_id", "person_id"]).drop("us")


# -------------------------------------------------------------- S5, S7
GUARD_SQL = WALK.format(
    key="user_id", view="sighting", first="o.embedding AS kept_vec, true AS kept",
    then="""CASE WHEN list_cosine_similarity(o.embedding, w.kept_vec) < 0.995 THEN o.embedding ELSE w.kept_vec END,
            list_cosine_similarity(o.embedding, w.kept_vec) < 0.995""",
    select="SELECT event_id, kept FROM w")


@query("s5_replay_guard", "sighting", GUARD_SQL)
def s5(v):
    events = v.sighting.select("event_id", "user_id", "us", "embedding")
    return presence.replay_guard(events, ["user_id"]).select("event_id", "kept")


@query("s5_replay_guard_hot_keys", "sighting", GUARD_SQL)
def s5_hot(v):
    events = v.sighting.select("event_id", "user_id", "us", "embedding")
    return presence.replay_guard(events, ["user_id"], hot_rows=25).select("event_id", "kept")


# One row per update: hits and the unlock rule first, then the search result.
LOCK_SQL = """
    WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY us, event_id) AS rn FROM track_update),
    w AS (SELECT event_id, track_id AS k, rn, CAST(1 AS INT) AS hits, CAST(0 AS INT) AS updates,
                 CAST(-1 AS BIGINT) AS person, CAST(0.0 AS DOUBLE) AS confidence, false AS locked FROM o WHERE rn = 1
          UNION ALL
          SELECT event_id, k, rn, hits, updates,
                 CASE WHEN hits < 3 THEN p WHEN miss THEN CASE WHEN l THEN p ELSE -1 END WHEN same THEN p
                      WHEN NOT l OR score > c + 0.10 THEN match_person ELSE p END,
                 CASE WHEN hits < 3 THEN c WHEN miss THEN CASE WHEN l THEN c ELSE 0.0 END
                      WHEN same THEN CASE WHEN l THEN c * (1 - 0.3) + score * 0.3 ELSE c * (1 - 0.4) + score * 0.4 END
                      WHEN NOT l OR score > c + 0.10 THEN score ELSE c END,
                 CASE WHEN hits < 3 THEN l WHEN miss THEN l
                      WHEN same THEN l OR c * (1 - 0.4) + score * 0.4 >= 0.55
                      WHEN l AND score > c + 0.10 THEN false ELSE l END
          FROM (SELECT o.event_id, w.k, o.rn, w.hits + 1 AS hits, w.person AS p, w.confidence AS c, o.match_person, o.score,
                       w.locked AND w.updates + 1 < 30 AS l,
                       CASE WHEN w.locked AND w.updates + 1 >= 30 THEN 0 ELSE w.updates + 1 END AS updates,
                       o.match_person = -1 OR o.score < 0.55 AS miss, o.match_person = w.person AS same
                FROM w JOIN o ON o.track_id = w.k AND o.rn = w.rn + 1))
    SELECT {columns} FROM w {rest}"""


def locked_updates(v):
    updates = v.track_update.select("event_id", "track_id", "school_id", "role", "us", "match_person", "score")
    return presence.lock_identity(updates, ["track_id"])


@query("s7_lock_identity", "track_update", LOCK_SQL.format(
    columns="event_id, hits, person, round(confidence, 6) AS confidence, locked", rest=""))
def s7(v):
    return locked_updates(v).select("event_id", "hits", "person", F.round("confidence", 6).alias("confidence"), "locked")


@query("s9_mark_tracks", "track_update", LOCK_SQL.format(
    columns="""event_id, CASE WHEN tried THEN CASE WHEN strong AND row_number() OVER (
                   PARTITION BY school_id, role, person, floor(us / 86400000000.0), strong ORDER BY us, event_id) = 1
                   THEN 'yes' ELSE 'no' END END AS mark_now""",
    rest="""JOIN (SELECT event_id, school_id, role, us FROM track_update) USING (event_id),
            LATERAL (SELECT locked AND hits >= 5 AND confidence >= 0.75 AS tried),
            LATERAL (SELECT tried AND confidence >= 0.85 AS strong)"""))
def s9(v):
    marked = presence.mark_tracks(locked_updates(v), ["school_id", "role", "person"])
    flag = F.when(F.col("mark_now"), "yes").when(~F.col("mark_now"), "no")
    return marked.select("event_id", flag.alias("mark_now"))


# -------------------------------------------------------------- S6, S8, S10, J10
@query("s6_track")
def s6(v):
    seen = v.sighting.withColumns({"match_person": F.lit(-1).cast("bigint"), "score": F.lit(0.0)})
    return presence.track(seen, ["school_id", "role", "camera_id"], F.col("us"))  # a frame is what one camera sees at one time


@query("s8_camera_quorum", "camera_match camera", """
    WITH n AS (SELECT branch_id, count(*) FILTER (WHERE active) AS active FROM camera GROUP BY 1)
    SELECT m.event_id, CAST((SELECT count(DISTINCT p.camera_id) FROM camera_match p WHERE p.branch_id = m.branch_id
               AND p.person_id = m.person_id AND p.us <= m.us AND p.us >= m.us - 129600000000) AS BIGINT) AS n_cameras,
           CAST(floor(0.8 * n.active + 0.999) AS BIGINT) AS required,
           (SELECT count(DISTINCT p.camera_id) FROM camera_match p WHERE p.branch_id = m.branch_id
               AND p.person_id = m.person_id AND p.us <= m.us AND p.us >= m.us - 129600000000)
            >= floor(0.8 * n.active + 0.999) AS quorum
    FROM camera_match m LEFT JOIN n USING (branch_id)""")
def s8(v):
    matches = v.camera_match.select("event_id", "branch_id", "person_id", "camera_id", "us")
    return presence.camera_quorum(matches, v.camera, 36 * HOUR, bucket_s=40 * HOUR).select(
        "event_id", "n_cameras", "required", "quorum")


VERIFY_SQL = """
    WITH RECURSIVE g AS (SELECT event_id, key, us, pow(sin(radians(b.latitude - lat) / 2), 2) + cos(radians(lat))
               * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - lon) / 2), 2) AS h, b.attendance_radius AS r
           FROM attempt JOIN branch b ON b.id = branch_id),
    o AS (SELECT event_id, key, us, 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) <= r AS inside,
                 row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS rn FROM g),
    s AS (SELECT NULL::BIGINT AS event_id, k, CAST(0 AS BIGINT) AS rn, CAST(-1e15 AS BIGINT) AS marked,
                 CAST(-1e15 AS BIGINT) AS opened, CAST(0 AS BIGINT) AS tries, '' AS status
          FROM (SELECT DISTINCT key AS k FROM o)),
    w AS (SELECT * FROM s
          UNION ALL
          SELECT event_id, k, rn, CASE WHEN status = 'marked' THEN us ELSE marked END,
                 CASE WHEN recent OR NOT fresh THEN opened ELSE us END, CASE WHEN recent THEN tries ELSE n END, status
          FROM (SELECT *, CASE WHEN recent THEN 'already_marked' WHEN n > 2 THEN 'too_many_attempts'
                               WHEN NOT inside THEN 'wrong_location' ELSE 'marked' END AS status
                FROM (SELECT o.event_id, w.k, o.rn, o.us, o.inside, w.marked, w.opened, w.tries,
                             o.us - w.marked < {ttl} AS recent, o.us >= w.opened + {window} AS fresh,
                             CASE WHEN o.us >= w.opened + {window} THEN 1 ELSE w.tries + 1 END AS n
                      FROM w JOIN o ON o.key = w.k AND o.rn = w.rn + 1)))
    SELECT event_id, status FROM w WHERE rn > 0"""


@query("s10_verify_attendance", "attempt branch", VERIFY_SQL.format(ttl=54000000000, window=86400000000))
def s10(v):
    requests = v.attempt.select("event_id", "key", "branch_id", "us", "lat", "lon")
    return presence.verify_attendance(requests, v.branch, ["key"], 15 * HOUR, 2, 24 * HOUR).select("event_id", "status")


@query("s10_verify_attendance_hot_keys", "attempt branch", VERIFY_SQL.format(ttl=864000000000, window=172800000000))
def s10_hot(v):
    """Marks of ten days: a mark outlasts many chunks."""
    requests = v.attempt.select("event_id", "key", "branch_id", "us", "lat", "lon")
    return presence.verify_attendance(requests, v.branch, ["key"], 240 * HOUR, 2, 48 * HOUR, hot_rows=20).select("event_id", "status")


SCAN_SQL = """
    WITH joined AS (SELECT s.*, q.code IS NOT NULL AS found, q.used, q.branch_id, NOT q.used AND s.us < q.expires_us
                    + q.grace_seconds * 1000000 AS in_time FROM scan s LEFT JOIN qr_session q ON q.code = s.code),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY code, coalesce(in_time, false) ORDER BY us, event_id) AS n,
                      min(CASE WHEN in_time THEN us END) OVER (PARTITION BY code) AS first_us FROM joined),
    verdicts AS (SELECT event_id, code, person, us, branch_id, CASE WHEN NOT found THEN 'not_found' WHEN used THEN 'used'
                        WHEN in_time AND n = 1 THEN 'ok' WHEN in_time OR us > first_us THEN 'used' ELSE 'expired' END AS verdict
                 FROM ranked)"""


@query("j10_validate_scans", "scan qr_session", SCAN_SQL + " SELECT event_id, code, verdict FROM verdicts")
def j10(v):
    return presence.validate_scans(v.scan.drop("ts"), v.qr_session).select("event_id", "code", "verdict")


@query("j10_check_in", "scan qr_session student", SCAN_SQL + """
    SELECT v.event_id, s.branch_id, s.id AS student_id, strftime(make_timestamp(v.us), '%Y-%m-%d') AS date, 'Present' AS status
    FROM verdicts v JOIN student s ON s.roll_no = v.person AND s.branch_id = v.branch_id WHERE v.verdict = 'ok'""")
def j10_check_in(v):
    checked = presence.validate_scans(v.scan.drop("ts"), v.qr_session)
    return presence.check_in(checked, v.student).withColumn("date", F.col("date").cast("string"))
