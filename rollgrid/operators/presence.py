"""Event-time presence operators in batch form.

Events have ``event_id`` and ``us`` (time in microseconds), which order them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollgrid.operators import folds
from rollgrid.operators.folding import HOT_ROWS, ordered_fold
from rollgrid.operators.spatial import geofence

ORDER = ["us", "event_id"]
DAY_US = 86_400 * folds.SECOND
MARK_HITS, MARK_CONFIDENCE, MARK_FLOOR = 5, 0.75, 0.85
QUORUM_WINDOW_S, QUORUM_RATIO = 10, 0.8


def rate_limit(events: DataFrame, keys: list[str], limit: int, window_s: float, hot_rows=HOT_ROWS) -> DataFrame:
    """Adds ``nth`` (place in the open window) and ``allowed``."""
    return ordered_fold(events, keys, ORDER, folds.RateLimit(limit, window_s), hot_rows)


def lockout(events: DataFrame, keys: list[str], limit: int = folds.LOGIN_LIMIT[0],
            timeout_s: float = folds.LOGIN_LIMIT[1], hot_rows=HOT_ROWS) -> DataFrame:
    """Adds ``attempts`` and ``blocked``."""
    return ordered_fold(events, keys, ORDER, folds.Lockout(limit, timeout_s), hot_rows)


def dedup_ttl(events: DataFrame, keys: list[str], ttl_s: float = folds.MARK_TTL_S, hot_rows=HOT_ROWS) -> DataFrame:
    """Adds ``accepted``."""
    return ordered_fold(events, keys, ORDER, folds.TtlDedup(ttl_s), hot_rows)


def replay_guard(events: DataFrame, keys: list[str], threshold: float = folds.REPLAY_AT, hot_rows=HOT_ROWS) -> DataFrame:
    """Adds ``kept`` for events with an ``embedding``."""
    return ordered_fold(events, keys, ORDER, folds.ReplayGuard(threshold), hot_rows)


def lock_identity(updates: DataFrame, keys: list[str], hot_rows=HOT_ROWS) -> DataFrame:
    """Adds ``hits, person, confidence, locked`` to track updates with ``match_person`` and ``score``."""
    return ordered_fold(updates, keys, ORDER, folds.IdentityLock(), hot_rows)


def verify_attendance(
    requests: DataFrame, branches: DataFrame, keys: list[str], ttl_s: float = folds.MARK_TTL_S,
    limit: int = folds.ATTEMPT_LIMIT[0], window_s: float = folds.ATTEMPT_LIMIT[1], hot_rows=HOT_ROWS,
) -> DataFrame:
    """Adds ``status`` to requests with ``branch_id, lat, lon``."""
    placed = geofence(requests, branches).drop("distance_m")
    return ordered_fold(placed, keys, ORDER, folds.Verification(ttl_s, limit, window_s), hot_rows)


def day_of(us: str = "us") -> Column:
    """Calendar day (UTC) as days since the epoch."""
    return F.floor(F.col(us) / DAY_US).cast("int")


def once_per_day(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event per key and calendar day, by partial minima."""
    row = F.struct(*ORDER, *[c for c in events.columns if c not in ORDER])
    return events.groupBy(*keys, day_of().alias("day")).agg(F.min_by(row, F.struct(*ORDER)).alias("_r")).select(
        *[F.col(f"_r.{c}").alias(c) for c in events.columns], "day")


def mark_tracks(
    tracks: DataFrame, keys: list[str], min_hits: int = MARK_HITS, min_confidence: float = MARK_CONFIDENCE
) -> DataFrame:
    """Adds ``mark_now``: NULL where no mark is tried, true for the person's first of the day.

    Tried: locked, enough hits and confidence. It takes a confidence of at least 0.85 to succeed.
    """
    tried = F.col("locked") & (F.col("hits") >= min_hits) & (F.col("confidence") >= min_confidence)
    strong = tried & (F.col("confidence") >= MARK_FLOOR)
    dated = tracks.withColumn("_day", day_of())
    first = dated.filter(strong).groupBy(*keys, "_day").agg(F.min(F.struct(*ORDER)).alias("_first"))
    now = strong & (F.struct(*ORDER) == F.col("_first"))
    return dated.join(first, [*keys, "_day"], "left").select(
        *tracks.columns, F.when(tried, F.coalesce(now, F.lit(False))).alias("mark_now"))


def camera_quorum(
    matches: DataFrame, cameras: DataFrame, window_s: float = QUORUM_WINDOW_S, ratio: float = QUORUM_RATIO,
    bucket_s: float | None = None,
) -> DataFrame:
    """Adds ``n_cameras`` (distinct cameras that saw the person in the last ``window_s`` seconds),
    ``required`` and ``quorum`` to matches with ``branch_id, person_id, camera_id``.

    A camera covers the time from a match until its next match of the person, at most the window.
    Cameras at time t = coverages open at t, a running sum over their starts and ends. Time is cut
    into buckets no shorter than the window and a coverage is cut at bucket borders, so a person
    seen all day long is many independent groups and a camera is looked ahead for one bucket only.
    """
    window = int(window_s * folds.SECOND)
    bucket = max(window + 1, int((bucket_s or 60 * window_s) * folds.SECOND))
    who = ["branch_id", "person_id"]
    seen = matches.groupBy(*who, "camera_id", "us").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_b", F.floor(F.col("us") / bucket))
    by_camera = [*who, "camera_id", "_b"]
    following = seen.groupBy(*by_camera).agg(F.min("us").alias("_next_bucket")).withColumn("_b", F.col("_b") - 1)
    ahead = Window.partitionBy(*by_camera).orderBy("us")
    closed = seen.withColumn("_next", F.lead("us").over(ahead)).join(following, by_camera, "left").withColumn(
        "_end", F.least(F.col("us") + window + 1, F.coalesce("_next", "_next_bucket")))
    edges = closed.select(
        *who, F.explode(F.sequence(F.col("_b"), F.floor((F.col("_end") - 1) / bucket))).alias("_b"), "us", "_end"
    ).select(*who, "_b", F.explode(F.array(
        F.struct(F.greatest(F.col("us"), F.col("_b") * bucket).alias("at"), F.lit(1).alias("d")),
        F.struct(F.col("_end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    moves = edges.filter(F.floor(F.col("e.at") / bucket) == F.col("_b")).groupBy(
        *who, "_b", F.col("e.at").alias("us")).agg(F.sum("e.d").alias("_d"))
    along = Window.partitionBy(*who, "_b").orderBy("us")
    open_now = moves.select(*who, "us", F.sum("_d").over(along).alias("n_cameras"))
    return with_quorum(matches.join(open_now, [*who, "us"]).select(*matches.columns, "n_cameras"), cameras, ratio)


def with_quorum(counted: DataFrame, cameras: DataFrame, ratio: float = QUORUM_RATIO) -> DataFrame:
    """Adds ``required`` and ``quorum`` to matches with ``branch_id`` and ``n_cameras``."""
    active = cameras.filter("active").groupBy("branch_id").agg(F.count(F.lit(1)).alias("_active"))
    required = F.floor(ratio * F.col("_active") + 0.999).cast("bigint")
    return counted.join(active, "branch_id", "left").select(
        *counted.columns, F.coalesce(required, F.lit(0)).alias("required"),
        F.coalesce(F.col("n_cameras") >= required, F.lit(False)).alias("quorum"))


def validate_scans(scans: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds ``verdict`` to scans with ``code``: ``ok``, ``used``, ``expired`` or ``not_found``.

    Sessions have ``code, expires_us, grace_seconds, used``, and ``branch_id`` where people are to be checked in: it is
    added to the scans. The first scan in time of an unused session consumes it; it is found with partial minima per code.
    """
    place = [c for c in ("branch_id",) if c in sessions.columns and c not in scans.columns]
    known = sessions.select("code", "expires_us", "grace_seconds", *place, F.col("used").alias("_used"))
    joined = scans.join(known, "code", "left")
    in_time = ~F.col("_used") & (F.col("us") < F.col("expires_us") + F.col("grace_seconds") * folds.SECOND)
    first = joined.filter(in_time).groupBy("code").agg(F.min(F.struct(*ORDER)).alias("_first"))
    now = F.struct(*ORDER)
    verdict = (
        F.when(F.col("_used").isNull(), "not_found")
        .when(F.col("_used") | F.coalesce(now > F.col("_first"), F.lit(False)), "used")
        .when(in_time, "ok").otherwise("expired"))
    return joined.join(first, "code", "left").select(*scans.columns, *place, verdict.alias("verdict"))


def check_in(validated: DataFrame, students: DataFrame) -> DataFrame:
    """Attendance rows of ``ok`` scans whose person is a student of the session's branch (roll numbers repeat elsewhere)."""
    people = students.select(F.col("roll_no").alias("person"), F.col("id").alias("student_id"), "branch_id")
    return validated.filter("verdict = 'ok'").join(people, ["branch_id", "person"]).select(
        "event_id", "branch_id", "student_id", F.date_from_unix_date(day_of()).alias("date"), F.lit("Present").alias("status"))


def ticks_of(detections: DataFrame, keys: list[str], tick: Column) -> DataFrame:
    """One row per key and tick with all its detections; a detection without vector is an empty tick.

    A tick is one frame of one camera: its detections are what one picture shows, and the
    assignment needs them together.
    """
    fields = ("event_id", *folds.BOX, "match_person", "score", "embedding")
    found = F.collect_list(F.when(F.col("embedding").isNotNull(), F.struct(*fields)))
    return detections.withColumn("tick", tick).groupBy(*keys, "tick").agg(F.sort_array(found).alias("detections"))


def track(
    detections: DataFrame, keys: list[str], tick: Column, max_age: int = folds.MAX_AGE,
    min_sim: float = folds.MIN_TRACK_SIMILARITY, hot_rows=HOT_ROWS,
) -> DataFrame:
    """One row per live track and tick of each camera (``keys``); ``tick`` numbers the frames."""
    frames = ticks_of(detections, keys, tick)
    folded = ordered_fold(frames, keys, ["tick"], folds.TrackFold(max_age, min_sim), hot_rows)
    return folded.select(*keys, "tick", F.explode("tracks").alias("t")).select(*keys, "tick", "t.*")
