"""QR check-in as a stream (J10): interval join of scans and sessions, then the uses of each code in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollgrid.operators import folds
from rollgrid.streaming.stateful import fold_stream


def accept_scans_stream(scans: DataFrame, sessions: DataFrame, longest_life: str = "1 minute") -> DataFrame:
    """Scans inside their session's life with ``verdict`` ``ok`` (first) or ``used`` (later).

    Scans: ``event_id, code, person, ts, us``; sessions: ``code, created_at, expires_at,
    grace_seconds, used``; both watermarked, on ``ts`` and ``created_at``. ``longest_life`` bounds
    how long a session is kept for the join. Scans of unknown or expired codes find no partner.
    """
    known = sessions.filter("NOT used").select(F.col("code").alias("_code"), "created_at", "expires_at", "grace_seconds")
    inside = F.expr(
        f"code = _code AND ts >= created_at AND ts <= created_at + INTERVAL {longest_life} "
        "AND ts < expires_at + make_dt_interval(0, 0, 0, grace_seconds)")
    valid = scans.join(known, inside).select("event_id", "code", "person", "ts", "us")
    first = fold_stream(valid, ["code"], folds.FirstOnly())
    return first.withColumn("verdict", F.when(F.col("is_first"), "ok").otherwise("used")).drop("is_first")


def validate_scans_stream(scans: DataFrame, sessions: DataFrame, longest_life: str) -> DataFrame:
    """Every scan with ``verdict``: ``ok``, ``used``, ``expired`` or ``not_found``, as ``presence.validate_scans`` has it.

    A left outer interval join: a scan without a session waits until the watermarks rule out that one still comes, and is
    then ``not_found``. A session is known for ``longest_life`` after ``created_at``, expired or not; a scan after that, or
    before the session, finds none. Matched scans of a code are judged in time order, so files may come shuffled.
    """
    known = sessions.select(F.col("code").alias("_code"), "created_at", "expires_at", "grace_seconds", F.col("used").alias("_used"))
    life = F.expr(f"INTERVAL {longest_life}")
    inside = (F.col("code") == F.col("_code")) & (F.col("ts") >= F.col("created_at")) & (F.col("ts") <= F.col("created_at") + life)
    in_time = ~F.col("_used") & (F.col("ts") < F.col("expires_at") + F.expr("make_dt_interval(0, 0, 0, grace_seconds)"))
    judged = scans.join(known, inside, "leftOuter").select(
        *scans.columns, F.coalesce("code", F.lit("")).alias("fold_key"), F.col("_code").isNotNull().alias("found"),
        F.coalesce("_used", F.lit(False)).alias("used"), F.coalesce(in_time, F.lit(False)).alias("in_time"),
        F.coalesce(F.unix_micros(F.col("created_at") + life), F.lit(0)).alias("until"))
    return fold_stream(judged, ["fold_key"], folds.CodeUse()).select(*scans.columns, "verdict")
