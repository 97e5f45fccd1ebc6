"""Capture-quality score, verdict and tier as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the quality rules: (metric, lower limit, reason), in the order they are checked.
BARRIERS = (
    ("blur", 10.0, "extreme_blur"),
    ("contrast", 10.0, "low_contrast"),
    ("face_area_ratio", 0.02, "face_too_small_extreme"),
    ("blur", 40.0, "too_blurry_hard"),
    ("brightness", 25.0, "extreme_low_light"),
    ("face_area_ratio", 0.05, "face_too_small_hard"),
)
ENROL_BARRIERS = (
    ("blur", 60.0, "blur_not_allowed_enrollment"),
    ("face_area_ratio", 0.08, "face_too_small_enrollment"),
)
WEAK_REASONS = (
    ("blur", 70.0, "too_blurry"),
    ("brightness", 50.0, "low_light"),
    ("face_area_ratio", 0.1, "face_too_small"),
)
WEAK_OTHERWISE = "low_quality"
ACCEPT_ENROL, ACCEPT_ATTEND = 0.70, 0.52
TIERS = {"High": 0.80, "Medium": 0.65, "Low": 0.50}


def _unit(value: Column, low: float, span: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value.cast("double") - low) / span))


def _first(pairs: list[tuple[Column, str]], otherwise: Column) -> Column:
    result = otherwise
    for test, value in reversed(pairs):
        result = F.when(test, F.lit(value)).otherwise(result)
    return result


def _below(rules: tuple) -> list[tuple[Column, str]]:
    return [(F.col(metric) < limit, reason) for metric, limit, reason in rules]


def barrier_reason(enrolment: bool) -> Column:
    """Reason that stops a capture before it is scored; NULL when nothing does."""
    return _first(_below(BARRIERS + (ENROL_BARRIERS if enrolment else ())), F.lit(None).cast("string"))


def quality_score() -> Column:
    """Weighted score of a capture that met no barrier."""
    # Weights, ranges and powers of the three terms, and the two penalties.
    terms = (
        0.45 * F.pow(_unit(F.col("blur"), 50.0, 150.0), F.lit(1.2))
        + 0.30 * F.pow(_unit(F.col("brightness"), 50.0, 100.0), F.lit(1.1))
        + 0.25 * _unit(F.col("face_area_ratio"), 0.05, 0.15)
    )
    blurred = F.when(F.col("blur") < 70.0, 0.75).otherwise(1.0)
    dark = F.when(F.col("brightness") < 45.0, 0.8).otherwise(1.0)
    return terms * blurred * dark


def weak_reason() -> Column:
    return _first(_below(WEAK_REASONS), F.lit(WEAK_OTHERWISE))


def tier(score: Column) -> Column:
    return _first([(score >= low, name) for name, low in TIERS.items()], F.lit("Reject"))


def argmax_class(scores: Column) -> Column:
    """Index of the largest entry, the last one on ties; NULL for an empty array."""
    last = F.size(scores) - F.array_position(F.reverse(scores), F.array_max(scores))
    return F.when(F.size(scores) > 0, last.cast("int"))
