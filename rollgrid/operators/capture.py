"""Capture-quality operators (Q1-Q5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollgrid.functions import quality

# Fixed values of the candidate and admission rules.
MIN_CONFIDENCE, MIN_SIDE, MIN_ASPECT, MAX_ASPECT, HARD_MIN_SIDE = 0.7, 40, 0.5, 1.8, 80
IMAGE_MIN_SIDE, IMAGE_MIN_ASPECT, IMAGE_MAX_ASPECT, IMAGE_LONG_SIDE = 100, 0.3, 3.0, 1280
PROFILE_MAX_BYTES = 2 * 1024 * 1024


def quality_gate(metrics: DataFrame, enrolment: bool) -> DataFrame:
    """Adds ``score``, ``accept`` and ``reason`` (NULL when accepted)."""
    threshold = quality.ACCEPT_ENROL if enrolment else quality.ACCEPT_ATTEND
    stopped = metrics.withColumn("_stop", quality.barrier_reason(enrolment))
    scored = stopped.withColumn("score", F.when(F.col("_stop").isNull(), quality.quality_score()).otherwise(0.0))
    accept = F.col("_stop").isNull() & (F.col("score") >= threshold)
    reason = F.when(F.col("_stop").isNotNull(), F.col("_stop")).when(~accept, quality.weak_reason())
    return scored.select(*metrics.columns, "score", accept.alias("accept"), reason.alias("reason"))


def quality_tier(scored: DataFrame, enrolment: bool) -> DataFrame:
    """Adds ``tier``, ``proceed`` and ``warning``; they look at the score, not at ``accept``."""
    graded = scored.withColumn("tier", quality.tier(F.col("score")))
    low, reject = F.col("tier") == "Low", F.col("tier") == "Reject"
    lead = F.when(low, "enrolment rejected: " if enrolment else "low quality: ").when(reject, "image rejected: ")
    unknown = F.when(low & F.lit(enrolment), "low_quality").otherwise("unknown")
    return graded.withColumns({
        "proceed": F.col("tier").isin("High", "Medium") | (low & F.lit(not enrolment)),
        "warning": F.concat(lead, F.coalesce(F.col("reason"), unknown)),
    })


def best_candidate(detections: DataFrame) -> DataFrame:
    """Per image the detection with the largest score·√(w·h), if it passes the size rules.

    One partial maximum per image and task; ties go to the earlier box (left, then top).
    """
    weight = F.col("score") * F.sqrt(F.col("w") * F.col("h"))
    row = F.struct(*[c for c in detections.columns if c != "image_id"], weight.alias("weight"))
    best = detections.groupBy("image_id").agg(
        F.max_by(row, F.struct(weight, -F.col("x"), -F.col("y"))).alias("best")).select("image_id", "best.*")
    aspect = F.col("w") / F.col("h")
    return best.filter(
        (F.col("weight") >= MIN_CONFIDENCE) & (F.col("w") >= MIN_SIDE) & (F.col("h") >= MIN_SIDE)
        & aspect.between(MIN_ASPECT, MAX_ASPECT) & (F.col("w") >= HARD_MIN_SIDE) & (F.col("h") >= HARD_MIN_SIDE)
    )


def admit_images(meta: DataFrame) -> DataFrame:
    """Adds ``admitted``, ``target_width`` and ``target_height`` to width, height (pixels)."""
    width, height = F.col("width"), F.col("height")
    aspect = width.cast("double") / height
    long_side = F.greatest(width, height)
    scale = F.when(long_side > IMAGE_LONG_SIDE, F.lit(float(IMAGE_LONG_SIDE)) / long_side).otherwise(1.0)
    return meta.withColumns({
        "admitted": (width >= IMAGE_MIN_SIDE) & (height >= IMAGE_MIN_SIDE)
        & aspect.between(IMAGE_MIN_ASPECT, IMAGE_MAX_ASPECT),
        "target_width": (width * scale).cast("int"),
        "target_height": (height * scale).cast("int"),
    })


def admit_profile_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("size_bytes") <= PROFILE_MAX_BYTES)


def class_of(scores: DataFrame, scores_col: str = "scores") -> DataFrame:
    return scores.withColumn("class_index", quality.argmax_class(F.col(scores_col)))
