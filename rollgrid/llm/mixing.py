"""Mixing sources to target weights by temperature.

The share of a source is its tokens over all tokens. Weights are shares to the power of an exponent between 0 (uniform)
and 1 (in proportion), normalised. A smaller exponent gives more entropy but repeats small sources more often; the
exponent is found by bisection for a target entropy, a repetition limit, or both (then the limit decides).

The weights are realised as budgeted block permutations. A source with quota q runs through its documents epoch by epoch;
in each epoch its blocks come in another hashed order; a document is drawn while the tokens before it are below q. The
position of a draw is the part of the quota before it, so that sorting by position interleaves the sources in the target
weights at every point.

Nothing is ever one source in one task: a source of n documents has about sqrt(n) blocks of sqrt(n) documents. Token sums
are pre-aggregated per block; only sources and blocks meet in windows. The bisection reads one row of power sums per
round, five halvings at a time, so any number of sources stays distributed.

Tokens of a document are its words and one separator, so an empty or null text counts 1. Null sources are one source;
repeated rows are drawn like other rows; an empty table gives no rows; result columns replace columns of the same name.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid.llm import rows
from rollgrid.llm.sharding import BITS, hashed

#: Halvings of a round and rounds; the exponent is then rounded to DIGITS.
HALVINGS, ROUNDS, DIGITS = 5, 6, 6
SEED = "mix"


class Target(NamedTuple):
    """``budget``: tokens to draw, as a multiple of the corpus, or None for the least that draws every document once.

    ``entropy``: share of the largest possible entropy. ``repetition``: how often a source is run through at most.
    """

    budget: float | None = 1.0
    entropy: float | None = None
    repetition: float | None = None


def tokens() -> Column:
    return (F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def shares(sized: DataFrame) -> DataFrame:
    """Documents, tokens and share of every source."""
    sums = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("source_tokens"))
    total = sized.agg(F.sum("tokens").alias("all_tokens"))
    return sums.join(F.broadcast(total)).withColumn("share", F.col("source_tokens") / F.col("all_tokens"))  # one row


def spread_at(shared: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: entropy of the weights, and the largest and smallest ratio of weight to share."""
    power = F.pow("share", "a")
    sums = shared.select("share", F.explode(F.lit(exponents)).alias("a")).groupBy("a").agg(
        F.sum(power).alias("z"), F.sum(power * F.ln("share")).alias("l"), F.max(power / F.col("share")).alias("r"),
        F.min(power / F.col("share")).alias("s"))
    at = {row["a"]: row for row in sums.collect()}  # one row per exponent
    return [(math.log(at[a]["z"]) - a * at[a]["l"] / at[a]["z"], at[a]["r"] / at[a]["z"], at[a]["s"] / at[a]["z"])
            for a in exponents]


def _bisect(shared: DataFrame, enough) -> float:
    """Where ``enough(entropy, most, least)``, false at small exponents and true at large ones, becomes true."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * k / (1 << HALVINGS) for k in range((1 << HALVINGS) + 1)]
        met = [enough(*at) for at in spread_at(shared, points)]
        first = met.index(True) if True in met else len(points) - 1
        if first == 0:
            return low
        low, high = points[first - 1], points[first]
    return high


def exponent(shared: DataFrame, target: Target) -> float:
    """Exponent in [0, 1]: the largest with the target entropy, and not below the least within the repetition limit."""
    sources = shared.count()
    if not sources or (target.entropy is None and target.repetition is None):
        return 1.0
    found = 0.0
    if target.entropy is not None:
        found = _bisect(shared, lambda entropy, most, least: entropy < target.entropy * math.log(sources))
    if target.repetition is not None:
        found = max(found, _bisect(shared, lambda entropy, most, least: most * (target.budget or 1 / least) <= target.repetition))
    return round(found, DIGITS)


def mix(docs: DataFrame, target: Target) -> DataFrame:
    """One row per draw: the columns of ``docs`` with ``tokens``, ``epoch`` (from 0) and ``position`` (0 to 1)."""
    docs = docs.drop("tokens", "epoch", "position", "block", "rank")
    sized = docs.withColumn("tokens", tokens())
    shared = rows.written(shares(sized), "mix-shares")
    a = exponent(shared, target)
    budget = target.budget or (1 / spread_at(shared, [a])[0][2] if not shared.isEmpty() else 1.0)
    power = F.pow(F.col("share"), F.lit(a))
    total = shared.agg(F.sum(power).alias("all_power"))
    quotas = rows.written(shared.join(F.broadcast(total)).select(  # one row
        F.col("source").alias("of_source"), "source_tokens",
        F.round(power / F.col("all_power") * F.col("all_tokens") * budget).cast("long").alias("quota"),
        F.greatest(F.floor(F.sqrt("documents")), F.lit(1)).cast("long").alias("blocks")), "mix-quotas")
    rank = hashed(SEED, rows.id_text(F.col("doc_id")), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("string"))
    ranked = sized.withColumn("rank", rank).join(quotas, F.col("source").eqNullSafe(F.col("of_source"))).withColumn(
        "block", rows.block_of(F.col("rank"), BITS, F.col("blocks")))
    epochs = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("quota") / F.col("source_tokens")).cast("int") - 1, F.lit(0))))
    blocks = ranked.groupBy("of_source", "block", "source_tokens", "quota").agg(F.sum("tokens").alias("block_tokens")).withColumn("epoch", epochs)
    blocks = blocks.withColumn("turn", hashed(SEED, F.col("epoch").cast("string"), F.col("block").cast("string")))
    blocks = blocks.withColumn("before", F.col("epoch") * F.col("source_tokens") + rows.running_before(
        ["of_source", "epoch"], ["turn", "block"], "block_tokens")).select(
        F.col("of_source").alias("b_source"), F.col("block").alias("b_block"), "epoch", "before")
    inside = ranked.withColumn("inside", rows.running_before(
        ["of_source", "block"], ["rank", F.col("doc_id").asc_nulls_first(), "tokens"], "tokens"))
    drawn = inside.join(blocks, F.col("of_source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    start = F.col("before") + F.col("inside")
    return drawn.where(start < F.col("quota")).select(
        *docs.columns, "tokens", "epoch", (start / F.col("quota")).alias("position"))


def in_order(drawn: DataFrame) -> DataFrame:
    """The draws with every part of them in rising position, so that what reads them in stored order meets the mix.

    A part holds whole hashed blocks of all sources, so its positions run from 0 to 1 like those of the whole; nothing moves.
    """
    return drawn.sortWithinPartitions("position", F.col("doc_id").asc_nulls_first(), "epoch")
