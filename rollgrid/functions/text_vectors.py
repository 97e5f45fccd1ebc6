"""Deterministic unit vectors from text, as plain Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollgrid.functions.vectors import l2_normalize

#: Characters of a gram.
GRAM = 3


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_vector(text: Column, dim: int) -> Column:
    """Unit vector of length ``dim``: equal text gives the equal vector, in every run and plan.

    Every gram of three characters of the lower-case text (with two spaces before and one behind) adds or takes one in
    a component that its hash chooses; the whole text adds a half, so no vector is zero. NULL counts as empty text.
    """
    padded = F.concat(F.lit("  "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - GRAM + 1), lambda i: _number(F.substring(padded, i, F.lit(GRAM))))
    whole = _number(padded)

    def parts(hashes: Column) -> Column:
        signed = lambda h: F.when(F.floor(h / dim) % 2 == 0, 1.0).otherwise(-1.0)
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.aggregate(
            F.filter(hashes, lambda h: h % dim == d), F.when(whole % dim == d, 0.5).otherwise(0.0), lambda s, h: s + signed(h)))

    # Inside transform the hashes are a bound variable: they are computed once for all components.
    return l2_normalize(F.transform(F.array(grams), parts)[0]).cast("array<float>")
