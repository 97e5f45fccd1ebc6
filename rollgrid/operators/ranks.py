"""Rows by their place in a total order, without sorting or writing the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that a range is cut into, and sampled keys per cut.
CUTS, PER_CUT = 32, 40


class OrderIndex:
    """Boundaries of key ranges with their row counts; pages read and sort only the ranges they overlap.

    A range that is too long is sampled, cut at quantiles of the sample and counted in one scan of the order columns, with
    partial counts per range; a page of n rows needs about log(n / ``small``) / log(``CUTS``) such scans, and the pages after
    it none, since the index keeps its boundaries. Counts are exact, the sample only says where to cut. The driver holds
    ``CUTS`` boundaries per cut range. ``order_by`` names columns in rising order, which must be a total order for pages to
    be the same every time.
    """

    def __init__(self, df: DataFrame, order_by: list[str], total: int, small: int):
        self.df, self.order_by, self.small = df, order_by, small
        self.kinds = [df.schema[c].dataType for c in order_by]
        self.cuts: list[tuple] = []  # range i is (cuts[i - 1], cuts[i]]
        self.counts = [total]
        self.scans = 0

    def _literal(self, cut: tuple) -> Column:
        return F.struct(*[F.lit(value).cast(kind).alias(name) for value, kind, name in zip(cut, self.kinds, self.order_by)])

    def _between(self, first: int, last: int) -> DataFrame:
        """Rows of the ranges from ``first`` to ``last``."""
        rows, key = self.df, F.struct(*self.order_by)
        if first > 0:
            rows = rows.filter(key > self._literal(self.cuts[first - 1]))
        if last < len(self.cuts):
            rows = rows.filter(key <= self._literal(self.cuts[last]))
        return rows

    def _overlap(self, start: int, count: int) -> tuple[int, int, int]:
        """First and last range that hold places from ``start`` on, and the rows before them."""
        before, first = 0, 0
        while first < len(self.counts) - 1 and before + self.counts[first] <= start:
            before, first = before + self.counts[first], first + 1
        last, seen = first, before + self.counts[first]
        while last < len(self.counts) - 1 and seen < start + count:
            last, seen = last + 1, seen + self.counts[last + 1]
        return first, last, before

    def _cut(self, first: int, last: int) -> bool:
        """Cut the ranges anew as one; false where all sampled keys are one."""
        rows, size = self._between(first, last).select(*self.order_by), sum(self.counts[first : last + 1])
        share = min(1.0, CUTS * PER_CUT / size)
        sample = [tuple(r) for r in rows.sample(share, seed=7).orderBy(*self.order_by).collect()]  # about CUTS * PER_CUT rows
        chosen = list(dict.fromkeys(sample[len(sample) * k // CUTS] for k in range(1, CUTS))) if sample else []
        if last < len(self.cuts):
            chosen = [c for c in chosen if c != self.cuts[last]]
        if not chosen:
            return False
        key, place = F.struct(*self.order_by), F.lit(0)
        for cut in chosen:
            place = place + (key > self._literal(cut)).cast("int")
        found = dict(rows.select(place.alias("place")).groupBy("place").count().collect())
        self.cuts[first:last] = chosen
        self.counts[first : last + 1] = [found.get(k, 0) for k in range(len(chosen) + 1)]
        self.scans += 1
        return True

    def rows(self, start: int, count: int) -> DataFrame:
        """``count`` rows from place ``start`` on, in order."""
        while True:
            first, last, before = self._overlap(start, count)
            size = sum(self.counts[first : last + 1])
            if size <= max(self.small, 2 * count) or not self._cut(first, last):
                return self._between(first, last).orderBy(*self.order_by).offset(start - before).limit(count)
            again = self._overlap(start, count)
            if sum(self.counts[again[0] : again[1] + 1]) >= size:  # very many rows with one key
                return self._between(*again[:2]).orderBy(*self.order_by).offset(start - again[2]).limit(count)
