"""Quality rules whose cutoffs follow the corpus: quantile sketches per language and source, then a joined filter.

Each document gets four whole-number measures per thousand words. A sketch counts measures in cells of a few per cent
width (the five leading binary digits of the value), so sketches of parts merge by adding counts. The median and the
quantiles at a tenth and nine tenths of the document's own (language, source) sketch are drawn towards what is usual in its
language, and that towards what is usual in the corpus, the more so the fewer documents there are. Usual is the median over
groups, merged by a sketch of their quantiles in which no group counts for more than ``HALF_WAY`` documents, so one bad
source, however large, does not decide it. A cutoff lies a multiple of the distance between median and quantile from the
median. A group with an extreme spread, as a source of which a quarter is junk has, may not go further from its median than
the usual distance and a quarter of the least one. Every measure has an upper cutoff, the length of words a lower one too.

Defined cases: a null text has no words and fails; null language or source are groups of their own; repeated rows count
as often as they occur; an empty table gives no rows; other columns of the table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollgrid.llm import rows

WINDOW = 5
LEAST_WORDS, REPEAT_PERCENT = 10, 20
#: Measures per thousand words or lines, and how far from the median a cutoff lies at least.
MEASURES = {"symbols": 50, "dup_lines": 250, "repeats": 100, "long_words": 500}
#: Measures with a cutoff below as well.
LOWER = ("long_words",)
#: A cutoff's distance from the median is SPREAD times the quantile's, and the least distance more.
SPREAD = 4
#: A group of so many documents is drawn half-way to the next wider sketch.
HALF_WAY = 100
#: Leading binary digits that a cell of the sketch keeps.
DIGITS = 5

SYMBOLS = r"[#*$%&|<>]"


def repeated_words(hashes: Column) -> Column:
    """Words inside windows of five that occur twice or more; ``hashes`` are those of the words."""
    none = F.lit(0).cast("long")
    windows = F.transform(
        F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1),
        lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(WINDOW)]))

    def named(value: Column, use) -> Column:
        """``use(value)`` with the value computed once: a lambda over one element gives it a name."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def covered(placed: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(placed, k)["w"] == p["w"], F.lit(False))
        twice = F.array_sort(F.transform(F.filter(placed, lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"]))
        return F.aggregate(
            twice, F.struct(F.lit(-WINDOW).alias("at"), none.alias("n")),
            lambda s, i: F.struct(i.alias("at"), (s["n"] + F.least(F.lit(WINDOW), i - s["at"])).alias("n")), lambda s: s["n"])

    def pick(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), none).otherwise(named(placed, covered))

    return F.when(F.size(hashes) < WINDOW + 1, none).otherwise(named(windows, pick))


def features(docs: DataFrame) -> DataFrame:
    """The counts of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashes = F.transform(rows.words(F.col("text")), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select("doc_id", "lang", "source", text.alias("text"), hashes.alias("hashes"), lines.alias("lines")).select(
        "doc_id", "lang", "source", F.size("hashes").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", rows.SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("hashes")).alias("n_repeat_words"))


def measures() -> dict[str, Column]:
    per_word = lambda c: F.floor(1000 * F.col(c) / F.greatest("n_words", F.lit(1))).cast("long")
    return {"symbols": per_word("n_symbols"), "repeats": per_word("n_repeat_words"), "long_words": per_word("word_chars"),
            "dup_lines": F.floor(1000 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).cast("long")}


def cell(value: Column) -> Column:
    """Lower end of the sketch cell that holds a value."""
    drop = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(measured: DataFrame) -> DataFrame:
    """Counts per (language, source, measure, cell)."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), cell(F.col(m)).alias("cell")) for m in MEASURES]))
    return (measured.select("lang", "source", each.alias("e")).select("lang", "source", "e.*")
            .groupBy("lang", "source", "measure", "cell").agg(F.count("*").alias("n")))


QUANTILES = {"q10": 1, "q50": 5, "q90": 9}


def _quantiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """Per group the cells at the tenths ``QUANTILES`` of a sketch (cell, n), and how much it counts."""
    merged = sketch.groupBy(*group, "cell").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*group)
    ranked = merged.withColumn("upto", F.sum("n").over(by.orderBy("cell"))).withColumn("all", F.sum("n").over(by))
    at = lambda tenths: F.min(F.when(F.col("upto") * 10 >= F.col("all") * tenths, F.col("cell")))
    return ranked.groupBy(*group).agg(F.max("all").alias("documents"), *[at(t).alias(q) for q, t in QUANTILES.items()])


def _usual(groups: DataFrame, by: list[str], values: tuple[str, ...]) -> DataFrame:
    """The median over groups of each of the values, a group counting for ``HALF_WAY`` documents at most."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("value"), cell(F.col(v)).alias("cell")) for v in values]))
    sketch = groups.select(*by, F.least("documents", F.lit(HALF_WAY)).alias("n"), each.alias("e")).select(*by, "n", "e.*")
    middle = _quantiles(sketch, [*by, "value"])
    return middle.groupBy(*[F.col(c).alias(f"w_{c}") for c in by]).agg(
        F.sum("documents").alias("w_documents"), *[F.max(F.when(F.col("value") == v, F.col("q50"))).alias(f"usual_{v}") for v in values])


def _drawn(own: str, wide: str, n: str) -> Column:
    return F.expr(f"({n} * {own} + {HALF_WAY} * {wide}) div ({n} + {HALF_WAY})")


def distances(sketch: DataFrame) -> DataFrame:
    """Per (language, source, measure): the median drawn towards the usual, and how far a cutoff may lie above and below."""
    least = F.create_map(*[F.lit(x) for kv in MEASURES.items() for x in kv])
    names = tuple(QUANTILES)
    own = _quantiles(sketch, ["lang", "source", "measure"])
    every = _usual(own, ["measure"], names).drop("w_documents").withColumnsRenamed({"w_measure": "a_measure"} | {f"usual_{q}": f"a_{q}" for q in names})
    lang = _usual(own, ["lang", "measure"], names).join(every, F.col("w_measure") == F.col("a_measure"))
    documents = F.expr(f"w_documents div {len(names)}").alias("w_documents")  # each of the values has counted them
    lang = lang.select("w_lang", "w_measure", documents, *[f"usual_{q}" for q in names], *[f"a_{q}" for q in names]).select(
        "w_lang", "w_measure", *[_drawn(f"usual_{q}", f"a_{q}", "w_documents").alias(f"l_{q}") for q in names])
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("w_lang")) & (F.col("measure") == F.col("w_measure")))
    both = both.select("lang", "source", "measure", "documents", *[_drawn(q, f"l_{q}", "documents").alias(q) for q in names])
    return both.withColumn("least", least[F.col("measure")]).select(
        "lang", "source", "measure", "documents", "q50", "least",
        (SPREAD * (F.col("q90") - F.col("q50")) + F.col("least")).cast("long").alias("above"),
        (SPREAD * (F.col("q50") - F.col("q10")) + F.col("least")).cast("long").alias("below"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """One row per (language, source) with the highest and, where there is one, the lowest value that passes, for each measure."""
    spread = rows.written(distances(sketch), "quality-spread")
    spread = spread.join(_usual(spread, ["measure"], ("above", "below")), F.col("measure") == F.col("w_measure"))
    reach = lambda side: F.least(F.col(side), F.col(f"usual_{side}") + F.expr("least div 4"))
    limits = spread.select("lang", "source", "measure", (F.col("q50") + reach("above")).alias("most"), (F.col("q50") - reach("below")).alias("least"))
    pick = lambda m, of, name: F.max(F.when(F.col("measure") == m, F.col(of))).alias(name)
    return limits.groupBy("lang", "source").agg(
        *[pick(m, "most", f"max_{m}") for m in MEASURES], *[pick(m, "least", f"min_{m}") for m in LOWER])


def assess(docs: DataFrame) -> DataFrame:
    """Counts, base verdict and adaptive verdict of every document."""
    measured = rows.written(features(docs).withColumns(measures()), "quality")
    limits = cutoffs(sketches(measured))
    d, c = measured.alias("d"), limits.alias("c")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    passes = F.lit(True)
    for m in MEASURES:
        passes = passes & (F.col(m) <= F.col(f"max_{m}"))
    for m in LOWER:
        passes = passes & (F.col(m) >= F.col(f"min_{m}"))
    joined = d.join(c, F.col("d.lang").eqNullSafe(F.col("c.lang")) & F.col("d.source").eqNullSafe(F.col("c.source")), "left")
    return joined.select(
        "d.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.coalesce(passes, F.lit(True))).alias("kept"), *MEASURES, *[f"max_{m}" for m in MEASURES], *[f"min_{m}" for m in LOWER])
