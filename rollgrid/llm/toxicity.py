"""Toxicity by a convolutional text classifier, trained in numpy.

Words (letters, digits and what is not ASCII, lower case) are embedded by hashing: a row for the word plus rows for its
first bytes, so that inflected forms share one. Filters of several widths run over the embedded words, the maximum over
the text is kept, and a logistic unit gives the score. At scoring time the filters are folded into the embedding table,
so a word costs a few table rows and no text is cut.

Training sees at most ``SAMPLE`` labelled documents of each label from the training folds, whole texts, as hashed words.
Of each five training rows one is held back; over all labelled rows held back, whatever their number, score histograms per
language give the thresholds. The histogram of all languages places the score 0.5; a language with ``LEAST_POSITIVES``
positives gets its own threshold, others 0.5. Scores themselves depend on the text alone.

Defined cases: a null or empty text scores like a text without words; rows with a null label or no document are not
learned from; repeated labels count as often as they occur; without both labels to learn from every score is below 0.5;
null languages form one group; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollgrid.llm import rows, words

#: Labelled documents of each label in the training sample at most, epochs over it, and texts of a step.
SAMPLE, EPOCHS, BATCH = {1: 1500, 0: 2500}, 8, 32
#: Bytes of word hashes (16 a word) that the sample may have; whole documents beyond, the longest first, are left out of it.
SAMPLE_BYTES = 64 << 20
#: Rows of the embedding table, its width, filter widths and filters per width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 12, (1, 2, 3), 4
#: Leading bytes that share a row.
PREFIXES = (4, 5, 6)
RATE, SEED = 0.1, 7
#: Every FOLDSth row is held out; of the others every HELD_BACKth serves the thresholds.
FOLDS, HELD_BACK = 5, 5
BINS, LEAST_POSITIVES = 1000, 20


class Model(NamedTuple):
    embed: np.ndarray  # BUCKETS x DIM
    filters: np.ndarray  # DIM x (one column per offset of a width and filter)
    bias: np.ndarray  # widths x filters
    out: np.ndarray
    base: float


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table for each word (itself, then its prefixes) and each text's first word."""
    found = words.Words(texts, words.ALPHANUMERIC)
    columns = [found.hashes()] + [words.mix(found.hashes(n) + np.uint64(n)) for n in PREFIXES]
    return np.stack([h % np.uint64(BUCKETS) for h in columns], 1).astype(np.int32), found.first


def _columns() -> list[tuple[int, int, slice]]:
    """(place of the width, offset in the window, columns of its filters) of every column group."""
    at, out = 0, []
    for w, width in enumerate(WIDTHS):
        for k in range(width):
            out.append((w, k, slice(at, at + FILTERS)))
            at += FILTERS
    return out


def windows(projected: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each width, what the filters give at every word; minus infinity where the window leaves the text."""
    n = len(projected)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    out = []
    for w, width in enumerate(WIDTHS):
        values = np.full((n, FILTERS), -np.inf, np.float32)
        there = left >= width
        parts = [c for v, _, c in _columns() if v == w]
        total = projected[:, parts[0]].copy()
        for k in range(1, width):
            total[: n - k] += projected[k:, parts[k]]
        values[there] = total[there]
        out.append(values)
    return out


def pooled(projected: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Maximum of every filter over each text; a text too short for a filter has zero."""
    counts = np.diff(first)
    out = np.zeros((len(counts), len(WIDTHS) * FILTERS), np.float32)
    full = np.flatnonzero(counts)
    if len(full):
        for w, values in enumerate(windows(projected, first)):
            top = np.maximum.reduceat(values, first[:-1][full], axis=0)
            out[full, w * FILTERS : (w + 1) * FILTERS] = np.where(np.isinf(top), 0, top)
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scores(model: Model, folded: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Scores of texts; ``folded`` is every embedding row through the filters."""
    ids, first = hashed_words(texts)
    projected = folded[ids[:, 0]]
    for c in range(1, ids.shape[1]):
        projected += folded[ids[:, c]]
    top = pooled(projected, first)
    return sigmoid(np.maximum(top + model.bias, 0) @ model.out + model.base).astype(np.float64)


def fit(texts: list[tuple[np.ndarray, int]]) -> Model:
    """Train on (hashed words, label) of each text by steps of Adagrad."""
    random = np.random.default_rng(SEED)
    embed = random.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    filters = random.normal(0, 0.3, (DIM, FILTERS * sum(WIDTHS))).astype(np.float32)
    bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    out = np.full(len(bias), 0.5, np.float32)
    base = -1.0
    toxic, clean = (sum(1 for _, y in texts if y == label) for label in (1, 0))
    if not toxic or not clean:
        return Model(embed * 0, filters, bias, out, -5.0)
    # The first dimension starts at the smoothed log odds of each row, and every filter looks at it.
    seen = np.zeros((2, BUCKETS))
    for ids, y in texts:
        seen[y][np.unique(ids)] += 1
    embed[:, 0] = np.clip(np.log((seen[1] + 3) / (toxic + 6)) - np.log((seen[0] + 3) / (clean + 6)), -2, 2)
    embed[(seen.sum(0) == 0), 0] = 0
    filters[0] = np.abs(filters[0])
    params = [embed, filters, bias, out]
    squares = [np.full(p.shape, 1e-2, np.float32) for p in params]
    base_square = 1e-2

    def step(k: int, grad: np.ndarray, at=slice(None)) -> None:
        squares[k][at] += grad * grad
        params[k][at] -= RATE * grad / np.sqrt(squares[k][at])

    for _ in range(EPOCHS):
        order = random.permutation(len(texts))
        for begin in range(0, len(order), BATCH):
            batch = [texts[i] for i in order[begin : begin + BATCH]]
            ids = np.concatenate([t for t, _ in batch])
            y = np.array([label for _, label in batch], np.float32)
            first = np.concatenate([[0], np.cumsum([len(t) for t, _ in batch])])
            vectors = embed[ids[:, 0]]
            for c in range(1, ids.shape[1]):
                vectors += embed[ids[:, c]]
            values = windows(vectors @ filters, first)
            top = np.zeros((len(batch), len(bias)), np.float32)
            place = np.full((len(batch), len(bias)), -1)
            for w in range(len(WIDTHS)):
                here = slice(w * FILTERS, (w + 1) * FILTERS)
                for d in range(len(batch)):
                    part = values[w][first[d] : first[d + 1]]
                    if len(part) >= WIDTHS[w]:
                        best = part.argmax(0)
                        top[d, here], place[d, here] = part[best, np.arange(FILTERS)], first[d] + best
            hidden = np.maximum(top + bias, 0)
            weight = np.where(y > 0, len(texts) / (2 * toxic), len(texts) / (2 * clean)).astype(np.float32)
            error = (sigmoid(hidden @ out + base) - y) * weight / len(batch)
            back = error[:, None] * out * (hidden > 0)
            filter_grad, rows_at, rows_grad = np.zeros_like(filters), [], []
            for w, k, columns in _columns():
                here = slice(w * FILTERS, (w + 1) * FILTERS)
                for f in range(FILTERS):
                    live = np.flatnonzero((place[:, here][:, f] >= 0) & (back[:, here][:, f] != 0))
                    at, g = place[live, w * FILTERS + f] + k, back[live, w * FILTERS + f]
                    filter_grad[:, columns.start + f] += g @ vectors[at]
                    rows_at.append(ids[at])
                    rows_grad.append(g[:, None] * filters[:, columns.start + f])
            at, grad = np.concatenate(rows_at), np.concatenate(rows_grad)
            step(3, error @ hidden)
            step(2, back.sum(0))
            step(1, filter_grad)
            for c in range(at.shape[1]):
                unique, of = np.unique(at[:, c], return_inverse=True)
                total = np.zeros((len(unique), DIM), np.float32)
                np.add.at(total, of, grad)
                step(0, total, unique)
            base_square += float(error.sum()) ** 2
            base -= RATE * float(error.sum()) / base_square**0.5
    return Model(embed, filters, bias, out, base)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit to a bounded sample of the labelled training rows, the first by a hash of their ids."""
    number = F.floor(fold(F.col("doc_id")) / FOLDS)
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        (fold(F.col("doc_id")) % FOLDS != 0) & (number % HELD_BACK != 0))
    parts = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in SAMPLE.items()]
    chosen = parts[0].unionByName(parts[1])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                ids, first = hashed_words(part.column("text"))
                packed = [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("toxic"), pa.array(packed, pa.binary())], ["doc_id", "toxic", "ids"])

    # The chosen rows are at most as many as SAMPLE says, so they go to every task.
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").mapInArrow(
        hashes, f"doc_id {kind}, toxic int, ids binary")
    # One row per id and label; then whole documents, the shortest first, up to SAMPLE_BYTES of word hashes.
    sized = texts.withColumn("size", F.octet_length("ids").cast("long"))
    first = sized.groupBy("doc_id", "toxic").agg(F.min(F.struct("size", "ids")).alias("least")).select("doc_id", "toxic", "least.*")
    first = rows.written(first, "toxicity-sample")
    upto = F.sum("size").over(Window.orderBy("size", "doc_id", "toxic"))  # SAMPLE rows at most
    kept = first.select("doc_id", "toxic", "size").withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES)
    whole = first.join(F.broadcast(kept.select("doc_id", "toxic")), ["doc_id", "toxic"])
    found = sorted(((r["doc_id"], r["ids"], r["toxic"]) for r in whole.toLocalIterator()), key=lambda r: (r[0], r[1]))
    return fit([(np.frombuffer(ids, np.int32).reshape(-1, 1 + len(PREFIXES)), y) for _, ids, y in found])


def score_column(docs: DataFrame, model: Model, name: str, keep: list[str]) -> DataFrame:
    """The kept columns of ``docs`` and the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        through = known.embed @ known.filters
        for batch in batches:
            for part in words.slices(batch):
                found = pa.array(scores(known, through, part.column("text")), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [found], names=[*keep, name])

    source = docs.select(*dict.fromkeys([*keep, docs.columns[text]]))
    fields = [docs.schema[c] for c in keep]
    schema = type(docs.schema)([*fields]).add(name, "double")
    return source.mapInArrow(run, schema)


def _best(histogram: DataFrame, group: list[str]) -> DataFrame:
    """Per group: the middle of the thresholds with the best F1 over a histogram of scores, and its positives."""
    by = Window.partitionBy(*group)
    above = by.orderBy(F.col("bin").desc())
    f1 = histogram.withColumns({
        "tp": F.sum("toxic").over(above), "flagged": F.sum("all").over(above), "positives": F.sum("toxic").over(by),
        "below": F.coalesce(F.lag("bin", -1).over(above), F.lit(-1)),
    }).withColumn("f1", 2 * F.col("tp") / (F.col("flagged") + F.col("positives")))
    best = f1.withColumn("best", F.max("f1").over(by)).where(F.col("f1") == F.col("best"))
    # Between an occupied bin and the next one below, every threshold flags the same texts.
    return best.groupBy(*group).agg(
        F.max("positives").alias("positives"), F.max(F.struct("bin", "below")).alias("at")).select(
        *group, "positives", ((F.col("at.bin") + F.col("at.below") + 1) / 2 / BINS).alias("threshold"))


def assess(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with ``score``, ``threshold`` of the language, ``predicted`` (at 0.5) and ``rejected``."""
    raw = "raw_toxicity"
    keep = [c for c in dict.fromkeys([*keep, "doc_id", "lang"]) if c not in (raw, "score", "threshold", "predicted", "rejected")]
    scored = rows.written(score_column(docs, train(docs, labels), raw, keep), "toxicity")
    number = F.floor(fold(F.col("doc_id")) / FOLDS)
    back = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        (fold(F.col("doc_id")) % FOLDS != 0) & (number % HELD_BACK == 0) & F.col("toxic").isin(0, 1))
    each = scored.select("doc_id", "lang", F.least(F.floor(F.col(raw) * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    histogram = each.join(back, "doc_id").groupBy("lang", "bin").agg(
        F.sum("toxic").alias("toxic"), F.count("*").alias("all"))
    histogram = rows.written(histogram, "toxicity-histogram")
    everywhere = histogram.groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("all").alias("all"))
    row = _best(everywhere.withColumn("one", F.lit(1)), ["one"]).first()  # BINS rows at most
    middle = row["threshold"] if row and row["positives"] else 0.5
    shift = float(np.log(middle / (1 - middle))) if 0 < middle < 1 else 0.0
    moved = lambda c: F.lit(1.0) / (1 + F.exp(-(F.ln(c / (1 - c)) - shift)))
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    per_lang = _best(histogram, ["lang"]).where(F.col("positives") >= LEAST_POSITIVES).select(
        F.col("lang").alias("threshold_lang"), moved(inside(F.col("threshold"))).alias("threshold"))
    out = scored.join(per_lang, F.col("lang").eqNullSafe(F.col("threshold_lang")), "left")
    score = moved(inside(F.col(raw)))
    return out.select(
        *keep, score.alias("score"), F.coalesce("threshold", F.lit(0.5)).alias("threshold"),
        (score >= 0.5).cast("int").alias("predicted"), (score >= F.coalesce("threshold", F.lit(0.5))).alias("rejected"))
