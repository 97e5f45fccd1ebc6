"""Hard negatives of anchor vectors, scored by Strassen multiplication of int64 tiles.

Vectors become integers (``floor(scale * x)``). Anchors travel to the candidates in blocks of bounded size, so candidates
are never shuffled. A task multiplies tiles of anchors by tiles of candidates and keeps, per anchor, heaps of the best
scores seen: first of rows with the anchor's label, its positives; then, with the positives' scores known, of rows with
another label inside the window of each positive. Heaps of different tiles and tasks merge by order (score falling, id
rising), so the result does not depend on how rows are dealt. Blocks follow one another and each result is a written table.

Strassen's seven products are formed recursively over quarters, padded with zeros to even sides. All additions are int64
and wrap, so a score is exact wherever it fits 64 bits. A small product runs in doubles where a bound says that they are
exact, otherwise in int64.

Defined cases: rows with a null label or vector, or with a null or non-finite component, take no part. Vectors of different
lengths are padded with zeros. Components beyond 2**62 are cut there. Rows are told apart by their id: a row with the
anchor's id is not its positive; anchors equal in id, label and vector are one; other repeated rows each take part. A null
id is never an anchor and comes last among ties. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollgrid import session

#: Bytes of anchors sent to the tasks at a time, anchors and candidates of a tile, and the side below which a product is plain.
BLOCK_BYTES, ANCHORS, CANDIDATES, LEAF = 32 << 20, 1024, 2048, 32
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these tenths of the positive's.
LOW, HIGH = 3, 9

_LEAST, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _plain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a.astype(np.float64), b.astype(np.float64)
    if a.size and b.size and np.abs(x).max() * np.abs(y).max() * a.shape[1] < 1 << 53:
        return (x @ y).astype(np.int64)
    return a @ b


def multiply(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, modulo 2**64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _plain(a, b)
    a = np.pad(a, ((0, m % 2), (0, k % 2))) if m % 2 or k % 2 else a
    b = np.pad(b, ((0, k % 2), (0, n % 2))) if k % 2 or n % 2 else b
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = multiply(a11 + a22, b11 + b22, leaf)
    p2 = multiply(a21 + a22, b11, leaf)
    p3 = multiply(a11, b12 - b22, leaf)
    p4 = multiply(a22, b21 - b11, leaf)
    p5 = multiply(a11 + a12, b22, leaf)
    p6 = multiply(a21 - a11, b11 + b12, leaf)
    p7 = multiply(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def _wide(lists: pa.ListArray, scale: float | None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as a matrix of integers padded with zeros, and which of them take part."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    missing = flat.is_null().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    if scale is not None:
        values = np.where(missing, np.nan, flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False))
        bad = ~np.isfinite(values)
        values = np.clip(np.floor(np.where(bad, 0, values) * scale), -(2.0**62), 2.0**62).astype(np.int64)
    else:
        values, bad = flat.to_numpy(zero_copy_only=False), missing
    matrix = np.zeros((len(lists), int(counts.max(initial=0))), np.int64)
    matrix[owner, place] = values
    takes = ~lists.is_null().to_numpy(zero_copy_only=False)
    takes[owner[bad]] = False
    return matrix, takes


class Tile:
    """Rows of a batch that take part, in rising order of ids."""

    def __init__(self, batch: pa.RecordBatch, scale: float | None):
        matrix, takes = _wide(batch.column("vector"), scale)
        takes &= batch.column("label").is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column("vec_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        order = order[takes[order]]
        self.ids, self.matrix = ids[order], matrix[order]
        self.labels = batch.column("label").fill_null(0).to_numpy(zero_copy_only=False)[order]


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    wide = max(anchors.shape[1], candidates.shape[1])
    full = lambda x: np.pad(x, ((0, 0), (0, wide - x.shape[1]))) if x.shape[1] < wide else x
    return multiply(full(anchors), np.ascontiguousarray(full(candidates).T))


class Heaps:
    """The ``keep`` best (score, id) of each of ``n`` groups; scores fall, ids rise."""

    def __init__(self, n: int, keep: int):
        self.keep = keep
        self.scores, self.ids, self.held = np.full((n, keep), _LEAST), np.full((n, keep), _LAST), np.zeros(n, np.int64)

    def floor(self) -> np.ndarray:
        """Lower scores cannot enter."""
        return np.where(self.held == self.keep, self.scores[:, -1], _LEAST)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(group)
        if not len(touched):
            return
        here = np.arange(self.keep)[None, :] < self.held[touched][:, None]
        group = np.concatenate([np.repeat(touched, self.held[touched]), group])
        score, ids = np.concatenate([self.scores[touched][here], score]), np.concatenate([self.ids[touched][here], ids])
        order = np.lexsort((ids, ~score, group))
        group, score, ids = group[order], score[order], ids[order]
        first = np.searchsorted(group, touched)
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        best = rank < self.keep
        self.scores[group[best], rank[best]], self.ids[group[best], rank[best]] = score[best], ids[best]
        self.held[touched] = np.minimum(np.diff(np.append(first, len(group))), self.keep)

    def rows(self, first: int = 0) -> pa.RecordBatch:
        group, rank = np.nonzero(np.arange(self.keep)[None, :] < self.held[:, None])
        ids = self.ids[group, rank]
        return pa.RecordBatch.from_arrays(
            [pa.array(group + first), pa.array(self.scores[group, rank]), pa.array(ids, mask=ids == _LAST)], ["place", "score", "found_id"])


def _tiles(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[Tile]:
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATES):
            tile = Tile(batch.slice(at, CANDIDATES), scale)
            if len(tile.ids):
                yield tile


def _positive_heaps(anchors: Tile, scale: float):
    """Best rows of each anchor's label. Anchors come sorted by label here, so a label is one range of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(anchors.ids), POSITIVES)
        by_label = np.argsort(anchors.labels, kind="stable")
        sorted_labels = anchors.labels[by_label]
        for tile in _tiles(batches, scale):
            for label in np.intersect1d(sorted_labels, tile.labels):
                same = tile.labels == label
                ids, matrix = tile.ids[same], tile.matrix[same]
                a, b = np.searchsorted(sorted_labels, [label, label + 1])
                for at in range(a, b, ANCHORS):
                    some = by_label[at : min(at + ANCHORS, b)]
                    score = scores(anchors.matrix[some], matrix)
                    x, y = np.nonzero((score >= heaps.floor()[some][:, None]) & (anchors.ids[some][:, None] != ids[None, :]))
                    heaps.add(some[x], score[x, y], ids[y])
        yield heaps.rows()

    return run


def window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score s with LOW * positive <= 10 * s <= HIGH * positive, without leaving 64 bits."""
    tens, ones = positive // 10, positive % 10
    return LOW * tens - (-LOW * ones) // 10, HIGH * tens + HIGH * ones // 10


def _negative_heaps(anchors: Tile, owner: np.ndarray, positive: np.ndarray, scale: float):
    """Best rows of other labels in the window of each positive; ``owner``: the anchor of each positive, rising."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(owner), NEGATIVES)
        low, high = window(positive)
        for tile in _tiles(batches, scale):
            for at in range(0, len(anchors.ids), ANCHORS):
                score = scores(anchors.matrix[at : at + ANCHORS], tile.matrix)
                other = anchors.labels[at : at + ANCHORS, None] != tile.labels[None, :]
                a, b = np.searchsorted(owner, [at, at + ANCHORS])
                floor = np.maximum(low, heaps.floor())
                for c in range(a, b, ANCHORS):  # as many positives at a time as anchors
                    of = slice(c, min(c + ANCHORS, b))
                    held = score[owner[of] - at]
                    x, y = np.nonzero((held >= floor[of][:, None]) & (held <= high[of][:, None]) & other[owner[of] - at])
                    heaps.add(x + c, held[x, y], tile.ids[y])
        yield heaps.rows()

    return run


def _merged(found: DataFrame, keep: int) -> DataFrame:
    """Heaps of all tasks as one; of each task's, no more rows than ``keep`` meet."""
    over = Window.partitionBy("place").orderBy(F.desc("score"), F.col("found_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= keep)


def _anchors(vectors: DataFrame, every: int, scale: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile = Tile(batch, scale)
            values = pa.ListArray.from_arrays(
                pa.array(np.arange(len(tile.ids) + 1, dtype=np.int32) * tile.matrix.shape[1], pa.int32()), pa.array(tile.matrix.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(tile.ids, pa.int64()), pa.array(tile.labels, pa.int64()), values], ["vec_id", "label", "vector"])

    return vectors.where(F.col("vec_id") % every == 0).mapInArrow(run, "vec_id long, label long, vector array<long>").distinct()


FOUND = "place long, score long, found_id long"


def mine(embeddings: DataFrame, scale: float = 256.0, every: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per anchor (ids divisible by ``every``) and positive: its hardest negatives in rank order.

    ``embeddings``: vec_id, embedding, label."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                                F.col("embedding").alias("vector"))
    anchors = session.written(_anchors(vectors, every, scale), "anchors")
    size = anchors.agg(F.coalesce(F.sum(16 + 8 * F.size("vector")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-size // block_bytes))
    path = session.fresh_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in range(blocks):
        here = anchors.where(F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks)) == block).toArrow()  # block_bytes, about
        tile = Tile(here.combine_chunks().to_batches()[0], None) if here.num_rows else None
        if tile is None:
            continue
        of_label = vectors.mapInArrow(_positive_heaps(tile, scale), FOUND)
        best = _merged(of_label, POSITIVES).select("place", "score", "found_id").orderBy("place", "rank").toArrow()  # five rows an anchor
        owner, positive = best.column("place").to_numpy(), best.column("score").to_numpy()
        if not len(owner):
            continue
        named = spark.createDataFrame(pa.table({
            "place": pa.array(np.arange(len(owner))), "anchor_id": pa.array(tile.ids[owner]), "positive_id": best.column("found_id"),
            "positive_score": best.column("score")}))
        others = _merged(vectors.mapInArrow(_negative_heaps(tile, owner, positive, scale), FOUND), NEGATIVES)
        others.join(named, "place").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
