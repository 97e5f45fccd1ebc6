"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document is the set of its distinct windows of ``WIDTH`` words. Documents with equal sets are one class, so copies
count once. A class has ``CHUNKS * SYMBOLS`` MinHash values of ``BITS`` bits. By pigeonhole, two signatures that differ
in fewer than ``CHUNKS * (ERRORS + 1)`` values have a chunk with at most ``ERRORS`` differences; every choice of
``ERRORS`` positions left out of a chunk is a key, so all pairs under that distance share a key. (At Jaccard 0.85 a pair
shares no key with a chance of 6e-6; at 0.8 with 2e-4, and with 11 chunks 8e-6.) Candidates are confirmed on full sets.

Pairs inside a bucket are not written out. Every bucket is first a star around its smallest class, its lead; the
confirmed links give components. Buckets that then still hold classes of different components are taken together by
lead and cut into tiles of bounded size, by size band of the sets and by hash. Tiles whose bands allow the similarity
meet pairwise in a task, which multiplies their sets as matrices and gives back the links only. So groups of near copies
stay linear in rows, no link between different texts is lost, and no task holds more than two tiles.

A class also has a parity bitmap: each element flips one bit. Two bitmaps differ in no more bits than their sets differ in
elements, which bounds the intersection from above, so most candidates go by their bitmaps (a thirtieth of a set or less)
and only sets that may link move; no link is lost by it.

Texts are read twice; only those of classes with such candidates move. Skewed buckets, hubs and classes are summed before
shuffles, or joined, which Spark splits. Intermediate tables lie in the shared folder.

Defined cases: a null or empty text has an empty set and is its own component; rows that share an id are judged each by
its text; null ids come after all others, and a component of null ids has a null id; an empty table gives no rows; other columns of the
table are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid import session
from rollgrid.llm import rows, words

WIDTH = 5
CHUNKS, SYMBOLS, ERRORS, BITS = 8, 6, 1, 16
MOST_CHUNKS = 16
#: Classes and set elements of a tile, about, and columns of a matrix at a time.
TILE, TILE_ELEMENTS, COLUMNS = 256, 1 << 17, 4096
#: Bits of the smallest bitmap.
LEAST_BITS = 64
#: Ids that may be broadcast to pick texts from the documents; more are joined.
BROADCAST_IDS = 1_000_000

_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, MOST_CHUNKS * SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct windows of each text, and where each text's begin."""
    found = words.Words(texts, words.UNSPACED)
    return words.distinct(*words.shingles(found.hashes(), found.first, WIDTH))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def bitmaps(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity bitmap of each set: a bit is set if an odd number of elements fall on it. As many bits as elements, rounded up
    to a power of two, 64 at least; with half as many bits it is both halves combined by exclusive or."""
    sizes = np.diff(bounds)
    widths = np.left_shift(1, np.ceil(np.log2(np.maximum(sizes, LEAST_BITS))).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(widths)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = (words.mix(values + np.uint64(0x632BE59BD9B4E019)) & (widths[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(starts[owner] + place, minlength=starts[-1]) & 1
    packed = np.packbits(odd.astype(bool), bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip(starts[:-1] // 8, starts[1:] // 8)]


def _folded(bitmap: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of 64-bit words with ``width`` words, a power of two."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, width), axis=0) if len(bitmap) > width else bitmap


def may_link(sizes: tuple[np.ndarray, np.ndarray], bits: tuple[list[bytes], list[bytes]], percent: int) -> np.ndarray:
    """For every set of one list and every one of another: whether sizes and bitmaps leave room for a link."""
    maps = [[np.frombuffer(b, np.uint64) for b in part] for part in bits]
    width = min(len(m) for part in maps for m in part)
    first, second = (np.stack([_folded(m, width) for m in part]) for part in maps)
    differ = np.zeros((len(first), len(second)), np.int64)
    for k in range(width):
        differ += np.bitwise_count(first[:, k, None] ^ second[None, :, k])
    total = sizes[0][:, None] + sizes[1][None, :]
    shared = np.minimum((total - differ) // 2, np.minimum(sizes[0][:, None], sizes[1][None, :]))
    return 100 * shared >= percent * (total - shared)


def signatures(values: np.ndarray, bounds: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """b-bit MinHash values of each non-empty set, one row per text (zeros for empty sets)."""
    out = np.zeros((len(bounds) - 1, chunks * SYMBOLS), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k, factor in enumerate(_FACTORS[: chunks * SYMBOLS]):
            least = np.minimum.reduceat((values * factor) >> np.uint64(24), bounds[:-1][full])
            out[full, k] = (words.mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint16)
    return out


def keys(signature: np.ndarray) -> np.ndarray:
    """One key per chunk and choice of positions left out."""
    out = []
    for c in range(signature.shape[1] // SYMBOLS):
        chunk = signature[:, c * SYMBOLS : (c + 1) * SYMBOLS].astype(np.uint64)
        for left_out in combinations(range(SYMBOLS), ERRORS):
            key = np.full(len(chunk), len(out) + 1, np.uint64)
            for s in range(SYMBOLS):
                if s not in left_out:
                    key = words.mix(key * np.uint64(0x2545F4914F6CDD1D) + chunk[:, s])
            out.append(key.view(np.int64))
    return np.stack(out, 1)


class Scheme(NamedTuple):
    """How texts become sets, what is kept of each set, and the keys read from that; linked sets share a key."""

    sets: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    sign: Callable[[np.ndarray, np.ndarray], list[bytes]]  # values and bounds
    keys: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray | int]]  # all keys, and how many of each
    rare: bool = False  # most keys are of one set; these are then left out before keys are written
    element: type = np.uint64  # of a set that travels; values must fit


def minhash(chunks: int = CHUNKS) -> Scheme:
    def sign(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        return [s.tobytes() for s in signatures(values, bounds, chunks)]

    def keys_of(signed: list[bytes]) -> tuple[np.ndarray, np.ndarray | int]:
        key = keys(np.frombuffer(b"".join(signed), np.uint16).reshape(len(signed), -1))
        return key.ravel(), key.shape[1]

    return Scheme(sets, sign, keys_of)


def _tie(text: str = "text") -> Column:
    """Tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _described(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Per document: a hash of its text, two hashes of its set, the set's size, its signature and its bitmap."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                values, bounds = scheme.sets(part.column("text"))
                empty = np.diff(bounds) == 0
                packed = scheme.sign(values, bounds)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tie"), pa.array(_sums(words.mix(values), bounds), mask=empty),
                     pa.array(_sums(words.mix(values ^ np.uint64(0x5555555555555555)), bounds), mask=empty),
                     pa.array(np.diff(bounds), pa.int64()), pa.array(packed, pa.binary()), pa.array(bitmaps(values, bounds), pa.binary())],
                    ["doc_id", "tie", "h1", "h2", "n", "signature", "bits"])

    return docs.select("doc_id", "text", _tie().alias("tie")).mapInArrow(
        run, f"doc_id {kind}, tie long, h1 long, h2 long, n long, signature binary, bits binary")


def _keyed(classes: DataFrame, scheme: Scheme) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                key, times = scheme.keys(part.column("signature").to_pylist())
                repeat = lambda c: pa.array(np.repeat(part.column(c).to_numpy(zero_copy_only=False), times))
                yield pa.RecordBatch.from_arrays([pa.array(key), repeat("node"), repeat("n")], ["key", "node", "n"])

    return classes.select("node", "n", "signature").mapInArrow(run, "key long, node long, n long")


def _similar_size(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _texts_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """Sets of the given classes, from the texts of their documents."""
    wanted = rows.written(nodes.join(classes.select("node", "h1", "h2", "doc_id"), "node"), "near-wanted")
    ids = wanted.select("node", F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("doc_id").alias("w_id"))
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    chosen = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("w_id"))).select("node", "w1", "w2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                values, bounds = scheme.sets(part.column("text"))
                same = ((_sums(words.mix(values), bounds) == part.column("w1").to_numpy())
                        & (_sums(words.mix(values ^ np.uint64(0x5555555555555555)), bounds) == part.column("w2").to_numpy()))
                carried = values.astype(scheme.element)
                packed = [carried[bounds[i] : bounds[i + 1]].tobytes() for i in np.flatnonzero(same)]
                yield pa.RecordBatch.from_arrays([part.column("node").filter(pa.array(same)), pa.array(packed, pa.binary())], ["node", "set"])

    return chosen.mapInArrow(run, "node long, set binary").dropDuplicates(["node"])


def _possible(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps do not rule out."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            bits = zip(*(batch.column(c).to_pylist() for c in ("bits_a", "bits_b")))
            open_ = [bool(may_link((n_a[k : k + 1], n_b[k : k + 1]), ([x], [y]), percent)[0, 0]) for k, (x, y) in enumerate(bits)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(open_, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    full = rows.written(_texts_of(docs, classes, nodes, scheme), "near-sets")
    both = pairs.join(full.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(
        full.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for k, (a, b) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                x, y = (np.frombuffer(s.as_buffer(), scheme.element) for s in (a, b))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int(np.count_nonzero(y[at] == x))
                linked[k] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(linked)) for c in ("a", "b")], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _tile_pairs(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Tiles per (lead, band), and the pairs of tiles of one lead that can hold links: their bands have more than one label
    and sizes that allow one. ``least_2`` is the smallest set of the second band, ``most`` the largest of the first."""
    sizes = members.groupBy("lead", "band").agg(
        F.count("*").alias("m"), F.sum("n").alias("elements"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.min("label").alias("low"), F.max("label").alias("high"))
    tiles = sizes.withColumn("tiles", F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("elements") / TILE_ELEMENTS)))
    tiles = rows.written(tiles.drop("m", "elements"), "near-tile-counts")
    each = tiles.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).drop("tiles")
    second = each.withColumnsRenamed({c: f"{c}_2" for c in each.columns})
    same, next_ = F.col("band_2") == F.col("band"), F.col("band_2") == F.col("band") + 1
    sizes_allow = 100 * F.col("most") >= percent * F.col("least_2")
    mixed = F.least("low", "low_2") < F.greatest("high", "high_2")
    met = each.join(second, (F.col("lead") == F.col("lead_2")) & mixed & (
        (same & (F.col("tile_2") >= F.col("tile"))) | (next_ & sizes_allow)))
    met = met.select("lead", "band", "tile", "most", "band_2", "tile_2", "least_2")
    return tiles.select("lead", "band", "tiles"), met.withColumn("pair", F.xxhash64("lead", "band", "tile", "band_2", "tile_2"))


def _linked_in_tiles(docs: DataFrame, classes: DataFrame, open_: DataFrame, percent: int, scheme: Scheme) -> DataFrame:
    """Links between classes of one lead and different labels; ``open_``: lead, node, n, label."""
    band = F.floor(F.ln(F.col("n").cast("double")) / F.lit(-float(np.log(percent / 100 - 1e-3)))).cast("int")  # a little wider than need be
    members = open_.withColumn("band", band)
    tiles, pairs = _tile_pairs(members, percent)
    placed = members.join(tiles, ["lead", "band"]).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles"))
    pairs = rows.written(pairs, "near-tiles")
    # A member goes to the pairs whose other band has a set that its size allows.
    ones = placed.join(pairs, ["lead", "band", "tile"]).where(100 * F.col("n") >= percent * F.col("least_2")).select(
        "pair", F.lit(0).alias("side"), "node", "n", "label")
    others = pairs.where("band <> band_2 or tile <> tile_2").select(
        "lead", F.col("band_2").alias("band"), F.col("tile_2").alias("tile"), "pair", "most")
    twos = placed.join(others, ["lead", "band", "tile"]).where(100 * F.col("most") >= percent * F.col("n")).select(
        "pair", F.lit(1).alias("side"), "node", "n", "label")
    every = ones.unionByName(twos).join(classes.select("node", "bits"), "node")
    met = rows.written(_by_pair(every, ["node", "n", "label", "bits"], lambda held: _meeting(held, percent),
                                "pair long, side int, node long, label long"), "near-met")
    full = rows.written(_texts_of(docs, classes, met.select("node").distinct(), scheme), "near-sets")
    return _by_pair(met.join(full, "node"), ["node", "label", "set"], lambda held: _links_of(held, percent, scheme.element),
                    "a long, b long").distinct()


def _by_pair(members: DataFrame, columns: list[str], apply: Callable[[list[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``apply`` to the rows (pair, side, columns) of every pair of tiles. Tiles are many and each is small, so a task streams
    its pairs one after the other."""
    columns = ["pair", "side", *columns]
    lined = members.repartition(session.task_count(members.sparkSession), "pair").sortWithinPartitions("pair", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pair = [], None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if row[0] != pair:
                    yield from apply(held)
                    held, pair = [], row[0]
                held.append(row)
        yield from apply(held)

    return lined.select(*columns).mapInArrow(run, schema)


def _sides(held: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """The members of both tiles of a pair; those of a tile that meets itself twice."""
    first, second = ([r for r in held if r[1] == side] for side in (0, 1))
    return first, second or first


def _meeting(held: list[tuple], percent: int) -> Iterator[pa.RecordBatch]:
    """The members (pair, side, node, n, label, bits) of a pair of tiles that may link to one of another label."""
    first, second = _sides(held)
    if not first or len({r[4] for r in held}) < 2:
        return
    sizes = tuple(np.array([r[3] for r in part]) for part in (first, second))
    label = [np.array([r[4] for r in part]) for part in (first, second)]
    open_ = may_link(sizes, tuple([r[5] for r in part] for part in (first, second)), percent) & (label[0][:, None] != label[1][None, :])
    stay = [r for r, some in zip(first, open_.any(axis=1)) if some]
    if second is not first:
        stay += [r for r, some in zip(second, open_.any(axis=0)) if some]
    if stay:
        pair, side, node, _, of, _ = zip(*stay)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pair, pa.int64()), pa.array(side, pa.int32()), pa.array(node, pa.int64()), pa.array(of, pa.int64())],
            ["pair", "side", "node", "label"])


def _links_of(held: list[tuple], percent: int, element: type) -> Iterator[pa.RecordBatch]:
    """Links between the two tiles of a pair, or inside the only one; of those that join the same members, as many as it takes."""
    first, second = _sides(held)
    if len({r[3] for r in held}) < 2 or not first:
        return
    shared, sizes = _shared([np.frombuffer(r[4], element) for r in first], [np.frombuffer(r[4], element) for r in second])
    total = sizes[0][:, None] + sizes[1][None, :] - shared
    node = [np.array([r[2] for r in part]) for part in (first, second)]
    label = [np.array([r[3] for r in part]) for part in (first, second)]
    x, y = _forest((100 * shared >= percent * total) & (label[0][:, None] != label[1][None, :]))
    if len(x):
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[0][x], node[1][y])), pa.array(np.maximum(node[0][x], node[1][y]))], ["a", "b"])


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) that join whatever all links of a matrix join, fewer than it has rows and columns."""
    waiting = [linked.any(axis=1), linked.any(axis=0)]
    sides, x, y = (linked, linked.T), [], []
    for root in range(len(linked)):
        reached = [(0, root)] if waiting[0][root] else []
        waiting[0][root] = False
        while reached:
            side, at = reached.pop()
            found = np.flatnonzero(sides[side][at] & waiting[1 - side])
            waiting[1 - side][found] = False
            reached += [(1 - side, k) for k in found]
            ends = (np.full(len(found), at), found) if side == 0 else (found, np.full(len(found), at))
            x.append(ends[0])
            y.append(ends[1])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(x or none), np.concatenate(y or none)


def _shared(first: list[np.ndarray], second: list[np.ndarray]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Sizes of the intersections of all sets of both lists, and the sizes of the sets."""
    sizes = tuple(np.array([len(s) for s in part], np.int64) for part in (first, second))
    values = [np.concatenate(part) for part in (first, second)]
    common = np.intersect1d(*values)
    at = [np.searchsorted(common, v) for v in values]
    owner = [np.repeat(np.arange(len(s)), s) for s in sizes]
    for k in (0, 1):
        here = (at[k] < len(common)) & (common[np.minimum(at[k], len(common) - 1)] == values[k]) if len(common) else np.zeros(len(at[k]), bool)
        at[k], owner[k] = at[k][here], owner[k][here]
    shared = np.zeros((len(first), len(second)), np.float32)
    for begin in range(0, len(common), COLUMNS):
        parts = []
        for k in (0, 1):
            dense = np.zeros((len(sizes[k]), min(COLUMNS, len(common) - begin)), np.float32)
            here = (at[k] >= begin) & (at[k] < begin + COLUMNS)
            dense[owner[k][here], at[k][here] - begin] = 1
            parts.append(dense)
        shared += parts[0] @ parts[1].T
    return shared.astype(np.int64), sizes


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from every linked node: (node, label)."""
    both = rows.written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    label = rows.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "near-labels")
    while True:
        heard = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        lower = label.join(heard, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        lower = rows.written(lower, "near-lower")
        target = lower.select(F.col("node").alias("at"), F.col("label").alias("further"))
        jumped = rows.written(lower.join(target, F.col("label") == F.col("at")).select(
            "node", "was", F.least("label", "further").alias("label")), "near-labels")
        label = jumped.select("node", "label")
        if jumped.where("label < was").isEmpty():
            return label


def link(docs: DataFrame, percent: int = 85, chunks: int = CHUNKS) -> DataFrame:
    """Per document: size of its set, its component (the smallest id in it), and whether it is that document."""
    return linked(docs, percent, minhash(chunks)).drop("tie", "group")


def linked(docs: DataFrame, percent: int, scheme: Scheme) -> DataFrame:
    """``link`` with sets and keys of any scheme, a hash of each document's text (``tie``) and one of its component (``group``)."""
    described = rows.written(_described(docs, scheme), "near-described")
    classes = described.where("n > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature"),
        F.first("bits").alias("bits"))
    classes = rows.written(classes.withColumn("node", F.col("h1")), "near-classes")
    keyed = _keyed(classes, scheme)
    if scheme.rare:
        shared = rows.written(keyed.groupBy("key").count().where("count > 1").select("key"), "near-shared")
        keyed = keyed.join(F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared, "key")
    keyed = rows.written(keyed, "near-keys")

    star = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.count("*").alias("members")).where("members > 1")
    stars = keyed.join(star.select("key", "lead"), "key").where(
        (F.col("node") != F.col("lead.node")) & _similar_size("n", "lead.n", percent))
    tried = stars.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()
    tried = rows.written(_possible(classes, tried, percent), "near-stars")
    links = rows.written(_confirmed(docs, classes, tried, percent, scheme), "near-confirmed")
    label = components(links)

    labelled = keyed.join(label, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    leads = mixed.select("key").join(star.select("key", F.col("lead.node").alias("lead")), "key")
    open_ = labelled.join(leads, "key").select("lead", "node", "n", "label").distinct()
    more = rows.written(_linked_in_tiles(docs, classes, rows.written(open_, "near-open"), percent, scheme), "near-confirmed")
    if not more.isEmpty():
        label = components(links.unionByName(more))

    # Components are named by their smallest id; a class without links by its own.
    in_links = classes.join(label, "node").select("h1", "h2", "doc_id", "label")
    names = in_links.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = in_links.join(names, "label").select("h1", "h2", "component_id", F.col("label").alias("group"))
    alone = classes.join(label, "node", "left_anti").select("h1", "h2", F.col("doc_id").alias("component_id"), F.col("node").alias("group"))
    named = named.unionByName(alone).select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "component_id", "group")
    out = described.join(named, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    component = F.when(F.col("c1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "tie", "group", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85, chunks: int = CHUNKS) -> DataFrame:
    """The rows of ``docs`` that stay: of every component one, with the smallest id and of that the first text by its hash.

    Each row is judged by its own text, whatever other texts share its id. Texts without words are components of their own;
    of rows with equal id and text one stays. Only the (id, text hash) pairs that go or repeat are joined, so texts do not
    move unless rows repeat.
    """
    found = rows.written(linked(docs, percent, minhash(chunks)), "near-linked")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    stays = found.where("group IS NOT NULL").groupBy(F.col("group").alias("of_group")).agg(F.min(first).alias("stays"))
    judged = found.groupBy("group", "doc_id", "tie").agg(F.count("*").alias("times")).join(stays, F.col("group") == F.col("of_group"), "left")
    keeps = F.col("group").isNull() | (F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("tie") == F.col("stays.tie")))
    marked = judged.select(F.col("doc_id").alias("marked_id"), F.col("tie").alias("marked_tie"), keeps.alias("keeps"), "times")
    marked = rows.written(marked.where("not keeps or times > 1"), "near-marked")
    same = docs["doc_id"].eqNullSafe(marked["marked_id"]) & (_tie() == marked["marked_tie"])
    once = docs.join(marked, same, "left_anti")
    repeated = marked.where("keeps").select("marked_id", "marked_tie")
    if repeated.isEmpty():
        return once
    again = docs["doc_id"].eqNullSafe(repeated["marked_id"]) & (_tie() == repeated["marked_tie"])
    return once.unionByName(docs.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "text"]))
