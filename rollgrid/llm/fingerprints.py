"""Document fingerprints from spots: chains of content words that follow common words.

Every common word (anchor) of a text starts a signature: the anchor and the next ``CHAIN`` content words behind it. The
fingerprint is the sorted set of 32-bit signature hashes. Two fingerprints are compared by Jaccard.

``alike`` joins the whole corpus with itself by Jaccard of at least ``LEAST`` per cent. Signatures have an order: those
seen to be frequent last, by rising count, the others before them by hash. A set of n signatures of which o are needed
is met by its first n - o + 1 only (prefix); any order misses no pair. Equal sets are one class. What then follows is the
join of ``near_duplicates``: stars, then tiles of hot signatures by length partition, links confirmed on full sets. A
document's ``alike_id`` is the smallest id that a chain of such links reaches (its own where there is none).

A text without a signature is described by its words instead, a text without words by nothing (empty fingerprint); two
empty fingerprints have likeness 1, an empty and another 0. In ``alike`` an empty one links to nothing.

``edited`` gives every document the one after it in falling order of ids. Documents are cut into id ranges by quantiles
of the ids, each range is sorted on its own and followed by the first document of the next range, so texts move once and
no task holds more than a slice of its range.

Defined cases: a null text is empty; null ids come last, repeated ids in the order of a hash of the text; a single
document follows itself; an empty table gives no rows; other columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid import session
from rollgrid.llm import near_duplicates, rows, words

CHAIN = 2
#: Bytes of text in an id range, about.
RANGE_BYTES = 32 << 20
#: Jaccard, in per cent, from which the join of the corpus links two fingerprints.
LEAST = 80
#: Frequent signatures that the order knows; more or fewer change speed only.
KNOWN = 10_000

# Common words of English, German, French and Spanish.
ANCHORS = """
the of and to a in is that for it as was with be by on not he his but at are this have from or
der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an
le la les de des et un une du en que qui dans par pour sur est au avec ce
el los las del y que en un una por con para es se lo su al
""".split()


def _hash(word: str) -> int:
    return int(words.Words(pa.array([word]), words.ALPHANUMERIC).hashes()[0])


_ANCHOR_HASHES = np.unique(np.array([_hash(w) for w in ANCHORS], np.uint64))


def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The signature sets of all texts, each sorted, and where each begins."""
    found = words.Words(texts, words.ALPHANUMERIC)
    h, first = found.hashes(), found.first
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    common = np.isin(h, _ANCHOR_HASHES)
    anchors, content = np.flatnonzero(common), np.flatnonzero(~common)
    at = np.searchsorted(content, anchors)
    fits = at + CHAIN <= len(content)
    anchors, at = anchors[fits], at[fits]
    inside = text_of[content[at + CHAIN - 1]] == text_of[anchors] if len(at) else np.zeros(0, bool)
    anchors, at = anchors[inside], at[inside]
    value = words.mix(h[anchors])
    for k in range(CHAIN):
        value = words.mix(value * np.uint64(0x2545F4914F6CDD1D) + h[content[at + k]])
    owner = text_of[anchors]
    bare = np.bincount(owner, minlength=len(texts)) == 0
    lone = np.flatnonzero(bare[text_of]) if len(text_of) else np.zeros(0, int)
    owner, value = np.concatenate([owner, text_of[lone]]), np.concatenate([value, h[lone]])
    order = np.argsort(owner, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
    return words.distinct(value[order] >> np.uint64(32), bounds)


def signatures(texts: pa.Array) -> list[np.ndarray]:
    """The sorted signature set of every text."""
    values, bounds = sets(texts)
    return [values[a:b].astype(np.uint32) for a, b in zip(bounds[:-1], bounds[1:])]


def text_of(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def frequent(docs: DataFrame) -> np.ndarray:
    """Signatures that several texts of one slice share, the most frequent last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                value, times = np.unique(sets(part.column("text"))[0], return_counts=True)
                often = times > 1
                yield pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(times[often])], ["value", "times"])

    sums = docs.select("text").mapInArrow(run, "value long, times long").groupBy("value").agg(F.sum("times").alias("times"))
    most = sums.orderBy(F.desc("times"), "value").limit(KNOWN).collect()
    return np.array([r["value"] for r in reversed(most)], np.uint64)


def prefixes(values: np.ndarray, bounds: np.ndarray, known: np.ndarray, percent: int) -> list[bytes]:
    """The first n - o + 1 signatures of each set of n, where a link needs o of them."""
    by_value = np.argsort(known)
    at = np.minimum(np.searchsorted(known[by_value], values), max(len(known) - 1, 0))
    late = known[by_value][at] == values if len(known) else np.zeros(len(values), bool)
    place = np.where(late, by_value[at] + 1 if len(known) else 0, 0)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((values, place, owner))
    needed = -(-percent * sizes // 100)
    ends = bounds[:-1] + np.where(sizes > 0, sizes - needed + 1, 0)
    placed = values[order].astype(np.uint32)
    return [placed[a:b].tobytes() for a, b in zip(bounds[:-1], ends)]


def alike(docs: DataFrame, percent: int = LEAST) -> DataFrame:
    """Per document: a hash of its text (tie), and the smallest id that links of the whole corpus reach (component_id)."""
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs))

    def keys(signed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(signed), np.uint32).astype(np.int64), np.array([len(s) // 4 for s in signed], np.int64)

    scheme = near_duplicates.Scheme(sets, lambda values, bounds: prefixes(values, bounds, known.value, percent), keys, rare=True, element=np.uint32)
    return near_duplicates.linked(docs, percent, scheme)


def _range_of(doc_id: Column, cuts: list) -> Column:
    """How many cuts lie above an id (null: all of them), found in two steps."""
    if not cuts:
        return F.lit(0)
    above = lambda part: F.size(F.filter(part, lambda c: c > doc_id))
    wide = max(1, math.isqrt(len(cuts)))
    falling = sorted(cuts, reverse=True)
    coarse = above(F.lit(falling[wide - 1 :: wide]))  # whole groups of cuts above the id
    exact = coarse * wide + above(F.slice(F.lit(falling), coarse * wide + 1, wide))
    return F.when(doc_id.isNull(), len(cuts)).otherwise(exact)


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (the second half taken from the next document), and its ``alike_id``."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    ranges = max(session.task_count(spark), -(-size // RANGE_BYTES))
    marks = [k / ranges for k in range(1, ranges)]
    cuts = docs.agg(F.percentile_approx("doc_id", marks, max(10_000, 20 * ranges)).alias("c")).first()["c"] if marks else None
    cuts = sorted(set(cuts or []))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"range": _range_of(F.col("doc_id"), cuts), "tie": F.xxhash64("text"), "guest": F.lit(0)})
    order = [F.col("doc_id").desc_nulls_last(), "tie"]
    top = own.groupBy("range").agg(F.max(F.struct("doc_id", -F.col("tie"))).alias("m")).orderBy("range").collect()  # one row per range
    heads = [(r["range"], top[(i + 1) % len(top)]["m"]["doc_id"], -top[(i + 1) % len(top)]["m"]["col2"]) for i, r in enumerate(top)]
    guests = spark.createDataFrame(heads, f"to int, g_id {kind}, g_tie long")
    guests = own.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tie") == F.col("g_tie")))
    every = own.unionByName(guests.select("doc_id", "text", F.col("to").alias("range"), "tie", F.lit(1).alias("guest")))
    # Documents that a smaller id stands for are told so by a row before them, so the texts do not move again.
    notes = alike(docs).where("not kept").select("doc_id", "tie", F.col("component_id").alias("alike_id")).dropDuplicates(["doc_id", "tie"])
    notes = rows.written(notes, "alike")
    notes = notes.select("doc_id", F.lit(None).cast("string").alias("text"), _range_of(F.col("doc_id"), cuts).alias("range"), "tie",
                         F.lit(0).alias("guest"), "alike_id")
    every = every.withColumn("alike_id", F.lit(None).cast(kind)).unionByName(notes)
    lined = every.repartition(ranges, "range").sortWithinPartitions("range", "guest", *order, F.col("alike_id").asc_nulls_last())
    lined = lined.select("range", "guest", "doc_id", "tie", "alike_id", "text")
    return lined.mapInArrow(
        _compare, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                  f"near_edited double, near_next double, n_signatures long, alike_id {kind}")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come range by range in order; each is held until the text after it is known."""
    held: list[tuple] = []  # (range, doc_id, text, alike_id), of which the last waits for its next
    size, schema, note = 0, None, (None, None, None)
    for batch in batches:
        schema = batch.schema.field("doc_id").type
        for part in words.slices(batch):
            columns = (part.column(c).to_pylist() for c in ("range", "guest", "doc_id", "tie", "alike_id", "text"))
            for at, guest, doc_id, tie, alike_id, text in zip(*columns):
                if text is None:
                    note = (doc_id, tie, alike_id)
                    continue
                if guest:
                    if held and held[-1][0] == at:
                        yield _finished(held, text, schema)
                        held, size = [], 0
                    continue
                if size > words.SLICE_BYTES:
                    yield _finished(held, text, schema)
                    held, size = [], 0
                held.append((at, doc_id, text, note[2] if note[:2] == (doc_id, tie) else doc_id))
                size += len(text)


def _finished(held: list[tuple], after: str, kind: pa.DataType) -> pa.RecordBatch:
    texts = [t for _, _, t, _ in held] + [after]
    changed = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:])]
    own, other = signatures(pa.array(texts, pa.large_string())), signatures(pa.array(changed, pa.large_string()))
    columns = [
        pa.array([i for _, i, _, _ in held], kind), pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array([text_of(s) for s in own[:-1]]),
        pa.array([text_of(s) for s in other]), pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()), pa.array([len(s) for s in own[:-1]], pa.int64()),
        pa.array([a for _, _, _, a in held], kind)]
    return pa.RecordBatch.from_arrays(columns, [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures", "alike_id"])
