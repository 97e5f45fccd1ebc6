"""Packing of tokenised documents into sequences of several context sizes.

Whole windows of a long document are sequences of the largest tier. What remains of it, and every shorter document, is
routed to the smallest tier (a power of two) that holds it. Tiers are packed from the longest down: a document opens a
window, the gap is filled with the longest pieces of shorter tiers that fit, and at last with a piece cut from a longer
one. Only the last window of a cell can stay open; it is split into full windows of smaller tiers, and what is left is
the one padded sequence of the cell.

Documents meet in cells of about ``CELL_BYTES`` of text in the order in which the table stores them, so a cell is bounded
at any size of corpus, a mixed order survives, repeated rows spread like others, and nothing is shuffled: a task packs the
cells of its part of the scan. Sequences are numbered tier by tier with counts per cell, and dealt round robin to steps, so
that steps hold equally many sequences of every tier. The pieces are written before they are counted, so a task that runs
again changes nothing afterwards.

Defined cases: a null text is empty, and a document has at least its closing id; repeated rows are packed each on its
own; an empty table gives no rows; other columns of the table are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollgrid.llm import rows

CELL_BYTES = 8 << 20
#: Tokens of a cell at most, and one more than the cells that a part of the scan can have.
HELD_TOKENS, CELLS = 16 << 20, 1 << 24
#: Parts of texts that a worker remembers in each of two generations, and the longest of them.
CACHE, LONGEST = 120_000, 64


def _characters(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c)).startswith(kind) and c != 0x130)


# How the tokenizer's file splits a text, for characters up to U+024F.
_L, _N = _characters("L"), _characters("N")
_SPACES = "\t-\r \x85\xa0"
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_SPACES}{_L}{_N}]+")
#: Texts with other characters, or with what may be a special token, go to the library whole.
UNUSUAL = re.compile(r"[^\t-\r\x20-\x7e\x85\xa0-įı-ɏ]|<\|")


def _ids(library, text: str) -> bytes:
    return np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()


class Encoder(dict):
    """Little-endian ids of each part of a text, encoded by the library when first met.

    New parts of a text are encoded in one call, with spaces between them; a token that ends a word ends a part.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.old: dict[str, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of the library would only wait
        self.library = Tokenizer.from_file(tokenizer)
        # Parts are normalised and split already; for them the same model needs no more than the spaces between them.
        self.for_parts = Tokenizer(self.library.model)
        self.for_parts.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")

    def whole(self, text: str) -> bytes:
        return _ids(self.library, text)

    def learn(self, parts: list[str], ids: list[bytes | None]) -> None:
        """Fill in the ids of parts that have none yet. A full generation grows old; a part met again is young again."""
        missing = [k for k, known in enumerate(ids) if known is None]
        found = dict.fromkeys(parts[k] for k in missing)
        for part in found:
            found[part] = self.old.get(part)
        new = [part for part, known in found.items() if known is None]
        if new:
            raw = _ids(self.for_parts, " ".join(new))
            cuts = (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1).tolist()
            if len(cuts) == len(new):
                found.update(zip(new, (raw[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts))))
            else:
                found.update((part, self.whole(part)) for part in new)
        for k in missing:
            ids[k] = found[parts[k]]
        self.update((part, known) for part, known in found.items() if len(part) <= LONGEST)
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()

    def of(self, text: str) -> bytes:
        """Ids of a whole text."""
        if UNUSUAL.search(text):
            return self.whole(text)
        parts = PARTS.findall(text.lower())
        ids = list(map(self.get, parts))
        if None in ids:
            self.learn(parts, ids)
        return b"".join(ids)


@cache
def encoder_of(tokenizer: str) -> Encoder:
    """The worker's encoder; what it has met stays known to the tasks that follow in the same worker."""
    return Encoder(tokenizer)


def tiers(largest: int, smallest: int) -> list[int]:
    return [1 << k for k in range(smallest.bit_length() - 1, largest.bit_length())]


def pack(lengths: list[int], sizes: list[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (size, pieces); a piece is (index in ``lengths``, start, length). No length exceeds ``sizes[-1]``."""
    pool = sorted((n, i, 0) for i, n in enumerate(lengths))
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    while pool:
        n, i, start = pool.pop()
        size = next(s for s in sizes if s >= n)
        pieces, gap = [(i, start, n)], size - n
        while gap and pool:
            k = bisect_right(pool, (gap + 1,)) - 1
            if k >= 0:
                n, i, start = pool.pop(k)
                pieces.append((i, start, n))
                gap -= n
            else:
                n, i, start = pool.pop()
                pieces.append((i, start, gap))
                insort(pool, (n - gap, i, start + gap))
                gap = 0
        if gap:
            out += _split(pieces, size - gap, sizes)
        else:
            out.append((size, pieces))
    return out


def _split(pieces: list[tuple[int, int, int]], total: int, sizes: list[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """The pieces as full windows from the largest down; a rest below the smallest is a sequence padded to the largest."""
    parts = []
    for size in reversed(sizes):
        while total >= size:
            parts.append(size)
            total -= size
    parts += [total] * bool(total)
    out, left = [], list(reversed(pieces))
    for part in parts:
        took, want = [], part
        while want:
            i, start, n = left.pop()
            took.append((i, start, min(n, want)))
            if n > want:
                left.append((i, start + want, n - want))
            want -= took[-1][2]
        out.append((part if part in sizes else sizes[-1], took))
    return out


PIECE = "doc_tokens long, start long, length long, ids_crc32 long"


def pack_documents(docs: DataFrame, tokenizer: str, closing_id: int, largest: int = 4096, smallest: int = 64,
                   step_sequences: int = 256) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, the sequence's tier and training step."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sizes = tiers(largest, smallest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end = np.array([closing_id], "<u4").tobytes()
        held, size, tokens, cell, done, schema = [], 0, 0, 0, {}, pa.int64()
        for batch in batches:
            schema = batch.schema.field("doc_id").type
            for part, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text"))):
                ids = np.frombuffer(encoder.of(text or "") + end, "<u4")
                for at in range(0, len(ids), largest):
                    held.append((part * CELLS + cell, doc_id, len(ids), at, ids[at : at + largest]))
                size, tokens = size + len(text or ""), tokens + len(ids)
                if size >= CELL_BYTES or tokens >= HELD_TOKENS:
                    yield _sequences(held, sizes, done, schema)
                    held, size, tokens, cell, done = [], 0, 0, cell + 1, {}
        if held:
            yield _sequences(held, sizes, done, schema)

    packed = docs.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text").mapInArrow(
        run, f"cell long, doc_id {kind}, {PIECE}, tier int, tier_rank long, `offset` long")
    return _numbered(rows.written(packed, "packed"), step_sequences)


def _sequences(held: list[tuple], sizes: list[int], done: dict[int, int], kind: pa.DataType) -> pa.RecordBatch:
    """The pieces (cell, id, tokens of the document, start, ids) of one cell; ``done`` counts its sequences by tier."""
    largest = sizes[-1]
    out: list[tuple] = []

    def place(tier: int, pieces: list[tuple]) -> None:
        rank, offset = done.get(tier, 0), 0
        done[tier] = rank + 1
        for (cell, doc_id, total, start, ids), skip, length in pieces:
            out.append((cell, doc_id, total, start + skip, length, zlib.crc32(ids[skip : skip + length]), tier, rank, offset))
            offset += length

    for piece in held:
        if len(piece[-1]) == largest:
            place(largest, [(piece, 0, largest)])
    rest = [piece for piece in held if len(piece[-1]) < largest]
    for tier, pieces in pack([len(piece[-1]) for piece in rest], sizes):
        place(tier, [(rest[i], skip, n) for i, skip, n in pieces])
    kinds = [pa.int64(), kind] + [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int64()]
    names = ["cell", "doc_id", "doc_tokens", "start", "length", "ids_crc32", "tier", "tier_rank", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _numbered(packed: DataFrame, step_sequences: int) -> DataFrame:
    """Sequence numbers without gaps over the whole corpus, tier by tier, and steps with equal numbers of each tier."""
    counts = packed.groupBy("tier", "cell").agg((F.max("tier_rank") + 1).alias("n"))
    counts = counts.withColumn("group", F.floor(F.col("cell") / CELLS).cast("long"))  # a part of the scan
    groups = counts.groupBy("tier", "group").agg(F.sum("n").alias("group_n"))
    of_tier = groups.groupBy("tier").agg(F.sum("group_n").alias("tier_n"))
    base = of_tier.select("tier", F.coalesce(F.sum("tier_n").over(
        rows.Window.orderBy(F.col("tier").desc()).rowsBetween(rows.Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.sum("tier_n").over(rows.Window.partitionBy(F.lit(0))).alias("all_n"))
    groups = groups.select("tier", "group", rows.running_before(["tier"], ["group"], "group_n").alias("group_before"))
    starts = counts.select("tier", "cell", "group", rows.running_before(["tier", "group"], ["cell"], "n").alias("before"))
    starts = starts.join(groups, ["tier", "group"]).join(base, "tier").select(
        "tier", "cell", (F.col("before") + F.col("group_before")).alias("before"), "base", "all_n")
    steps = F.ceil(F.col("all_n") / step_sequences)
    rank = F.col("before") + F.col("tier_rank")
    return packed.join(starts, ["tier", "cell"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + rank).alias("sequence_id"), "offset", "tier",
        F.pmod(rank, steps).cast("long").alias("step"))
