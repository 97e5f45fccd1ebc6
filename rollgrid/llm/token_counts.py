"""Token counts by a lookup in two tiers, on the map side only.

A text falls into pre-tokens across which no piece of the vocabulary reaches, so its count is the sum of theirs. The
lengths of frequent pre-tokens are found once, from a bounded sample of documents, and broadcast as a compact table; what
a task meets besides is encoded by the library and kept in a bounded cache of its worker. Pre-tokens are never shuffled,
and the sample decides speed only: any text gets the library's count.

Defined cases: a null text is empty and has 0 bytes and tokens; repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollgrid.llm import words

#: Documents in the sample, tasks that count it, and entries of the table.
SAMPLE, SAMPLE_TASKS, TABLE = 2000, 4, 16384
#: Longest pre-token that is remembered, and entries of a worker's cache.
LONGEST, CACHE = 64, 400_000

SPACE = "▁"
#: Spaces with the word behind them; a line end stands alone.
PIECES = re.compile(f"[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+|\n")


def pre_tokens(text: str) -> Iterator[str]:
    """The parts of a text. The library puts a space before the text, so this does too."""
    return (m[0] for m in PIECES.finditer(" " + text)) if text else iter(())


class Counts(dict):
    """Tokens per pre-token: the frequent ones given, others encoded when first met."""

    def __init__(self, model: str):
        import sentencepiece

        super().__init__()
        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model)
        self.frequent: dict[str, int] = {}
        self.split = all(
            "\n" not in p and SPACE not in p.lstrip(SPACE) for p in map(self.encoder.id_to_piece, range(self.encoder.get_piece_size())))

    def primed(self, table: tuple[str, bytes]) -> Counts:
        """The same counts with the table of frequent pre-tokens."""
        if table[1] and not self.frequent:
            self.frequent = dict(zip(table[0].split("\0"), table[1]))
            self.update(self.frequent)
        return self

    def __missing__(self, part: str) -> int:
        # A line end before the part keeps the library from giving it a space of its own; both count one.
        n = len(self.encoder.encode("\n" + part)) - 2
        if len(part) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
                self.update(self.frequent)
            self[part] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.split:
            return len(self.encoder.encode(text))
        if len(text) < 1 << 20:
            return sum(map(self.__getitem__, PIECES.findall(" " + text)))
        return sum(map(self.__getitem__, pre_tokens(text)))


@cache
def counts_of(model: str) -> Counts:
    """The worker's counts; what it has met stays known to the tasks that follow in the same worker."""
    return Counts(model)


def frequent(docs: DataFrame, model: str) -> tuple[str, bytes]:
    """The most frequent pre-tokens of a sample and their tokens: at most ``TABLE`` entries of ``LONGEST`` characters."""
    chosen = docs.select("text").where(F.col("text").isNotNull())
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    cut = int(share * 2**62) * 2 - 2**62 if share < 1 else 2**62
    chosen = chosen.where(F.shiftright(F.xxhash64("text"), 1) <= cut).repartition(SAMPLE_TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                seen.update(p for p in pre_tokens(text.as_py()) if len(p) <= LONGEST and "\0" not in p)
            if len(seen) > 16 * TABLE:
                seen = Counter(dict(seen.most_common(4 * TABLE)))
        top = seen.most_common(TABLE)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["part", "n"])

    total: Counter[str] = Counter()
    for row in chosen.mapInArrow(count, "part string, n long").collect():  # SAMPLE_TASKS * TABLE rows at most
        total[row["part"]] += row["n"]
    counts = Counts(model)
    kept = [(p, n) for p, _ in total.most_common(TABLE) if (n := counts[p]) < 256] if counts.split else []
    return "\0".join(p for p, _ in kept), bytes(n for _, n in kept)


def count_tokens(docs: DataFrame, model: str, limit: int) -> DataFrame:
    """``doc_id``, bytes and tokens of every text, and whether the tokens exceed ``limit``."""
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, model))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(model).primed(table.value)
        for batch in batches:
            for part in words.slices(batch):
                texts = part.column("text")
                found = pa.array([counts.of(t) for t in texts.to_pylist()], pa.int64())
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, found], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
