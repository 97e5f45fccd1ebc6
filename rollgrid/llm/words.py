"""Words of many texts at once: byte offsets and 64-bit hashes, computed on Arrow buffers with numpy.

A text that is null has no words. All functions work on whole texts; ``slices`` bounds what is held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(is_word) -> np.ndarray:
    """Which of the 256 byte values belong to a word; bytes of non-ASCII characters are above 127."""
    return np.array([bool(is_word(b)) for b in range(256)])


#: Everything but the ASCII white space.
UNSPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ASCII letters, digits and everything outside ASCII.
ALPHANUMERIC = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts hold at most ``SLICE_BYTES``, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and held + size > SLICE_BYTES:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more entry for the end)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0] if len(texts) else np.zeros(1, np.int64))


class Words:
    """The words of some texts: ``starts``, ``ends`` (bytes), ``first`` (index of each text's first word, and the end)."""

    def __init__(self, texts: pa.Array, word_bytes: np.ndarray, lower: bool = True):
        data, self.offsets = raw(texts)
        self.data = LOWER[data] if lower else data
        inside = word_bytes[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begins[cuts] = inside[cuts]
        stops[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self._powers = self._sums = None

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``longest`` bytes."""
        if self._sums is None:
            n = len(self.data)
            powers = np.full(n + 1, _MULTIPLIER, np.uint64)
            powers[:1] = 1
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(powers)[:n], out=self._sums[1:])
            powers[1:] = _INVERSE
            self._powers = np.multiply.accumulate(powers)
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        return mix((self._sums[ends] - self._sums[self.starts]) * self._powers[self.starts])


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``width`` words and each text's first window; a shorter text is one window of all its words."""
    counts = np.diff(first)
    windows = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(windows)])
    text = np.repeat(np.arange(len(counts)), windows)
    at = first[:-1][text] + np.arange(bounds[-1]) - bounds[text]
    length = np.minimum(counts, width)[text].astype(np.uint64)
    out = mix(length)
    for k in range(width):
        there = length > k
        out[there] = mix(out[there] * np.uint64(0x2545F4914F6CDD1D) + hashes[at[there] + k])
    return out, bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of each text in rising order, and where each text's begin."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(bounds) - 1))])
