"""License notices in texts by an exact set-similarity join with templates.

A text is cut into half-overlapping blocks of ``BLOCK`` words, so a notice of half that length lies whole in one. A block
matches a template if it holds at least ``CONTAINED`` of the template's different words. Words are ordered by how many
documents of the corpus hold them, the rarest first. A template that needs o of its words can only match a block that
holds one of its first n - o + 1 words (prefix), that holds o template words at all (length), and in which enough words
follow that one on either side (position); what is left is verified on the full sets. No match is missed.

Templates are a parameter of bounded size and are broadcast with the index; counting their words takes one row per
word and task. Phrases are found besides, word by word, and always count.

A matching template has places: the shortest runs of words that hold enough of it, each from one of its words on, about as
long as itself at most, since its words may stand anywhere in a block by chance. Every matching template gives its label,
but for three rules. The words that tell a version
or variant apart (``DECIDING``) must stand in a place. A match yields to the better matches of another label (of higher
containment, or of more words) if these templates hold all its words and each of its places meets one of theirs. Labels that
say less (``gnu``, ``gpl``, ``lgpl``) yield to one that says more (``SAYS_MORE``) in the same block or one that overlaps it.

Whole notices are cut into templates of at most ``PIECE`` words that cover all of each notice; a longer template is
refused.

Defined cases: a null text is empty and has score 0; repeated rows stay; an empty table gives no rows; other columns of
the table are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollgrid.llm import words

BLOCK, CONTAINED = 64, 0.85
#: Longest template: that many words always lie whole in one block.
PIECE = BLOCK // 2 + 1
#: A place is at most so many words longer than its template, or this part of it.
SLACK, SLACK_PART = 2, 8

# Phrases with their labels, and public license notices.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation; either version {version} of the License"
_MORE = "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
#: Whole notices; paragraphs that begin a piece of their own are apart.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", _BSD),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((label, _GNU.format(kind=kind, version=version)) for label, kind, version in (
        ("gpl-2", _GPL, "2"), ("gpl-3", _GPL, "3"), ("lgpl-2.1", _LGPL, "2.1"), ("lgpl-3", _LGPL, "3"), ("agpl-3", _AGPL, "3"))),
    ("gnu", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU"),
    ("gnu", "published by the Free Software Foundation; either version of the License, or (at your option) any later version."),
    ("gnu", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl", _MORE.format(kind=_GPL)), ("lgpl", _MORE.format(kind=_LGPL)), ("agpl-3", _MORE.format(kind=_AGPL)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0", "This work is licensed under the CC0 1.0 Universal Public Domain Dedication."),
    ("epl-1", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution."),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at eclipse.org/legal/epl-2.0"),
    ("mpl-2", "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0/"),
)
#: Words without which a block does not have the label.
DECIDING = {"gpl-2": "2", "gpl-3": "3", "lgpl-2.1": "lesser 2 1", "lgpl-3": "lesser 3", "lgpl": "lesser", "agpl-3": "affero",
            "epl-1": "v1", "epl-2": "2", "cc-by-nc": "nc", "cc-by-sa": "sa"}
#: Labels that yield, and the labels that say more.
SAYS_MORE = {"gnu": ("gpl", "gpl-2", "gpl-3", "lgpl", "lgpl-2.1", "lgpl-3", "agpl-3"), "gpl": ("gpl-2", "gpl-3"), "lgpl": ("lgpl-2.1", "lgpl-3")}


def cut(text: str) -> list[str]:
    """Pieces of at most ``PIECE`` words, of about one length, that cover the whole text."""
    w = re.findall(r"[A-Za-z0-9]+", text)
    n = -(-len(w) // PIECE)
    return [" ".join(w[k * len(w) // n : (k + 1) * len(w) // n]) for k in range(n)]


TEMPLATES += tuple((label, piece) for label, text in NOTICES for piece in cut(text))


def hashes_of(text: str) -> np.ndarray:
    return words.Words(pa.array([text]), words.ALPHANUMERIC).hashes()


class Index(NamedTuple):
    """Template words by rank, and for each word the templates that have it in their prefix."""

    known: np.ndarray  # hashes in rising order
    rank: np.ndarray  # of each known hash, 0 the rarest
    sets: list[np.ndarray]  # ranks of each template's words, rising
    needed: list[int]
    prefixes: dict[int, list[tuple[int, int]]]  # rank: (template, position)
    deciding: list[np.ndarray]  # ranks without which a block does not match
    lengths: list[int]  # words of each template, repeated ones too


def vocabulary(templates) -> np.ndarray:
    deciding = [hashes_of(DECIDING[label]) for label, _ in templates if label in DECIDING]
    return np.unique(np.concatenate([hashes_of(text) for _, text in templates] + deciding))


def index(templates, documents: dict[int, int], contained: float = CONTAINED) -> Index:
    """``documents``: how many documents hold each word, by its hash."""
    long = [text for _, text in templates if len(hashes_of(text)) > PIECE]
    if long:
        raise ValueError(f"a template has more than {PIECE} words and would not lie whole in a block: {long[0]}")
    known = vocabulary(templates)
    counts = np.array([documents.get(int(h), 0) for h in known])
    rank = np.empty(len(known), np.int64)
    rank[np.lexsort((known, counts))] = np.arange(len(known))
    sets = [np.sort(rank[np.searchsorted(known, np.unique(hashes_of(text)))]) for _, text in templates]
    needed = [max(1, int(np.ceil(contained * len(s) - 1e-9))) for s in sets]
    prefixes: dict[int, list[tuple[int, int]]] = {}
    for t, (s, o) in enumerate(zip(sets, needed)):
        for i, r in enumerate(s[: len(s) - o + 1].tolist()):
            prefixes.setdefault(r, []).append((t, i))
    deciding = [rank[np.searchsorted(known, hashes_of(DECIDING.get(label, "")))] for label, _ in templates]
    return Index(known, rank, sets, needed, prefixes, deciding, [len(hashes_of(text)) for _, text in templates])


def _placed(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words that a template has, and which."""
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    here = np.flatnonzero(known[at] == hashes)
    return here, at[here]


class Match(NamedTuple):
    """A template in a block, its containment, and its places as word positions (first, last)."""

    template: int
    share: float
    places: list[tuple[int, int]]
    words: np.ndarray  # ranks of its words that the block holds


def matches(found: Index, hashes: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], list[Match]]:
    """The templates that match each block, by (text, block)."""
    at, which = _placed(found.known, hashes)
    text = np.searchsorted(first, at, "right") - 1
    block = (at - first[text]) // (BLOCK // 2)
    ranks = found.rank[which]
    # Each word lies in two blocks: the one that begins in its half, and the one before.
    keys = np.concatenate([np.stack([text, block, at, ranks], 1), np.stack([text, block - 1, at, ranks], 1)[block > 0]])
    keys = keys[np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))]
    rare = np.isin(keys[:, 3], np.array(sorted(found.prefixes), np.int64))
    out: dict[tuple[int, int], list[Match]] = {}
    bounds = np.flatnonzero(np.any(keys[1:, :2] != keys[:-1, :2], 1)) + 1 if len(keys) else np.zeros(0, int)
    starts, ends = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(keys)]])
    for b in np.unique(np.searchsorted(starts, np.flatnonzero(rare), "right") - 1).tolist():
        rows = keys[starts[b] : ends[b]]
        held = np.unique(rows[:, 3])
        tried = set()
        for j, r in enumerate(held.tolist()):
            for t, i in found.prefixes.get(r, ()):
                needed = found.needed[t]
                if t in tried or len(held) < needed or 1 + min(len(found.sets[t]) - i, len(held) - j) - 1 < needed:
                    continue
                tried.add(t)
                shared = np.intersect1d(found.sets[t], held, assume_unique=True)
                if len(shared) >= needed and (places := _places(found, t, rows[:, 2].tolist(), rows[:, 3].tolist())):
                    out.setdefault((int(rows[0, 0]), int(rows[0, 1])), []).append(Match(t, len(shared) / len(found.sets[t]), places, shared))
    return out


def _places(found: Index, t: int, at: list[int], ranks: list[int]) -> list[tuple[int, int]]:
    """From each word of the template the shortest run that holds enough of it, and the deciding words."""
    mine, deciding = set(found.sets[t].tolist()), set(found.deciding[t].tolist())
    of = [(p, r) for p, r in zip(at, ranks) if r in mine or r in deciding]
    longest = found.lengths[t] + max(SLACK, found.lengths[t] // SLACK_PART)
    out = []
    for k, (begin, _) in enumerate(of):
        seen, missing = set(), set(deciding)
        for p, r in of[k:]:
            if p - begin >= longest:
                break
            missing.discard(r)
            if r in mine:
                seen.add(r)
            if len(seen) >= found.needed[t] and not missing:
                out.append((begin, p))
                break
    return out


def _yields(found: Index, one: Match, others: list[Match]) -> bool:
    """Whether all that ``one`` says, and everywhere it does, better matches of another label say."""
    rank = lambda m: (m.share, len(found.sets[m.template]))
    better = [m for m in others if rank(m) > rank(one)]
    if not better or not np.isin(one.words, np.concatenate([found.sets[m.template] for m in better])).all():
        return False
    return all(any(a <= d and c <= b for m in better for c, d in m.places) for a, b in one.places)


def labels_of(found: Index, templates, hits: list[Match]) -> set[str]:
    """The labels of a block from all its matches."""
    by_label: dict[str, list[Match]] = {}
    for m in hits:
        by_label.setdefault(templates[m.template][0], []).append(m)
    return {label for label, mine in by_label.items() if not all(
        any(_yields(found, m, others) for other, others in by_label.items() if other != label) for m in mine)}


def _told(blocks: dict[tuple[int, int], set[str]]) -> dict[int, set[str]]:
    """Labels per text; one that says less goes beside one that says more."""
    out: dict[int, set[str]] = {}
    for (d, b), labels in blocks.items():
        around = labels | blocks.get((d, b - 1), set()) | blocks.get((d, b + 1), set())
        out.setdefault(d, set()).update(label for label in labels if not around & set(SAYS_MORE.get(label, ())))
    return out


def phrase_places(hashes: np.ndarray, first: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Positions at which the words of a phrase stand one after another in one text."""
    n = len(phrase)
    at = np.flatnonzero(hashes[: len(hashes) - n + 1] == phrase[0]) if len(hashes) >= n else np.zeros(0, int)
    for k in range(1, n):
        at = at[hashes[at + k] == phrase[k]]
    end = first[1:][np.searchsorted(first, at, "right") - 1] if len(at) else at
    return at[at + n <= end]


def document_counts(docs: DataFrame, templates) -> dict[int, int]:
    """Documents of the whole corpus that hold each template word."""
    known = vocabulary(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for part in words.slices(batch):
                found = words.Words(part.column("text"), words.ALPHANUMERIC)
                at, which = _placed(known, found.hashes())
                pairs = np.unique((np.searchsorted(found.first, at, "right") - 1) * len(known) + which)
                total += np.bincount(pairs % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(total)], ["word", "documents"])

    sums = docs.select("text").mapInArrow(count, "word long, documents long").groupBy("word").agg(F.sum("documents").alias("n"))
    return {r["word"] & (2**64 - 1): r["n"] for r in sums.collect()}  # one row per template word


def scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per document: phrase places, labels, and the best containment of a match (1 with a phrase)."""
    shared = docs.sparkSession.sparkContext.broadcast(index(templates, document_counts(docs, templates)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sought = [(hashes_of(p), label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                found = words.Words(part.column("text"), words.ALPHANUMERIC)
                hashes, first, n = found.hashes(), found.first, part.num_rows
                base, labels, score = np.zeros(n, np.int64), [set() for _ in range(n)], np.zeros(n)
                low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                for phrase, label in sought:
                    at = phrase_places(hashes, first, phrase)
                    text = np.searchsorted(first, at, "right") - 1
                    np.add.at(base, text, 1)
                    np.minimum.at(low, text, at - first[text])
                    np.maximum.at(high, text, at - first[text])
                    for d in np.unique(text).tolist():
                        labels[d].add(label)
                base_labels = [",".join(sorted(s)) for s in labels]
                found_blocks = matches(shared.value, hashes, first)
                for (d, _), hits in found_blocks.items():
                    score[d] = max(score[d], *(m.share for m in hits))
                for d, told in _told({at: labels_of(shared.value, templates, hits) for at, hits in found_blocks.items()}).items():
                    labels[d] |= told
                none = base == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found.counts(), pa.int64()), pa.array(base), pa.array(low, mask=none),
                     pa.array(high, mask=none), pa.array(base_labels), pa.array([",".join(sorted(s)) for s in labels]),
                     pa.array(np.where(none, score, 1.0))],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
