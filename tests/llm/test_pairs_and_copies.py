"""Chunk recipes, hard negatives and spelling variants against plain Python, and their defined cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollgrid.llm import chunk_recipes, hard_negatives, spelling

SCHEMA = "doc_id bigint, text string, lang string, n bigint, word string, hash bigint, ranks int, chunk string"
EXTRA = ("en", 1, "w", 2, 3, "c")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents():
    rng = np.random.default_rng(3)
    long = " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(3000))
    changed = long[:9000] + "#" + long[9000:]
    return [(1, None), (2, ""), (3, "Straße ÀB"), (4, "straße Àb"), (5, "straße àb"), (6, long), (7, long.upper().replace("É", "é")), (8, changed),
            (9, "x" * 50_000), (10, "X" * 50_000), (11, "x" * 50_001), (11, "x"), (12, "x"), (12, "x"), (None, "x"), (None, "alone"),
            (None, "alone"), (13, "aXbXc 🙂" * 900), (14, "axbxc 🙂" * 900), (15, " \n\t")]


@pytest.mark.parametrize("bits", [64, 3])
def test_equal_texts(spark, bits):
    rows = documents()
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    members = defaultdict(list)
    for i, t in rows:
        members[lowered(t)].append(i)
    want = []
    for i, t in rows:
        group = members[lowered(t)]
        keep = max((g for g in group if g is not None), default=None)
        want.append((i, keep, len(group), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    got = [tuple(r) for r in chunk_recipes.equal_texts(docs, bits).drop("n_chunks").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)  # with 3 bits nearly all chunks share a hash
    assert chunk_recipes.equal_texts(docs.where("false")).collect() == []


def test_recipes_rebuild_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(documents())], "doc_id bigint, text string")
    for bits in (64, 3):
        contents = {(r["hash"], r["rank"]): r["chunk"] for r in chunk_recipes.store(docs, bits).collect()}
        assert len(set(contents.values())) == len(contents)
        for r in chunk_recipes.recipes(docs, bits).collect():
            text = "".join(contents[h, k] for h, k in zip(r.hashes, r.ranks or [0] * len(r.hashes)))
            assert text == lowered(documents()[r.doc_id][1])
    longest = max(len(c) for c in contents.values())
    assert longest <= 4096
    recipe = {r.doc_id: r.hashes for r in chunk_recipes.recipes(docs).collect()}
    assert len(set(recipe[5]) & set(recipe[7])) > 0.8 * len(recipe[5])  # one character more: the other chunks stay


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 40), st.integers(0, 62), st.integers(0, 2**32))
def test_strassen_is_the_product_modulo_2_to_64(m, k, n, bits, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(1 << bits), 1 << bits, (m, k)), rng.integers(-(1 << bits), 1 << bits, (k, n))
    with np.errstate(over="ignore"):
        assert (hard_negatives.multiply(a, b, leaf=2) == a @ b).all()


def test_window_is_exact():
    p = np.array([-7, 0, 1, 5, 9, 10, 33, 10**18, 2**62])
    low, high = hard_negatives.window(p)
    for x, a, b in zip(p.tolist(), low.tolist(), high.tolist()):
        assert 10 * a >= 3 * x > 10 * (a - 1) and 10 * b <= 9 * x < 10 * (b + 1)


def mined(rows, every=100):
    vectors = []
    for i, label, x in rows:
        if label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        vectors.append((i, label, tuple(int(np.floor(256 * np.float64(np.float32(c)))) for c in x)))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, label, x in {v for v in vectors if v[0] is not None and v[0] % every == 0}:
        scored = [(dot(x, y), j, l) for j, l, y in vectors]
        for score, j, _ in sorted((s for s in scored if s[2] == label and s[1] != i), key=order)[:5]:
            fits = sorted((s for s in scored if s[2] != label and 3 * score <= 10 * s[0] <= 9 * score), key=order)[:10]
            out += [(i, j, k + 1, s[1], score, s[0]) for k, s in enumerate(fits)]
    return sorted(out, key=repr)


VECTORS = "vec_id bigint, label int, embedding array<float>, place int, score double"


def test_hard_negatives(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.integers(-2, 9, 7) / 8]) for i in range(0, 900, 3)]
    rows += rows[10:40]  # repeated rows and ties
    rows += [(None, 1, rows[0][2]), (4000, None, [1.0]), (4100, 1, None), (4200, 1, [1.0, None]), (4300, 1, [float("nan")] * 7), (4400, 0, []),
             (4500, 2, [1.0, 0.5]), (4600, 1, [float("inf")] * 7), (600, 2, [0.5] * 7), (5000, 77, [1.0] * 7)]
    table = spark.createDataFrame([(*r, 1, 2.0) for r in rows], VECTORS)
    want = mined(rows)
    assert len(want) > 100
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for block_bytes, tile in ((1 << 25, 2048), (200, 7)):
        monkeypatch.setattr(hard_negatives, "CANDIDATES", tile)
        got = hard_negatives.mine(table.repartition(3), block_bytes=block_bytes).select(names).collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert hard_negatives.mine(table.where("false")).collect() == []


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(1)
    group, score, ids = rng.integers(0, 5, 300), rng.integers(0, 9, 300), rng.permutation(300)
    want = {g: sorted(((-s, i) for h, s, i in zip(group, score, ids) if h == g))[:4] for g in range(5)}
    for seed in range(3):
        heaps = hard_negatives.Heaps(5, 4)
        for part in np.array_split(np.random.default_rng(seed).permutation(300), 7):
            heaps.add(group[part], score[part], ids[part])
        assert {g: list(zip((-heaps.scores[g]).tolist(), heaps.ids[g].tolist())) for g in range(5)} == want


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_spelling(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        stems = ["abcdefgh", "stÀtiönß", "zzzzzzzz", "commonword", "mississippi"]
        text = []
        for _ in range(120):
            w = list(stems[min(int(rng.geometric(0.5)) - 1, 4)])
            for _ in range(int(rng.choice([0, 1, 2], p=[0.9, 0.07, 0.03]))):
                at, how = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
                w[at : at + (how > 0)] = [] if how == 2 else [str(rng.choice(list("abzÉé")))]
            text.append("".join(w).title() if rng.random() < 0.2 else "".join(w))
        rows.append((i % 50, " ".join(text)))  # ids repeat
    rows += [(None, "nullable nullable"), (70, None), (71, ""), (72, "x" * 30_000 + " " + "x" * 30_000), (73, "1234567 !!")]
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    want = spelled(rows)
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] is not None and w[1] != w[2] for w in want)
    names = ["word", "form", "root", "n", "n_near", "form_n"]
    words = spelling.vocabulary(docs)
    for hot in (spelling.HOT, (1, 1), (3, 10**9)):  # plain signatures, and all of them split by ends and halves
        assert sorted(map(tuple, spelling.forms(words, hot).select(names).collect()), key=repr) == want
    assert spelling.variants(docs.where("false")).collect() == []


def test_signatures_meet_at_two_differences(spark):
    """Every pair of words that differ by one edit shares a signature, whatever the parts."""
    words = ["abcdefg", "abcdefgh", "abcdxfg", "bcdefgg", "aabcdef", "abcdefgabcdefg", "abcdefgabcdef"]
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    for parts in (["ab", "cd", "ef", "ghx"], ["", "", "", "abcdefghx"], spelling.parts_of(table)):
        keyed = spelling._signatures(table, parts)
        met = {(r.word, r.other) for r in keyed.join(keyed.select("key", F.col("word").alias("other")), "key").collect()}
        assert all((a, b) in met for a in words for b in words if one_edit(a, b))
