"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollgrid.llm import (
    fingerprints, licenses, mixing, near_duplicates, packing, quality, rows, secrets, sharding, token_counts, toxicity, words,
)
from rollgrid.llm.queries import TREE

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score double, tokens string, "
          "found string, rank int, block int, cell int, label int, kept int")
LONG = " ".join(f"w{i}" for i in range(30_000))
KEY = 'token = "abc123DEF456ghi789"'


def table(spark, docs):
    extra = (0.5, "t", "f", 1, 2, 3, 4, 5)
    return spark.createDataFrame([(*d, len(d[1]) if d[1] else None, *extra) for d in docs], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    docs = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, None), (4, "one two three", "en", "a"),
        (5, LONG, "en", "b"), (6, LONG, "de", "b"), (7, KEY, "en", "b"), (7, KEY, "en", "b"), (None, "no id", "en", "a"),
        (None, "no id", "en", "a"), (8, "one two three", "fr", "c"), (9, "é中🙂 under the MIT license. ÀÉ", "en", "c"),
        (10, "x" * 200_000, None, "c"),
    ]
    return table(spark, docs).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(1, 11)] + [(4, None, None), (99, 1, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_mixing(odd, none):
    target = mixing.Target(budget=None, entropy=0.9, repetition=3.0)
    drawn = mixing.mix(odd, target)
    assert drawn.columns == [c for c in odd.columns if c not in ("tokens", "rank", "block")] + ["tokens", "epoch", "position"]
    once = drawn.where("epoch = 0").groupBy("doc_id").count().collect()
    assert sum(r["count"] for r in once) == odd.count()  # no row is lost, repeated and null ones included
    assert mixing.mix(none, target).count() == 0


def test_sharding(odd, none):
    got = sharding.shard_documents(odd, TREE, sharding.grown(TREE)).collect()
    assert len(got) == odd.count()
    assert {r.size for r in got if r.doc_id in (1, 2)} == {1}
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert sharding.shard_documents(none, TREE, sharding.grown(TREE)).count() == 0


def test_a_changed_weight_moves_only_to_or_from_its_subtree(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"))
    heavier = tuple(leaf._replace(weight=2.0) if leaf.shard == 5 else leaf for leaf in TREE)
    moved = sharding.place(sharding.place(docs, TREE), heavier, "new_").where("shard <> new_shard").collect()
    assert moved and all(r.new_region == "g1" for r in moved)
    assert all(r.new_shard in (4, 5) or r.region != "g1" for r in moved)


def test_secrets(odd, none):
    scanned = secrets.digest(secrets.scan(odd)).collect()
    assert len(scanned) == odd.count() and [r.n_assign for r in scanned if r.doc_id == 7] == [1, 1]
    assert secrets.scan(none).count() == 0
    kept = rows.shielded(odd, secrets.masked)
    assert kept.columns == odd.columns
    text = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert text[7] == ("[secret]\"", 9) and text[1][0] is None and text[5][0] == LONG


def test_widely_copied_values_are_examples(spark):
    value = "Zx9Yw8Vu7Ts6Rq5Po4Nm3"
    docs = [(i, f"see {value} here", "en", f"s{i}") for i in range(4)] + [(9, "mine Qa1Ws2Ed3Rf4Tg5Yh6Uj7", "en", "s1")]
    docs += [(20 + i, "password=hunter2hunter2x", "en", f"s{i}") for i in range(4)]  # no credential by its looks either
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(table(spark, docs))).collect()}
    assert got[0].spans == "" and got[9].spans == "owned:5:26" and got[9].n_live == 1
    assert got[20].n_assign == 1 and got[20].n_example == 1


def test_verdicts_come_from_owners_repositories_texts_and_looks(spark):
    many, copies, wide, two = "Aa1Bb2Cc3Dd4Ee5Ff6Gg7", "Zz9Yy8Xx7Ww6Vv5Uu4Tt3", "Qq1Ww2Ee3Rr4Tt5Yy6Uu7", "Mm1Nn2Bb3Vv4Cc5Xx6Ll7"
    docs = [(i, f"run {i} with {many}", "en", "s0") for i in range(500)]  # one repository, many texts
    docs += [(1000 + i, f"mine {copies}", "en", "s0") for i in range(500)]  # copies of one text
    docs += [(2000 + i, f"x{i} {wide}", f"l{i}", "s0") for i in range(6)] + [(3000 + i, f"y {two}", "en", f"s{i}") for i in range(2)]
    docs += [(4000, "password: changemechangeme", "en", "s0"), (4001, "password: Ab3dEf6hIj9k2Lm4", "en", "s0"), (4002, f"token={many}", "en", "s0")]
    scanned = secrets.scan(table(spark, docs)).cache()
    got = {r.doc_id: r for r in secrets.digest(scanned).collect()}
    assert all(got[i].spans == "" for i in (*range(500), *range(2000, 2006), 3000, 3001))
    assert all(got[i].spans == "owned:5:26" and got[i].n_live == 1 for i in range(1000, 1500))
    assert [(got[i].n_live, got[i].n_example) for i in (4000, 4001, 4002)] == [(0, 1), (1, 0), (0, 1)]
    counts = {r.doc_id: [(f.owners, f.repos, f.texts) for f in r.found] for r in scanned.collect()}
    assert counts[1000] == [(1, 1, 1)] and counts[4002] == [(1, 1, 501)] and counts[4000] == [(1, 1, 1)]


def test_token_counts(odd, none):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in token_counts.count_tokens(odd, model, 4096).collect()}
    library = token_counts.Counts(model).encoder
    assert got[1].n_tokens == got[2].n_tokens == got[1].n_bytes == 0
    assert got[5].n_tokens == len(library.encode(LONG)) and got[5].over_limit
    assert got[9].n_tokens == len(library.encode("é中🙂 under the MIT license. ÀÉ"))
    assert token_counts.count_tokens(none, model, 4096).count() == 0


def test_packing(odd, none):
    import public_tokenizers

    name = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(odd, name, 2).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 1 and sum(r.length for r in got if r.doc_id is None) == 6
    long_ones = [r for r in got if r.doc_id == 5]
    assert sum(r.length for r in long_ones) == long_ones[0].doc_tokens > 4096
    assert sorted({r.sequence_id for r in got}) == list(range(len({r.sequence_id for r in got})))
    assert next(r for r in got if r.doc_id == 1).ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())
    assert packing.pack_documents(none, name, 2).count() == 0


def test_near_duplicates(odd, none, spark):
    got = near_duplicates.link(odd).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert len(got) == odd.count()
    assert by_id[1] == {(0, 1, True)} and by_id[3] == {(0, 3, True)}
    assert by_id[8] == {(1, 4, False)} and by_id[6] == {(29_996, 5, False)} and by_id[None] == {(1, None, True)}
    assert near_duplicates.link(none).count() == 0
    kept = rows.shielded(odd, near_duplicates.keep_one)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 9, 10]


def test_a_crowd_just_below_the_threshold_keeps_its_few_links(spark):
    random = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(600):  # pairs differ in about four words, too many for a link
        w = list(base)
        for at in random.choice(120, 3, replace=False):
            w[at] = f"x{i}_{at}"
        texts.append(w)
    texts += [[*texts[17], "tail"], [*texts[400], "tail", "two"]]
    docs = table(spark, [(i, " ".join(w), "en", "s") for i, w in enumerate(texts)])
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    smallest = list(range(len(sets)))

    def find(i):
        while smallest[i] != i:
            i = smallest[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                smallest[y] = x
    got = {r.doc_id: r.component_id for r in near_duplicates.link(docs).collect()}
    assert got == {i: find(i) for i in range(len(sets))}
    assert got[600] == got[17] and len(set(got.values())) > 300


def test_bitmaps_rule_out_no_link_and_most_strangers():
    r = np.random.default_rng(5)
    ruled_out = tried = 0
    for n in (1, 2, 9, 63, 64, 65, 200, 1000, 5000):
        for changed in (0, 0.05, 0.09, 0.11, 0.12, 0.2, 0.5, 1):
            a = np.unique(r.integers(0, 1 << 63, n, np.uint64))
            b = np.unique(np.concatenate([a[: len(a) - int(changed * n)], r.integers(0, 1 << 63, r.integers(0, int(changed * n) + 2), np.uint64)]))
            values, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            maps = near_duplicates.bitmaps(values, bounds)
            if not len(b):
                continue
            shared = len(np.intersect1d(a, b))
            sizes = np.diff(bounds)
            for percent in (80, 85, 100):
                links = 100 * shared >= percent * (len(a) + len(b) - shared)
                open_ = near_duplicates.may_link((sizes[:1], sizes[1:]), ([maps[0]], [maps[1]]), percent)[0, 0]
                assert open_ or not links
                back = near_duplicates.may_link((sizes[1:], sizes[:1]), ([maps[1]], [maps[0]]), percent)[0, 0]
                assert back == open_
                if changed >= 0.5 and n >= 63:
                    tried, ruled_out = tried + 1, ruled_out + (not open_)
    assert tried and ruled_out == tried


def test_links_of_a_tile_are_few_and_join_the_same_members():
    def groups(links, rows_, columns):
        of = list(range(rows_ + columns))
        for x, y in links:
            a, b = of[x], of[rows_ + y]
            of = [min(a, b) if g in (a, b) else g for g in of]
        return of

    r = np.random.default_rng(3)
    for share in (0, 0.01, 0.05, 0.3, 1):
        for shape in ((1, 1), (7, 40), (40, 7), (30, 30)):
            linked = r.random(shape) < share
            x, y = near_duplicates._forest(linked)
            assert linked[x, y].all() and len(x) < sum(shape)
            assert groups(zip(x, y), *shape) == groups(zip(*np.nonzero(linked)), *shape)


def test_only_tiles_that_can_hold_links_meet(spark):
    members = spark.createDataFrame(
        [(1, 10, 100, 10, 20),  # one label in the band
         (2, 20, 100, 20, 20), (2, 21, 101, 21, 20),  # two labels
         (3, 30, 100, 30, 20), (3, 31, 126, 31, 21),  # next bands, sizes too far apart
         (4, 40, 100, 40, 20), (4, 41, 125, 41, 21),  # next bands, sizes allow a link
         (5, 50, 100, 50, 20), (5, 51, 110, 50, 21)],  # next bands, one label
        "lead long, node long, n long, label long, band int")
    _, pairs = near_duplicates._tile_pairs(members, 80)
    assert sorted((r["lead"], r["band"], r["band_2"]) for r in pairs.collect()) == [(2, 20, 20), (4, 20, 21)]


def test_the_pipeline_drops_near_copies_from_80_per_cent_on(spark):
    w = [f"w{i}" for i in range(500)]
    copy = [f"new{i}" if i % 50 == 25 else x for i, x in enumerate(w)]  # 446 windows of 546
    far = [f"far{i}" if i % 40 == 20 else x for i, x in enumerate(w)]  # 436 windows of 556
    docs = table(spark, [(i, " ".join(t), "en", "s") for i, t in enumerate((w, copy, far))])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "/root/testdata/sf0.001")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_keys_meet_whenever_the_distance_allows():
    random = np.random.default_rng(3)
    values = near_duplicates.CHUNKS * near_duplicates.SYMBOLS
    most = near_duplicates.CHUNKS * (near_duplicates.ERRORS + 1) - 1
    for _ in range(200):
        a = random.integers(0, 1 << 16, (1, values)).astype(np.uint16)
        b = a.copy()
        at = random.choice(values, most, replace=False)
        b[0, at] ^= 1
        assert np.any(near_duplicates.keys(a) == near_duplicates.keys(b))


def test_quality(odd, none):
    got = {r.doc_id: r for r in quality.assess(odd).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[5].n_words == 30_000 and got[5].n_repeat_words == 0
    assert quality.assess(none).count() == 0


def prose(i, n=100):
    random = np.random.default_rng(i)
    w = ["".join(random.choice(list("abcdefghij"), random.integers(2, 9))) for _ in range(n)]
    return "\n".join(" ".join(w[k : k + 10]) for k in range(0, n, 10))


def odd_one(kind):
    w = prose(99_999).split()
    if kind == "symbols":
        w[:12] = ["#" + x for x in w[:12]]
    if kind == "dup_lines":
        return "\n".join(f"{'same' if k % 2 else w[k] + ' ' + w[k + 1]}" for k in range(0, 60))
    if kind == "repeats":
        w[50:59] = w[20:29]  # 18 words of 100
    if kind == "long_words":
        w = [x * 4 for x in w]
    if kind == "short_words":
        w = [x[0] + str(k % 10) if k % 3 else x[0] for k, x in enumerate(w)]
    return " ".join(w)


@pytest.mark.parametrize("kind", ["symbols", "dup_lines", "repeats", "long_words", "short_words"])
def test_every_measure_can_reject_alone_and_one_bad_source_does_not_raise_it(spark, kind):
    docs = [(i, prose(i), ("en", "de")[i % 2], f"s{i % 5}") for i in range(300)]
    docs += [(1000 + i, prose(1000 + i), "en", "hot") for i in range(150)]  # a third of all rows
    docs += [(2000 + i, odd_one(kind) + f" {prose(5000 + i, 3)}", "en", "hot") for i in range(50)] + [(3000, odd_one(kind), "de", "s1")]
    docs += [(4000, prose(4000), "xx", "lone"), (4001, odd_one(kind), "xx", "lone")]  # next to nothing known of their own
    got = {r.doc_id: r for r in quality.assess(table(spark, docs)).collect()}
    assert not any(r.base_failed for r in got.values())
    for i in (*range(2000, 2050), 3000, 4001):
        r, name = got[i], "long_words" if kind == "short_words" else kind
        outside = {m for m in quality.MEASURES if r[m] > r[f"max_{m}"]} | {m for m in quality.LOWER if r[m] < r[f"min_{m}"]}
        assert not r.kept and outside == {name}, (i, outside, r)
    clean = [r.kept for i, r in got.items() if i < 2000 or i == 4000]
    assert sum(clean) >= 0.99 * len(clean)


def test_repeated_windows(spark):
    docs = table(spark, [(1, "a b c d e f g a b c d e z", "en", "s"), (2, "q q q q q q", "en", "s"), (3, "a\nb\na\n \n a", "en", "s")])
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    assert got[1].n_repeat_words == 10 and got[2].n_repeat_words == 6 and got[3].n_dup_lines == 1


def test_licenses(odd, none, spark):
    got = {r.doc_id: r for r in licenses.scan(odd).collect()}
    assert got[1].n_words == 0 and got[1].first_word is None and got[1].score == 0
    assert (got[9].n_base, got[9].first_word, got[9].base_labels) == (1, 1, "mit")
    assert licenses.scan(none).count() == 0
    near = table(spark, [(1, " ".join(["pad"] * 200) + " You may not use this file except in compliance with our License."
                          " You may obtain a copy of the License at apache.org", "en", "s")])
    assert licenses.scan(near).first().labels == "apache-2"


def test_all_that_a_block_says_is_labelled(spark):
    kernel = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
              "version 2 as published by the Free Software Foundation.")
    bsd = licenses.TEMPLATES[10][1].replace("Redistribution", "Distribution")
    gnu = lambda kind, n: f"you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation; either version {n} of the License"
    texts = {
        "gpl-2": kernel, "bsd,mit": f"{bsd}. Released under the MIT License.",
        "gpl-2,lgpl-3": f"{gnu('General Public License', 2)} {gnu('Lesser General Public License', 3)}",
        "": "Researchers at MIT released a study on how the driver license rules apply under new law",
        "cc-by-nc": "Licensed under CC BY-NC 4.0.", "cc-by": "Licensed under CC BY 4.0.", "cc-by-sa": "Licensed under CC BY-SA 4.0.",
        "apache-2,cc-by": "Licensed under CC BY 4.0. " + "pad " * 20 + "Licensed under the Apache License, Version 2.0."}
    docs = [(100 * k + pad, "pad " * pad + t, "en", "s") for k, t in enumerate(texts.values()) for pad in (0, 9, 31, 40)]
    for r in licenses.scan(table(spark, docs)).collect():
        assert r.labels == list(texts)[r.doc_id // 100], r


def test_every_part_of_a_notice_is_labelled(spark):
    gnu = ("you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by "
           "the Free Software Foundation, either version {} of the License, or (at your option) any later version").format
    texts = {"mit": licenses.NOTICES[2][1], "bsd": licenses.NOTICES[6][1], "isc": licenses.NOTICES[7][1], "cc0": licenses.NOTICES[-5][1],
             "gpl-2": gnu("", 2), "gpl-3": gnu("", 3), "lgpl-2.1": gnu("Lesser", "2.1"), "lgpl-3": gnu("Lesser", 3), "agpl-3": gnu("Affero", 3)}
    docs = [(pad * 100 + k, "pad " * pad + text + " pad" * 80, "en", "s") for k, text in enumerate(texts.values()) for pad in (0, 7, 20, 31, 45)]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(table(spark, docs)).collect()}
    for i, found in got.items():
        label = list(texts)[i % 100]
        assert label in found and found <= {label, "gnu"}, (label, found)
    with pytest.raises(ValueError):
        licenses.index([("long", " ".join(f"w{i}" for i in range(70)))], {})


def test_fingerprints(odd, none):
    got = {r.doc_id: r for r in fingerprints.edited(odd).collect()}
    assert got[1].fingerprint == got[2].fingerprint == "" and got[5].fingerprint == got[6].fingerprint
    assert got[6].near_next == 1.0 and got[10].n_chars == 200_000
    assert fingerprints.edited(none).count() == 0
    alone = fingerprints.edited(odd.where("doc_id = 4")).first()
    assert alone.near_next == 1.0


def test_fingerprints_meet_across_the_whole_corpus(spark, monkeypatch):
    random = np.random.default_rng(3)
    texts = []
    for i in range(150):
        words_ = [f"the {a} {b}" for a, b in random.integers(0, 40 if i % 3 else 4000, (30, 2))]
        if i >= 90:  # copies with a few changes, far away by id; all share hot signatures
            words_ = texts[int(random.integers(0, 90))].split(", ")
            for at in random.choice(30, random.integers(0, 5), replace=False):
                words_[at] = f"of new{i} x{at}"
        texts.append(", ".join(words_[:-1] + ["and hot passage"]))
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    sets = [set(s.tolist()) for s in fingerprints.signatures(pa.array(texts))]
    smallest = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    smallest[i] = smallest[j] = min(smallest[i], smallest[j])
        if all(smallest[k] == k for k in set(smallest)):
            break
    assert len(set(smallest)) < 130
    for known in (fingerprints.KNOWN, 1):  # the order changes no result
        monkeypatch.setattr(fingerprints, "KNOWN", known)
        assert {r.doc_id: r.alike_id for r in fingerprints.edited(docs).collect()} == dict(enumerate(smallest))


def test_toxicity(odd, none, labels, spark):
    got = toxicity.assess(odd, labels, odd.columns)
    assert {"score", "rejected"} < set(got.columns) and got.count() == odd.count()
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.assess(none, labels, ["doc_id"]).count() == 0
    assert toxicity.assess(odd, labels.where("false"), ["doc_id"]).where("rejected").count() == 0


def test_the_pipeline_keeps_columns_and_clean_documents(spark, odd, none, tmp_path):
    sf = "/root/testdata/sf0.001"
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = rows.written(stage(spark, docs, sf), f"case-{name}")
            assert out.columns == odd.columns
            docs = out
        packed = rows.written(corpus_pipeline.STAGES[-1][1](spark, docs, sf), "case-packing")
        # Every draw that mixing made is packed whole: its pieces begin at 0 as often as it was drawn.
        begins = packed.where("start = 0").groupBy("doc_id", "doc_tokens").agg(F.count("*").alias("times"), F.lit(1).alias("one"))
        lengths = packed.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"))
        pairs = begins.alias("b").join(lengths.alias("l"), F.expr("b.doc_id <=> l.doc_id AND b.doc_tokens = l.doc_tokens")).collect()
        assert all(r.n == r.times * r.doc_tokens for r in pairs)
        assert sum(r.times for r in pairs) == docs.count()


def test_near_copies_are_judged_by_their_own_text(spark):
    a, b = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    near = [*a[:100], "changed", *a[101:]]
    texts = [(1, a), (2, near), (2, b), (3, b), (2, b), (None, a), (4, [*b, "more"]), (2, [*b, "else"])]
    docs = table(spark, [(i, " ".join(t), "en", "s") for i, t in texts])
    kept = sorted((r.doc_id, r.text[:2]) for r in near_duplicates.keep_one(docs).collect())
    assert kept == [(1, "a0"), (2, "b0")]


def test_mixed_order_reaches_the_sequences(spark, tmp_path):
    import public_tokenizers

    docs = table(spark, [(i, " ".join([f"w{i}"] * 30), "en", "small" if i % 20 == 0 else "large") for i in range(600)])
    drawn = rows.written(mixing.in_order(mixing.mix(docs, corpus_pipeline.MIX)), "drawn")
    places = [r.position for part in drawn.select("position").rdd.glom().collect() for r in part]
    rising = sum(a <= b for a, b in zip(places, places[1:]))
    assert rising > 0.85 * len(places)
    first = packing.pack_documents(drawn.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), 2)
    twice = {r.doc_id: r.n for r in first.where("start = 0").groupBy("doc_id").agg(F.countDistinct("sequence_id").alias("n")).collect()}
    assert sum(n == 2 for i, n in twice.items() if i % 20 == 0) > 20  # both draws of a repeated document, in different sequences


def test_words_match_plain_splitting():
    texts = ["", None, " a  b\tc\n", "É x\x0by", "end", "\x1c \x85 z"]
    found = words.Words(pa.array(texts), words.UNSPACED)
    assert found.counts().tolist() == [0, 0, 3, 3, 1, 3]
    again = words.Words(pa.array(["c B a"]), words.UNSPACED).hashes()
    assert found.hashes()[:3].tolist() == again[::-1].tolist()
