"""The queries against plain Python on whole tables."""

import hashlib
import re
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rollgrid.llm import fingerprints, licenses, queries

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def run(spark, name, sf=SF):
    return queries.QUERIES[name](spark, sf).collect()


def test_token_counts(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = run(spark, "op5_token_counts")
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = run(spark, "op6_pack_sequences")
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    of_doc, of_sequence = {}, {}
    for r in rows:
        of_doc.setdefault(r.doc_id, []).append(r)
        of_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
    assert set(of_doc) == set(ids)
    for i, pieces in of_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[i])
    padded = 0
    for pieces in of_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and len({(r.tier, r.step) for r in pieces}) == 1
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert sorted(of_sequence) == list(range(len(of_sequence)))
    assert padded < 4096


def test_near_duplicates(spark, texts):
    shingles = {}
    for i, t in texts.items():
        w = [x for x in SPACE.split(lower(t)) if x]
        shingles[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    smallest = {i: i for i in shingles}

    def find(i):
        while smallest[i] != i:
            i = smallest[i]
        return i

    for i, a in shingles.items():
        for j, b in shingles.items():
            if i < j and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                smallest[y] = x
    rows = run(spark, "op7_minhash_hamming")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {
        i: (len(s), find(i), i == find(i)) for i, s in shingles.items()}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def plain_matches(block, templates):
    """(label, containment, places, words) of the templates in one block, in plain Python."""
    out = []
    for label, text in templates:
        words, deciding = set(text), set(licenses.DECIDING.get(label, "").split())
        needed = next(o for o in range(1, len(words) + 1) if o >= 0.85 * len(words) - 1e-9)
        longest = len(text) + max(2, len(text) // 8)
        places = []
        for begin, first in enumerate(block):
            if first in words | deciding:
                ends = [e for e in range(begin, min(len(block), begin + longest))
                        if len(words & set(block[begin : e + 1])) >= needed and deciding <= set(block[begin : e + 1])]
                places += [(begin, ends[0])] if ends else []
        share = len(words & set(block)) / len(words)
        if share >= 0.85 - 1e-9 and len(words & set(block)) >= needed and places:
            out.append((label, share, places, words))
    return out


def test_license_phrases_and_blocks(spark, texts):
    rows = {r.doc_id: r for r in run(spark, "op9_license_blocks")}
    phrases = {tuple(p.split()): label for p, label in licenses.PHRASES.items()}
    templates = [(label, words_of(t)) for label, t in licenses.TEMPLATES]
    assert set(rows) == set(texts)
    for i, t in texts.items():
        w, r = words_of(t), rows[i]
        places = [(k, label) for p, label in phrases.items() for k in range(len(w) - len(p) + 1) if tuple(w[k : k + len(p)]) == p]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert r.first_word == min((k for k, _ in places), default=None)
        assert r.last_word == max((k for k, _ in places), default=None)
        base = {label for _, label in places}
        assert r.base_labels == ",".join(sorted(base))
        best, labels = 0.0, set(base)
        blocks = []
        for k in range(0, max(len(w), 1), licenses.BLOCK // 2):
            block = set(w[k : k + licenses.BLOCK])
            hits = plain_matches(w[k : k + licenses.BLOCK], templates)
            best = max([best, *(share for _, share, _, _ in hits)])
            stay = set()
            for h in hits:
                def loses(label):
                    better = [o for o in hits if o[0] == label and (o[1], len(o[3])) > (h[1], len(h[3]))]
                    return better and h[3] & block <= set().union(*(o[3] for o in better)) and all(
                        any(x <= v and u <= y for o in better for u, v in o[2]) for x, y in h[2])
                if not any(loses(label) for label in {o[0] for o in hits} - {h[0]}):
                    stay.add(h[0])
            blocks.append(stay)
        for k, here in enumerate(blocks):
            around = set().union(*blocks[max(k - 1, 0) : k + 2])
            labels |= {label for label in here if not around & set(licenses.SAYS_MORE.get(label, ()))}
        assert r.labels == ",".join(sorted(labels))
        assert r.score == pytest.approx(1.0 if places else best)


def test_fingerprints(spark, texts):
    def spots(text):
        w = words_of(text)
        h = cache(lambda x: int(licenses.hashes_of(x)[0]))
        out = set()
        content = [k for k, x in enumerate(w) if x not in fingerprints.ANCHORS]
        for k, x in enumerate(w):
            chain = [c for c in content if c > k][: fingerprints.CHAIN]
            if x in fingerprints.ANCHORS and len(chain) == fingerprints.CHAIN:
                out.add((x, *(w[c] for c in chain)))
        return out or {(x,) for x in w}, h

    rows = {r.doc_id: r for r in run(spark, "op10_spot_fingerprints")}
    ids = sorted(texts, reverse=True)
    seen = {}
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = spots(t)[0], spots(edited)[0], spots(after)[0]
        jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert r.near_edited == pytest.approx(jaccard(a, b)) and r.near_next == pytest.approx(jaccard(a, c))
        assert r.n_signatures == len(a) and len(r.fingerprint) == 8 * len(a) and len(r.edited_fingerprint) == 8 * len(b)
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
    assert set(rows) == set(ids)


def test_toxicity_learns_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op2_toxicity_cnn"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    better = sum((a.score > b.score) + (a.score == b.score) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert better > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_shards(spark, texts):
    rows = run(spark, "op3_shard_tree")
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_sql_agrees(spark):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "labels"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, sql in queries.ORACLES.items():
        ours = queries.QUERIES[name](spark, SF).toPandas()
        theirs = db.sql(sql).df()[list(ours.columns)]
        order = list(ours.columns)
        ours, theirs = (d.sort_values(order).reset_index(drop=True) for d in (ours, theirs))
        assert ours.equals(theirs.astype(ours.dtypes.to_dict())), name


def test_mixing_meets_its_targets(spark):
    from rollgrid.llm import mixing, rows

    docs = rows.documents(spark, SF)
    shares = mixing.shares(docs.withColumn("tokens", mixing.tokens())).cache()
    entropy, _, _ = mixing.spread_at(shares, [mixing.exponent(shares, mixing.Target(entropy=0.99))])[0]
    assert entropy == pytest.approx(0.99 * np.log(shares.count()), abs=1e-4) or entropy >= 0.99 * np.log(shares.count())
    limit = mixing.Target(budget=2.0, repetition=2.5)
    ratio = mixing.spread_at(shares, [mixing.exponent(shares, limit)])[0][1]
    assert ratio * limit.budget <= limit.repetition + 1e-4
    drawn = mixing.mix(docs, limit).groupBy("source").agg(F.sum("tokens").alias("n"), F.max("tokens").alias("most")).collect()
    a = mixing.exponent(shares, limit)
    all_tokens = shares.first().all_tokens
    power = {r.source: r.share**a for r in shares.collect()}
    for r in drawn:
        quota = power[r.source] / sum(power.values()) * all_tokens * limit.budget
        assert quota - 1 <= r.n <= quota + r.most + 1
