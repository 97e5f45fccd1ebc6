"""Spelling variants of a corpus's words by PartEnum signatures.

Two words one edit apart (a code point inserted, deleted or replaced) have letter multisets which, as binary vectors with
a place for the k-th occurrence of each letter, differ in two places at most. The letters are dealt to ``PARTS`` parts, by
falling frequency so that the parts weigh alike. Two differences touch at most two parts, so for some choice of all parts
but two the projections agree: every such choice is a signature, and no pair is missed. Signatures are equi-joined and the
edit distance is verified on the words.

Letters say little of a word when very many words share them, so hot signatures are split by what one edit cannot
change: it leaves the first ``HEAD`` or the last ``TAIL`` code points alone (words have at least their sum), so a hot
signature continues as two longer ones. What is still hot continues with the halves of words of one length, or of two
lengths that differ by one. Both splits are exact: a pair that shares a signature shares one of its continuations.

Words are counted with partial sums, each text is read once, and from there on only the vocabulary moves.

Defined cases: a null text has no words; a null id is written ``null`` in the hash; repeated rows count each; an empty
table gives no rows; other columns of the table are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid.llm import rows
from rollgrid.llm.chunk_recipes import ascii_lower

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_TIMES = 7, 2
#: Parts of the alphabet; two of them may differ.
PARTS, DIFFER = 4, 2
HEAD, TAIL = 4, 3
#: Words of a signature beyond which it is split, first by its ends, then by its halves.
HOT = (16, 64)
#: A word's form must be this many times as frequent.
TIMES = 10


def runs(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0))


def _lower(word: Column) -> Column:
    return F.when(word.rlike("[A-Z]"), ascii_lower(word)).otherwise(word)


def damaged(doc_id: Column, word: Column, every: int) -> Column:
    """The word without one code point where ``every`` divides the hash of id and word."""
    h = F.crc32(F.concat(rows.id_text(doc_id), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, every: int = 31) -> DataFrame:
    """Words of at least ``LEAST_LENGTH`` code points that occur at least ``LEAST_TIMES`` times: (word, n)."""
    each = docs.select("doc_id", F.explode(runs(F.col("text"))).alias("run")).select("doc_id", _lower(F.col("run")).alias("run"))
    each = each.select(damaged(F.col("doc_id"), F.col("run"), every).alias("word"))
    return each.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TIMES)


def parts_of(words: DataFrame) -> list[str]:
    """The letters of each part; at most the 90 letters that a word can hold are collected."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("times"))
    ranked = [r["letter"] for r in letters.orderBy(F.desc("times"), "letter").collect()]
    return ["".join(ranked[p::PARTS]) for p in range(PARTS)]


def _signatures(words: DataFrame, parts: list[str]) -> DataFrame:
    """(key, word, n): one row per word and choice of parts that may not differ."""
    of_part = [F.array_join(F.array_sort(F.regexp_extract_all("word", F.lit(f"[{p}]"), F.lit(0))), "") if p else F.lit("") for p in parts]
    projected = words.select("word", "n", *[e.alias(f"part_{i}") for i, e in enumerate(of_part)])
    chosen = [F.xxhash64(F.lit(k), *[F.col(f"part_{i}") for i in same])
              for k, same in enumerate(combinations(range(len(parts)), len(parts) - DIFFER))]
    return projected.select(F.explode(F.array(*chosen)).alias("key"), "word", "n")


def _by_ends(keyed: DataFrame) -> DataFrame:
    ends = [F.xxhash64("key", F.lit("head"), F.substring("word", 1, HEAD)), F.xxhash64("key", F.lit("tail"), F.substring("word", -TAIL, TAIL))]
    return keyed.select(F.explode(F.array(*ends)).alias("key"), "word", "n")


def _by_halves(keyed: DataFrame) -> DataFrame:
    """Per length of the longer word of a pair, which is this word's or one more: its half before and its half behind."""
    length, ways = F.char_length("word"), []
    for longer in (length, length + 1):
        half = F.floor(longer / 2).cast("int")
        ways += [F.xxhash64("key", F.lit("before"), longer, F.substring(F.col("word"), F.lit(1), half)),
                 F.xxhash64("key", F.lit("behind"), longer, F.substring(F.col("word"), half - longer, longer - half))]
    return keyed.select(F.explode(F.array(*ways)).alias("key"), "word", "n")


def _near_in(keyed: DataFrame) -> DataFrame:
    """Pairs of words that share a key and are one edit apart, each way round."""
    other = keyed.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = keyed.join(other, "key").where(
        (F.col("word") < F.col("near")) & (F.abs(F.char_length("word") - F.char_length("near")) <= 1)
        & (F.levenshtein("word", "near", 1) == 1))
    return met.select("word", "n", "near", "near_n")


def near_pairs(words: DataFrame, hot: tuple[int, int] = HOT) -> DataFrame:
    """All pairs of words one edit apart, once each: (word, n, near, near_n), word < near."""
    keyed, found = _signatures(words, parts_of(words)), []
    for most, split in zip((*hot, None), (_by_ends, _by_halves, None)):
        keyed = rows.written(keyed, "spelling-keys")
        sizes = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        if split is None:
            found.append(_near_in(keyed.join(sizes, "key").drop("members")))
            break
        sized = rows.written(keyed.join(sizes, "key"), "spelling-sized")
        found.append(_near_in(sized.where(F.col("members") <= most).drop("members")))
        keyed = split(sized.where(F.col("members") > most).drop("members"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def forms(words: DataFrame, hot: tuple[int, int] = HOT) -> DataFrame:
    """Per word: how many words are near, its form (the most frequent near word, if frequent enough) and its root."""
    words = rows.written(words, "spelling-words")
    pairs = rows.written(near_pairs(words, hot), "spelling-pairs")
    both = pairs.select("word", "near", "near_n").unionByName(
        pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form_n = -F.col("best.less")
    formed = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(form_n >= TIMES * F.col("n"), F.col("best.near")).alias("form"),
        F.when(form_n >= TIMES * F.col("n"), form_n).alias("form_n"))
    formed = rows.written(formed, "spelling-forms")
    roots = _roots(formed)
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", F.col("word")).alias("root"), "n", "n_near", "form_n")


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words with a form. Every step is ``TIMES`` as frequent, so a chain has few and no circle."""
    root = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = root.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = rows.written(root.join(further, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        root = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return root


def variants(docs: DataFrame, every: int = 31) -> DataFrame:
    return forms(vocabulary(docs, every))
