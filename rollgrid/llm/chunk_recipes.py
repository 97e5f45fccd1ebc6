"""Exact duplicates by recipes of content-defined chunks.

A text is cut where its own characters say so (two characters that each return three places later), at chunks of 256 to
4096 characters, so equal passages give equal chunks wherever they stand. Chunks are deduplicated over the corpus: their
contents are grouped once, combined on the map side first, and get verified identifiers (hash, rank); the rank tells apart
different contents that share a hash, and is 0 nearly always. A document is then only its recipe, the ordered list of
identifiers. Recipes are compared; texts do not move again, however often a long document is copied.

Column functions only. A hot group is counted with partial sums; joining the group back to its rows is a sort-merge join of
short rows, which adaptive execution splits.

Defined cases: a null text is empty and has an empty recipe; all empty texts are equal. Rows that repeat both id and text
are one document: each counts in ``group_size`` and all are marked alike. Null ids are smallest; a group of null ids has a
null ``keep_id`` and is kept. An empty table gives no rows; other columns of the table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollgrid.llm import rows

#: 248 characters or more up to the first place where two characters each return three places later; else 4096.
CHUNK = r"(?s).{248,4088}?(?:(.)..\1(.)..\2|\z)|.{1,4096}"
#: Bits of a chunk's hash.
BITS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does just that where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def chunks(text: Column) -> Column:
    """The chunks of a text in order; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def _hash(chunk: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits)


def _contents(docs: DataFrame, bits: int) -> DataFrame:
    """Every different chunk of the corpus once: (hash, chunk)."""
    each = docs.select(normalised(F.col("text")).alias("text")).select(F.explode(chunks(F.col("text"))).alias("chunk"))
    return each.select(_hash(F.col("chunk"), bits).alias("hash"), "chunk").distinct()


def _ambiguous(docs: DataFrame, bits: int) -> DataFrame:
    """Hashes that different contents share; only hashes move on from the contents."""
    return rows.written(_contents(docs, bits).groupBy("hash").count().where("count > 1").select("hash"), "chunk-ambiguous")


def store(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Every different chunk with its verified identifier: (hash, rank, chunk)."""
    contents = _contents(docs, bits)
    ambiguous = _ambiguous(docs, bits)
    several = _ranked(contents, ambiguous)
    return contents.join(ambiguous, "hash", "left_anti").select("hash", F.lit(0).alias("rank"), "chunk").unionByName(several)


def _ranked(contents: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Contents that share a hash, numbered in their order."""
    rank = F.row_number().over(Window.partitionBy("hash").orderBy("chunk")) - 1
    return contents.join(ambiguous, "hash", "left_semi").select("hash", rank.alias("rank"), "chunk")


def recipes(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Per document: ``text_sha256`` and the ordered identifiers of its chunks, ``hashes`` and ``ranks`` (null: all 0)."""
    text = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    plain = rows.written(text.select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"),
        F.transform(chunks(F.col("text")), lambda c: _hash(c, bits)).alias("hashes")), "chunk-recipes")
    ambiguous = _ambiguous(docs, bits)
    if ambiguous.isEmpty():
        return plain.withColumn("ranks", F.lit(None).cast("array<int>"))
    several = rows.written(_ranked(_contents(docs, bits), ambiguous), "chunk-ranks")
    each = text.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode(chunks(F.col("text"))).alias("at", "chunk"))
    each = each.withColumn("hash", _hash(F.col("chunk"), bits)).join(several, ["hash", "chunk"]).where("rank > 0")
    ranks = each.select("doc_id", "text_sha256", "at", "rank").distinct().groupBy("doc_id", "text_sha256").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "rank"))).alias("found"))
    ranks = ranks.withColumnsRenamed({"doc_id": "r_id", "text_sha256": "r_sha256"})
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_sha256") == F.col("r_sha256"))
    full = F.transform(F.col("hashes"), lambda _, i: F.coalesce(F.col("found")[i], F.lit(0)))
    return plain.join(ranks, same, "left").select(
        "doc_id", "text_sha256", "hashes", F.when(F.col("found").isNotNull(), full).alias("ranks"))


def equal_texts(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Per document: the largest id with an equal text, how many rows have it, and whether this one stays."""
    made = recipes(docs, bits)
    groups = made.groupBy("hashes", "ranks").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    several = groups.where("group_size > 1").select(F.col("hashes").alias("g_hashes"), F.col("ranks").alias("g_ranks"), "keep_id", "group_size")
    same = (F.col("hashes") == F.col("g_hashes")) & F.col("ranks").eqNullSafe(F.col("g_ranks"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return made.join(several, same, "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", F.size("hashes").cast("long").alias("n_chunks"))
