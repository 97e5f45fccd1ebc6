"""Shards by a weighted hash tree: region, rack and shard are drawn one after the other.

At every node the key draws once per child, ``-ln(u) / weight`` with ``u`` from a hash of key and child, and the
smallest draw wins. A child's chance is its share of the weight, and a change of one child's weight moves keys only to
or from that child, so movement stays inside the subtrees whose weights change. ``grown`` adds a shard as a region of
its own: every other draw stays as it is, so rows move into the new shard and nowhere else.

Defined cases: a null ``doc_id`` is a key like any other; a null text has size 1; repeated rows get slots of their own;
an empty table gives no rows; other columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid.llm import rows

#: Bits of a draw: 13 hexadecimal digits.
BITS = 52
SEED = "tree"


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int) -> tuple[Leaf, ...]:
    """Two shards a rack, two racks a region, equal weights."""
    return tuple(Leaf(f"g{s // 4}", f"g{s // 4}/k{s // 2}", s) for s in range(shards))


def grown(tree: Iterable[Leaf], weight: float = 1.0) -> tuple[Leaf, ...]:
    """The tree with one more shard, in a region of its own."""
    tree = tuple(tree)
    new = max(leaf.shard for leaf in tree) + 1
    return (*tree, Leaf(f"new{new}", f"new{new}/k{new}", new, weight))


def hashed(*parts: Column | str) -> Column:
    """A whole number of ``BITS`` bits from the joined parts."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _winner(key: Column, children: dict[str, float]) -> Column:
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [F.struct((-F.ln((hashed(SEED, name, key) + F.lit(0.5)) / float(1 << BITS)) / F.lit(float(weight))).alias("draw"),
                      F.lit(name).alias("child")) for name, weight in sorted(children.items())]
    return F.array_min(F.array(*draws))["child"]


def _case(parent: Column, choices: dict[str, Column]) -> Column:
    items = list(choices.items())
    out = F.when(parent == items[0][0], items[0][1])
    for name, choice in items[1:]:
        out = out.when(parent == name, choice)
    return out


def levels(tree: Iterable[Leaf]) -> tuple[dict, dict, dict]:
    """Weights of the regions, of the racks of each region, and of the shards of each rack."""
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[str, float]] = {}
    for leaf in tree:
        regions[leaf.region] = regions.get(leaf.region, 0.0) + leaf.weight
        of = racks.setdefault(leaf.region, {})
        of[leaf.rack] = of.get(leaf.rack, 0.0) + leaf.weight
        shards.setdefault(leaf.rack, {})[f"s{leaf.shard}"] = leaf.weight
    return regions, racks, shards


def place(docs: DataFrame, tree: Iterable[Leaf], prefix: str = "") -> DataFrame:
    """``docs`` with the columns region, rack and shard of each row's ``doc_id`` (names after ``prefix``)."""
    regions, racks, shards = levels(tree)
    key = rows.id_text(F.col("doc_id"))
    region, rack, shard = f"{prefix}region", f"{prefix}rack", f"{prefix}shard"
    return (
        docs.withColumn(region, _winner(key, regions))
        .withColumn(rack, _case(F.col(region), {r: _winner(key, of) for r, of in racks.items()}))
        .withColumn(shard, F.substring(_case(F.col(rack), {r: _winner(key, of) for r, of in shards.items()}), 2, 9).cast("int"))
    )


def shard_documents(docs: DataFrame, tree: Iterable[Leaf], after: Iterable[Leaf]) -> DataFrame:
    """Size, checksum, shard, gapless slot in the shard, and the shard under the tree ``after``.

    Slots follow a hash of id and checksum. They are counted in two levels, so that a shard is never one task: rows are
    numbered inside blocks of the hash range, and blocks start after the rows of the blocks before them.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(
        "doc_id", F.when(F.col("text").isNull(), 1).otherwise(F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    narrow = narrow.withColumn("rank", hashed("slot", rows.id_text(F.col("doc_id")), F.col("text_crc32").cast("string")))
    placed = place(place(narrow, tree), after, "grown_")
    n_shards = len(tuple(tree))
    blocks = rows.blocks_for(docs.count() // max(n_shards, 1))
    placed = rows.written(placed.withColumn("block", rows.block_of(F.col("rank"), BITS, blocks)), "shards")
    before = placed.groupBy("shard", "block").agg(F.count("*").alias("n")).select(
        "shard", "block", rows.running_before(["shard"], ["block"], "n").alias("before"))
    inside = F.row_number().over(
        rows.Window.partitionBy("shard", "block").orderBy("rank", F.col("doc_id").asc_nulls_first(), "text_crc32", "size"))
    return placed.withColumn("inside", inside).join(before, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("inside") - 1).alias("slot"), F.col("grown_shard"), "region", "rack")
