"""Exact nearest neighbours over a stored gallery that skip what cannot be near (V2 with pruning).

``build`` cuts the live rows of every tenant into groups around pivots (rows chosen by a hash of the id) and stores them
partitioned by group, with each group's radius: the largest angle between its pivot and a row. Angles obey the triangle
inequality, so no row of a group is nearer to a probe than the angle to the pivot less the radius.

``knn_join`` first searches, per probe, the groups whose pivots are nearest, until they hold k rows. The k-th best score
found is a bound; of the other groups only those are searched whose best possible score reaches it (with a margin for
rounding). Only their partitions are read. Nothing is approximate: the rows equal those of ``gallery.knn_join``. How much is
skipped depends on the vectors; ``searched`` counts it. Vectors without direction are a group of their own, always searched.

Probes and rows meet pivots, and then rows, in tiles of bounded size per tenant, so no task holds a whole tenant. Groups travel
in blocks of neighbouring numbers: a probe goes once to each block that holds one of its groups, with the list of these, and
comes back with its k best of the block, however many groups it has there.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollgrid import session
from rollgrid.functions.nearest import PROBE_STEP, search_block
from rollgrid.functions.vectors import NORM_FLOOR, matrix, unit_rows
from rollgrid.operators.gallery import HIT, HIT_TYPES, TENANT, TILE_ROWS, _hits, _live, _probes, moved_rows

#: Rows a group should have, groups of a tenant at most, and cells listed in a filter (more are joined only).
GROUP_ROWS, MOST_GROUPS, LISTED_CELLS = 2048, 1024, 5000
#: The group of vectors without direction, and what rounding may add to a score.
NO_DIRECTION, MARGIN = -1, 1e-7

ROWS = "school_id STRING, role STRING, id BIGINT, person_id BIGINT, embedding ARRAY<FLOAT>, grp INT, cell STRING"
GROUPS = "school_id STRING, role STRING, grp INT, pivot ARRAY<DOUBLE>, cell STRING, radius DOUBLE, n BIGINT"


class Searched(NamedTuple):
    """Result rows, and the (probe, block) pairs that were searched with the rows of the groups searched there."""

    hits: DataFrame
    pairs: DataFrame


def _pointed(column: pa.ChunkedArray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors, and which of them have a direction that compares with the pivots'; the others are zeros."""
    vectors = matrix(column)
    if not isinstance(vectors, np.ndarray) or vectors.shape[1] != pivots.shape[1]:
        fits = [v if len(v) == pivots.shape[1] else np.zeros(pivots.shape[1]) for v in vectors]
        vectors = np.array(fits).reshape(len(fits), pivots.shape[1])
    return vectors, np.sqrt(np.einsum("ij,ij->i", vectors, vectors)) > NORM_FLOOR


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit_rows(vectors) @ unit_rows(pivots).T, -1.0, 1.0))


def _meeting(left: DataFrame, right: DataFrame, key: str, on: list[str], tile_rows: int):
    """Rows of ``left`` in tiles per ``on``, each with all rows of ``right`` there: grouped for a cogroup."""
    tiles = left.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("_tiles"))
    cut = left.join(tiles, on).withColumn("_tile", F.pmod(F.xxhash64(key), F.col("_tiles")).cast("int")).drop("_tiles")
    copied = right.join(tiles, on).withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).drop("_tiles")
    tasks, by = session.task_count(left.sparkSession), [*on, "_tile"]
    left, right = (df.toDF(*df.columns).repartition(tasks, *by) for df in (cut, copied))
    return left.groupBy(*by).cogroup(right.groupBy(*by))


def build(gallery: DataFrame, base: str, group_rows: int = GROUP_ROWS, most: int = MOST_GROUPS) -> None:
    """Store the live rows under ``base``/rows by group, and the groups under ``base``/groups."""
    spark = gallery.sparkSession
    live = _live(gallery).withColumn("embedding", F.col("embedding").cast("array<float>"))
    wanted = live.groupBy(*TENANT).agg(F.least(F.ceil(F.count(F.lit(1)) / group_rows), F.lit(most)).alias("_wanted"))
    usual = live.groupBy(*TENANT).agg(F.mode(F.size("embedding"), True).alias("_size"))  # pivots of a tenant have one length
    pointed = live.join(usual, TENANT).filter((F.size("embedding") == F.col("_size")) & F.exists("embedding", lambda x: F.abs(x) > 1e-6))
    ranked = pointed.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*TENANT).orderBy(F.xxhash64("id"), "id"))).filter(F.col("_rank") <= most)
    pivots = session.written(ranked.join(wanted, TENANT).filter("_rank <= _wanted").select(
        *TENANT, (F.col("_rank") - 1).cast("int").alias("grp"), F.col("embedding").cast("array<double>").alias("pivot")), "pivots")

    def assign(rows: pa.Table, near: pa.Table) -> pa.Table:
        names = ["school_id", "role", "id", "person_id", "embedding"]
        grp, angle = np.full(rows.num_rows, NO_DIRECTION, np.int32), np.full(rows.num_rows, np.pi)
        if rows.num_rows and near.num_rows:
            pivots = matrix(near["pivot"])
            vectors, pointed = _pointed(rows["embedding"], pivots)
            angles = _angles(vectors, pivots)
            best = angles.argmin(axis=1)
            grp[pointed] = near["grp"].to_numpy()[best[pointed]]
            angle[pointed] = angles[np.arange(len(best)), best][pointed]
        return rows.select(names).append_column("grp", pa.array(grp)).append_column("angle", pa.array(angle))

    placed = _meeting(live, pivots, "id", TENANT, TILE_ROWS).applyInArrow(
        assign, "school_id STRING, role STRING, id BIGINT, person_id BIGINT, embedding ARRAY<FLOAT>, grp INT, angle DOUBLE")
    cell = F.concat_ws("|", *TENANT, F.col("grp").cast("string"))
    placed = session.written(placed.withColumn("cell", cell), "placed")
    placed.drop("angle").repartition(session.task_count(spark), "cell").write.partitionBy("cell").mode("overwrite").parquet(f"{base}/rows")
    sizes = placed.groupBy(*TENANT, "grp", "cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
    sizes.join(pivots, [*TENANT, "grp"], "left").select([c.split()[0] for c in GROUPS.split(", ")]).write.mode("overwrite").parquet(f"{base}/groups")


CHOSEN = pa.schema([("query_id", pa.int64()), ("school_id", pa.string()), ("role", pa.string()), ("block", pa.int32()),
                    ("grps", pa.list_(pa.int32())), ("n", pa.int64()), ("embedding", pa.list_(pa.float64()))])


def _blocked(groups: DataFrame, tile_rows: int) -> DataFrame:
    """The groups with ``block``: runs of a tenant's groups of about as many rows as a task may hold."""
    before = F.sum("n").over(Window.partitionBy(*TENANT).orderBy("grp").rowsBetween(Window.unboundedPreceding, -1))
    return groups.withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / moved_rows(tile_rows)).cast("int"))


def _chosen(probes: DataFrame, groups: DataFrame, k: int, bounded: bool) -> DataFrame:
    """(query_id, tenant, block, grps, n, embedding): the groups to search first, or with a bound the others that can reach it."""
    schema = "query_id BIGINT, school_id STRING, role STRING, block INT, grps ARRAY<INT>, n BIGINT, embedding ARRAY<DOUBLE>"

    def choose(some: pa.Table, there: pa.Table) -> pa.Table:
        if not some.num_rows or not there.num_rows:
            return CHOSEN.empty_table()
        there = there.sort_by([("block", "ascending"), ("grp", "ascending")])
        return pa.concat_tables([part(some.slice(at, PROBE_STEP), there) for at in range(0, some.num_rows, PROBE_STEP)])

    def part(some: pa.Table, there: pa.Table) -> pa.Table:
        sizes = there["n"].to_numpy()
        grouped = there["grp"].to_numpy() != NO_DIRECTION
        least = np.zeros((some.num_rows, there.num_rows))  # angle that a row of the group has at least
        near = np.full(least.shape, -1.0)  # those without direction come first
        if grouped.any():
            pivots = matrix(there.filter(pa.array(grouped))["pivot"])
            vectors, pointed = _pointed(some["embedding"], pivots)
            near[:, grouped] = _angles(vectors, pivots)
            least[:, grouped] = np.maximum(near[:, grouped] - there["radius"].to_numpy()[grouped], 0.0)
            least[~pointed] = 0.0
        order = np.argsort(near, axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        first = np.zeros(least.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        first |= ~grouped[None, :]
        take = ~first & (np.cos(least) + MARGIN >= some["bound"].to_numpy()[:, None]) if bounded else first
        row, group = np.nonzero(take)
        if not len(row):
            return CHOSEN.empty_table()
        block = there["block"].to_numpy()[group]
        starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])])
        picked, ends = some.take(row[starts]), np.r_[starts, len(row)].astype(np.int32)
        grps = pa.ListArray.from_arrays(ends, pa.array(there["grp"].to_numpy()[group], pa.int32()))
        return pa.table({"query_id": picked["query_id"], "school_id": picked["school_id"], "role": picked["role"],
                         "block": pa.array(block[starts], pa.int32()), "grps": grps, "n": np.add.reduceat(sizes[group], starts),
                         "embedding": picked["embedding"].cast(pa.list_(pa.float64()))}).cast(CHOSEN)

    return _meeting(probes, groups, "query_id", TENANT, TILE_ROWS).applyInArrow(choose, schema)


def _search_cells(chosen: DataFrame, groups: DataFrame, base: str, k: int, tile_rows: int) -> DataFrame:
    """Hits of the chosen groups of each probe; reads the partitions of these cells only, as long as they can be listed."""
    spark = chosen.sparkSession
    rows = spark.read.schema(ROWS).parquet(f"{base}/rows")
    wanted = chosen.select(*TENANT, F.explode("grps").alias("grp")).distinct().join(groups, [*TENANT, "grp"]).select("cell")
    cells = [r["cell"] for r in wanted.limit(LISTED_CELLS + 1).collect()]
    if len(cells) <= LISTED_CELLS:
        rows = rows.filter(F.col("cell").isin(cells))
    rows = rows.drop("cell").join(groups.select(*TENANT, "grp", "block"), [*TENANT, "grp"])
    place = [*TENANT, "block"]
    tiles = lambda df, name: df.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / moved_rows(tile_rows)).cast("int").alias(name))
    counts = tiles(chosen, "_pt").join(tiles(rows, "_rt"), place)

    def cut(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        placed = df.join(counts, place).withColumn(f"{own}_tile", F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        return placed.withColumn(f"{other}_tile", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_pt", "_rt")

    def tile(some: pa.Table, there: pa.Table) -> pa.Table:
        if not some.num_rows or not there.num_rows:
            return HIT_TYPES.empty_table()
        tenant = there["school_id"][0].as_py(), there["role"][0].as_py()
        lists = some["grps"].combine_chunks()
        asked, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        line = np.argsort(asked, kind="stable")
        asked, owner = asked[line], owner[line]
        vectors = matrix(some["embedding"])
        best = np.full((len(lists), k), -np.inf), np.zeros((len(lists), k), np.int64), np.zeros((len(lists), k), np.int64)
        there = there.sort_by("grp")
        grp = there["grp"].to_numpy()
        for at in np.unique(grp):
            who = owner[np.searchsorted(asked, at) : np.searchsorted(asked, at, "right")]
            if not len(who):
                continue
            probes = vectors[who] if isinstance(vectors, np.ndarray) else [vectors[i] for i in who]
            low, high = np.searchsorted(grp, at), np.searchsorted(grp, at, "right")
            for start in range(low, high, TILE_ROWS):
                part = there.slice(start, min(TILE_ROWS, high - start))
                found = search_block(probes, matrix(part["embedding"]), part["id"].to_numpy(), part["person_id"].to_numpy(), k, False,
                                     tuple(x[who] for x in best))
                for target, source in zip(best, found):
                    target[who] = source
        return _hits(tenant, some["query_id"].to_numpy(), best)

    by, tasks = [*place, "_pt_tile", "_rt_tile"], session.task_count(spark)
    left, right = cut(chosen, "query_id", "_pt", "_rt"), cut(rows, "id", "_rt", "_pt")
    left, right = (df.toDF(*df.columns).repartition(tasks, *by) for df in (left, right))
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(tile, HIT)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", *TENANT).orderBy(F.col("score").desc(), F.col("id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def searched(queries: DataFrame, base: str, k: int = 5, tile_rows: int = TILE_ROWS) -> Searched:
    spark = queries.sparkSession
    groups = session.written(_blocked(spark.read.schema(GROUPS).parquet(f"{base}/groups"), tile_rows), "blocked-groups")
    probes = session.written(_probes(queries).withColumn("embedding", F.col("embedding").cast("array<double>")), "probes")
    first = session.written(_chosen(probes, groups, k, bounded=False), "first-groups")
    found = session.written(_best(_search_cells(first, groups, base, k, tile_rows), k), "first-hits").drop("rank")
    bound = found.groupBy("query_id", *TENANT).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    bounded = probes.join(bound, ["query_id", *TENANT], "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0)))
    rest = session.written(_chosen(bounded, groups, k, bounded=True), "other-groups")
    more = _search_cells(rest, groups, base, k, tile_rows)
    pairs = first.unionByName(rest).select("query_id", *TENANT, "block", "n")
    return Searched(_best(found.unionByName(more), k), pairs)


def knn_join(queries: DataFrame, base: str, k: int = 5, tile_rows: int = TILE_ROWS) -> DataFrame:
    """As ``gallery.knn_join`` on the gallery that ``build`` stored."""
    return searched(queries, base, k, tile_rows).hits


def skipped_share(found: Searched, queries: DataFrame, base: str) -> float:
    """Share of the (probe, row) pairs of the tenants that were not scored."""
    groups = queries.sparkSession.read.schema(GROUPS).parquet(f"{base}/groups")
    sizes = groups.groupBy(*TENANT).agg(F.sum("n").alias("_rows"))
    every = _probes(queries).join(sizes, TENANT).agg(F.sum("_rows")).first()[0] or 0
    scored = found.pairs.agg(F.sum("n")).first()[0] or 0
    return 1 - scored / every if every else 0.0
