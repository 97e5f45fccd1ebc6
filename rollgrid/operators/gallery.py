"""Exact nearest neighbours over a tenant-partitioned gallery, and what is decided from them.

Gallery rows: ``school_id, role, id, person_id, deleted, embedding`` (+ name, roll_no, reliability).
Probe rows: ``query_id, school_id, role, embedding``.

A search scores blocks of probes against blocks of the gallery with one matrix product each and
lets only the k best per probe leave the task. Three ways to bring the blocks together:

* probes that fit a checked size travel to the gallery rows, which stay where they are;
* else a gallery that fits it travels to the probes;
* otherwise both sides are cut into tiles of bounded size per (school, role) - as many tiles as the
  tenant has rows for - and every probe tile meets every gallery tile of its tenant in its own task.

All keep results exact: the k best of the whole are among the k best of the parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollgrid.functions.nearest import search_block
from rollgrid.functions.vectors import cosine, l2_normalize, matrix
from rollgrid.operators.directory import with_identity
from rollgrid.operators.numbering import number_rows
from rollgrid.session import task_count

# Fixed values of the identity rules.
MIN_IDENTITY = 0.55
DUPLICATE_AT = 0.75
REENROL_FLOOR = 0.65

PROBE_BYTES = 64 * 1024 * 1024
TILE_ROWS = 4096
#: Tiles of scoring that travel together, and rows they hold at most: a side is copied once per such block of the other side.
TILES_MOVED, MOVED_ROWS = 256, 16384
TENANT = ["school_id", "role"]
HIT = "query_id BIGINT, school_id STRING, role STRING, id BIGINT, person_id BIGINT, score DOUBLE"
HIT_TYPES = pa.schema([
    ("query_id", pa.int64()), ("school_id", pa.string()), ("role", pa.string()),
    ("id", pa.int64()), ("person_id", pa.int64()), ("score", pa.float64()),
])


def norm_role(role: Column) -> Column:
    return F.when(F.lower(role) == "teacher", "teacher").otherwise("student")


def _live(gallery: DataFrame) -> DataFrame:
    return gallery.filter(~F.col("deleted")).select(
        "school_id", norm_role(F.col("role")).alias("role"), "id", "person_id", "embedding")


def _probes(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "school_id", norm_role(F.col("role")).alias("role"), "embedding")


def _by_tenant(table: pa.Table) -> dict[tuple[str, str], pa.Table]:
    """Rows of a block by (school, role)."""
    names = pc.binary_join_element_wise(table["role"], table["school_id"], "/").combine_chunks().dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False)
    found = {}
    for code, name in enumerate(names.dictionary.to_pylist()):
        role, school = name.split("/", 1)
        found[school, role] = table.take(np.flatnonzero(codes == code))
    return found


def _hits(tenant: tuple[str, str], query_ids: np.ndarray, best) -> pa.Table:
    score, ids, persons = best
    filled = np.isfinite(score)
    rows, _ = np.nonzero(filled)
    return pa.table({
        "query_id": query_ids[rows], "school_id": pa.repeat(pa.scalar(tenant[0]), len(rows)),
        "role": pa.repeat(pa.scalar(tenant[1]), len(rows)),
        "id": ids[filled], "person_id": persons[filled], "score": score[filled],
    }, schema=HIT_TYPES)


def _search(probes: pa.Table, rows: pa.Table, k: int, per_person: bool, before=None):
    return search_block(matrix(probes["embedding"]), matrix(rows["embedding"]),
                        rows["id"].to_numpy(), rows["person_id"].to_numpy(), k, per_person, before)


def _search_carried(probes: DataFrame, gallery: DataFrame, k: int, per_person: bool) -> DataFrame:
    """Probes go to every gallery partition; each partition keeps a running k best per probe."""
    by_tenant = _by_tenant(probes.toArrow())
    carried = probes.sparkSession.sparkContext.broadcast(by_tenant)
    # The schools of the probes reach the scan, so a gallery partitioned by school is read only there.
    gallery = gallery.filter(F.col("school_id").isin(sorted({school for school, _ in by_tenant})))

    def partition(batches):
        best = {}
        for batch in batches:
            for tenant, rows in _by_tenant(pa.Table.from_batches([batch])).items():
                if tenant in carried.value:
                    best[tenant] = _search(carried.value[tenant], rows, k, per_person, best.get(tenant))
        for tenant, found in best.items():
            ids = carried.value[tenant]["query_id"].to_numpy()
            yield from _hits(tenant, ids, found).to_batches(max_chunksize=65536)

    return gallery.mapInArrow(partition, HIT)


def _search_small_gallery(probes: DataFrame, gallery: DataFrame, k: int, per_person: bool) -> DataFrame:
    """The gallery goes to the probes, which stay where they are; a probe meets all of it at once."""
    by_tenant = _by_tenant(gallery.toArrow())
    carried = probes.sparkSession.sparkContext.broadcast(by_tenant)
    probes = probes.filter(F.col("school_id").isin(sorted({school for school, _ in by_tenant})))

    def partition(batches):
        for batch in batches:
            for tenant, some in _by_tenant(pa.Table.from_batches([batch])).items():
                if tenant in carried.value:
                    found = _search(some, carried.value[tenant], k, per_person)
                    yield from _hits(tenant, some["query_id"].to_numpy(), found).to_batches(max_chunksize=65536)

    return probes.mapInArrow(partition, HIT)


def moved_rows(tile_rows: int) -> int:
    return min(tile_rows * TILES_MOVED, max(tile_rows, MOVED_ROWS))


def _search_tiled(probes: DataFrame, gallery: DataFrame, k: int, per_person: bool, tile_rows: int) -> DataFrame:
    """Blocks of probes × blocks of the gallery per tenant; their counts follow the tenant's row counts.

    A task scores its block of the gallery in tiles of ``tile_rows``. What moves grows with the rows times the blocks of the
    other side, so blocks are as large as a task may hold, however small the tiles are.
    """
    def tiles(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*TENANT).agg(F.ceil(F.count(F.lit(1)) / moved_rows(tile_rows)).cast("int").alias(name))

    counts = tiles(probes, "probe_tiles").join(tiles(gallery, "gallery_tiles"), TENANT)

    def cut(df: DataFrame, key: str, own: str, other: str, own_tile: str, other_tile: str) -> DataFrame:
        placed = df.join(counts, TENANT).withColumn(own_tile, F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        return placed.withColumn(
            other_tile, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("probe_tiles", "gallery_tiles")

    left = cut(probes, "query_id", "probe_tiles", "gallery_tiles", "pt", "gt")
    right = cut(gallery, "id", "gallery_tiles", "probe_tiles", "gt", "pt")

    def tile(some_probes: pa.Table, rows: pa.Table) -> pa.Table:
        if not some_probes.num_rows or not rows.num_rows:
            return HIT_TYPES.empty_table()
        tenant = rows["school_id"][0].as_py(), rows["role"][0].as_py()
        vectors, found = matrix(some_probes["embedding"]), None
        for at in range(0, rows.num_rows, tile_rows):
            some = rows.slice(at, tile_rows)
            found = search_block(vectors, matrix(some["embedding"]), some["id"].to_numpy(), some["person_id"].to_numpy(), k, per_person, found)
        return _hits(tenant, some_probes["query_id"].to_numpy(), found)

    keys, tasks = [*TENANT, "pt", "gt"], task_count(probes.sparkSession)
    # Fresh column identities: probes often come from the gallery table itself.
    left, right = (df.toDF(*df.columns).repartition(tasks, *keys) for df in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, HIT)


def _vector_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.size("embedding").cast("bigint") * 8 + 64)).first()[0] or 0


def knn_join(
    queries: DataFrame, gallery: DataFrame, k: int = 5, per_person: bool = False,
    probe_bytes: int = PROBE_BYTES, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """For each probe the k live gallery rows of its school and role with the largest cosine.

    Score is the cosine to nine digits, ties go to the lower id, ``rank`` starts at 1. With
    ``per_person`` a person counts once, with the best of their vectors.
    """
    probes, live = _probes(queries), _live(gallery)
    if _vector_bytes(probes) <= probe_bytes:
        found = _search_carried(probes, live, k, per_person)
    elif _vector_bytes(live) <= probe_bytes:
        found = _search_small_gallery(probes, live.filter("school_id IS NOT NULL"), k, per_person)
    else:
        found = _search_tiled(probes, live, k, per_person, tile_rows)
    if per_person:
        best = F.max_by(F.struct("score", "id"), F.struct(F.col("score"), -F.col("id"))).alias("b")
        found = found.groupBy("query_id", *TENANT, "person_id").agg(best).select(
            "query_id", *TENANT, F.col("b.id").alias("id"), "person_id", F.col("b.score").alias("score"))
    order = Window.partitionBy("query_id", *TENANT).orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def similar_ids(queries: DataFrame, gallery: DataFrame, k: int = 5) -> DataFrame:
    """The k best student ids per probe, best first."""
    as_student = queries.withColumn("role", F.lit("student"))
    ranked = F.sort_array(F.collect_list(F.struct("rank", "id")))
    return knn_join(as_student, gallery, k).groupBy("query_id").agg(
        F.transform(ranked, lambda r: r["id"]).alias("ids"))


def best_match(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """Every probe with its best match, NULLs where its school and role have none."""
    best = knn_join(queries, gallery, 1).select(
        "query_id", F.col("id").alias("match_id"), F.col("person_id").alias("match_person_id"), "score")
    return queries.join(best, "query_id", "left")


def resolve_identity(queries: DataFrame, gallery: DataFrame, min_score: float = MIN_IDENTITY) -> DataFrame:
    """Best of both roles per probe (student on equal scores); no row below ``min_score``."""
    both = queries.withColumn("role", F.explode(F.array(F.lit("student"), F.lit("teacher"))))
    hit = F.struct("id", "person_id", "role", "score")
    better = F.struct(F.col("score"), (F.col("role") == "student").cast("int"))
    best = knn_join(both, gallery, 1).filter(F.col("score") >= min_score)
    return best.groupBy("query_id", "school_id").agg(F.max_by(hit, better).alias("b")).select(
        "query_id", "school_id", "b.*")


def find_duplicates(candidates: DataFrame, gallery: DataFrame, threshold: float = DUPLICATE_AT) -> DataFrame:
    hits = knn_join(candidates, gallery, 1).filter(F.col("score") >= threshold).drop("rank", "role")
    return with_identity(hits, gallery)


def enrol(
    candidates: DataFrame, gallery: DataFrame, duplicate_at: float = DUPLICATE_AT, floor: float = REENROL_FLOOR
) -> DataFrame:
    """Candidates (with ``person_id``) with ``decision``, the best match and the threshold that decided.

    A strong match with somebody else is ``duplicate_face``; a weak match with oneself is
    ``reenroll_mismatch``; everything else is ``accept``.
    """
    judged = best_match(candidates, gallery)
    own = F.col("match_person_id") == F.col("person_id")
    decision = F.when(~own & (F.col("score") >= duplicate_at), "duplicate_face").when(
        own & (F.col("score") < floor), "reenroll_mismatch").otherwise("accept")
    threshold = F.when(F.col("decision") == "duplicate_face", duplicate_at).when(
        F.col("decision") == "reenroll_mismatch", floor)
    return judged.withColumn("decision", decision).withColumn("threshold", threshold)


def append_gallery(accepted: DataFrame, gallery: DataFrame, arrival: str = "query_id", reserved: DataFrame | None = None) -> DataFrame:
    """New gallery rows: unit vectors and the next ids of each school in order of arrival.

    Ids go on from the largest one ever given, deleted rows included, so none is used twice. After a compaction the gallery
    alone no longer tells; ``reserved`` is then ``snapshots.reserved_ids`` (school_id, next_id).
    """
    next_id = gallery.groupBy("school_id").agg((F.max("id") + 1).alias("_next"))
    if reserved is not None:
        marks = reserved.select("school_id", F.col("next_id").alias("_next"))
        next_id = next_id.unionByName(marks).groupBy("school_id").agg(F.max("_next").alias("_next"))
    numbered = number_rows(accepted, ["school_id"], [arrival], "_nth").join(next_id, "school_id", "left")
    return numbered.select(
        "school_id", (F.coalesce("_next", F.lit(0)) + F.col("_nth") - 1).alias("id"),
        *[c for c in accepted.columns if c not in ("school_id", "id", "embedding", arrival, "deleted")],
        F.lit(False).alias("deleted"), l2_normalize(F.col("embedding")).cast("array<float>").alias("embedding"),
    )


def tombstone(gallery: DataFrame, ids: DataFrame) -> DataFrame:
    """Gallery with the (school_id, id) rows marked deleted; unknown ids change nothing."""
    gone = ids.select("school_id", "id").distinct().withColumn("_gone", F.lit(True))
    flag = (F.col("deleted") | F.coalesce("_gone", F.lit(False))).alias("deleted")
    return gallery.join(gone, ["school_id", "id"], "left").select(
        *[flag if c == "deleted" else F.col(c) for c in gallery.columns])


def vectors_of(requests: DataFrame, gallery: DataFrame) -> DataFrame:
    """One row per live vector of each requested (school, role, person); ``id`` is NULL where none is.

    Rows, not a list per person: a person with very many vectors stays spread over tasks.
    """
    live = _live(gallery).select("school_id", "role", "person_id", "id", "embedding")
    asked = requests.withColumn("role", norm_role(F.col("role"))).distinct()
    return asked.join(live, ["school_id", "role", "person_id"], "left")


def enrolled_ids(gallery: DataFrame) -> DataFrame:
    return gallery.filter(~F.col("deleted")).select("school_id", "person_id").distinct()


def verify_pairs(pairs: DataFrame) -> DataFrame:
    """Adds ``similarity`` of ``probe`` and ``claimed``."""
    return pairs.withColumn("similarity", cosine(F.col("probe"), F.col("claimed")))
