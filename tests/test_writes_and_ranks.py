"""Partition writes, order statistics, dense box cells, reserved ids."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollgrid import schemas
from rollgrid.operators import directory, gallery, spatial
from rollgrid.operators.ranks import OrderIndex
from rollgrid.sources import partitioned, snapshots

PEOPLE = "id BIGINT, school STRING, room BIGINT, name STRING"


def stored(spark, path, rows, schema=PEOPLE, by=("school",)):
    spark.createDataFrame(rows, schema).repartition(2).write.partitionBy(*by).parquet(path)
    return path, schema, list(by)


def files(path):
    return {str(f.relative_to(path)) for f in Path(path).rglob("*.parquet")}


def contents(spark, table):
    names = [c.split()[0] for c in table[1].split(", ")]
    return sorted(map(tuple, spark.read.schema(table[1]).parquet(table[0]).select(names).collect()), key=repr)


def test_only_touched_partitions_are_written(spark, tmp_path):
    rows = [(i, f"s/{i % 5}=x" if i % 6 else None, i % 3, f"n{i}") for i in range(60)]
    table = stored(spark, str(tmp_path / "people"), rows)
    before = files(table[0])
    gone = spark.createDataFrame([(7,), (12,), (999,), (7,)], "id bigint")  # 7 and a row without school
    assert partitioned.delete_rows(spark, *table, gone) == 2
    assert contents(spark, table) == sorted((r for r in rows if r[0] not in (7, 12)), key=repr)
    after, touched = files(table[0]), ("s%2F2%3Dx", "__HIVE_DEFAULT_PARTITION__")
    same = {f for f in before if not any(t in f for t in touched)}
    assert same and same <= after and not any(f in after for f in before - same)
    patches = spark.createDataFrame([(9, None, True), (13, "new", True), (14, "no", False)], "id bigint, name string, has_name boolean")
    assert partitioned.update_rows(spark, *table, patches, ["id"], ["name"]) == 2
    assert {r[0]: r[3] for r in contents(spark, table) if r[0] in (9, 13, 14)} == {9: None, 13: "new", 14: "n14"}
    assert partitioned.delete_rows(spark, *table, gone) == 0  # again: nothing to do
    everybody = spark.createDataFrame([(i,) for i in range(60) if i % 5 == 1 and i % 6], "id bigint")
    partitioned.delete_rows(spark, *table, everybody)  # a partition loses its last row
    assert not [r for r in contents(spark, table) if r[1] == "s/1=x"]


def test_a_broken_rewrite_leaves_the_table(spark, tmp_path):
    table = stored(spark, str(tmp_path / "people"), [(i, f"s{i % 3}", 0, "n") for i in range(9)])
    before, rows = files(table[0]), contents(spark, table)

    def breaks(held):
        return held.withColumn("name", F.raise_error(F.lit("broken")))

    touched = spark.read.schema(PEOPLE).parquet(table[0]).where("id = 4")
    with pytest.raises(Exception, match="broken"):
        partitioned.rewrite(spark, *table, touched, breaks)
    assert files(table[0]) == before and contents(spark, table) == rows
    assert partitioned.rewrite(spark, *table, touched, lambda held: held.withColumn("name", F.lit("whole"))) == 1


def test_cascade_is_finished_by_a_second_run(spark, tmp_path, monkeypatch):
    tables = {
        "school": stored(spark, str(tmp_path / "school"), [(1, "a"), (2, "b")], "id BIGINT, name STRING", ["name"]),
        "room": stored(spark, str(tmp_path / "room"), [(10, 1, "x"), (11, 2, "y"), (12, 2, "x")], "id BIGINT, school_id BIGINT, kind STRING", ["kind"]),
        "seat": stored(spark, str(tmp_path / "seat"), [(i, 10 + i % 3, None if i % 4 else 11, i % 2) for i in range(24)],
                       "id BIGINT, room_id BIGINT, spare_room BIGINT, side BIGINT", ["side"])}
    rules, nulls = [("school", "room", "school_id"), ("room", "seat", "room_id")], [("room", "seat", "spare_room")]
    gone = spark.createDataFrame([(2,)], "id bigint")
    write = partitioned.delete_rows

    def fails_once(spark, path, *rest):
        if path.endswith("room"):
            monkeypatch.setattr(partitioned, "delete_rows", write)
            raise RuntimeError("lost")
        return write(spark, path, *rest)

    monkeypatch.setattr(partitioned, "delete_rows", fails_once)
    with pytest.raises(RuntimeError, match="lost"):
        partitioned.cascade(spark, tables, "school", gone, rules, nulls)
    partitioned.cascade(spark, tables, "school", gone, rules, nulls)
    assert contents(spark, tables["school"]) == [(1, "a")] and contents(spark, tables["room"]) == [(10, 1, "x")]
    assert contents(spark, tables["seat"]) == sorted(((i, 10, None, i % 2) for i in range(0, 24, 3)), key=repr)


def test_pages_by_order_statistics(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), None if i % 11 == 0 else f"w{rng.integers(0, 3)}", float(rng.normal())) for i in rng.permutation(4000)]
    df = spark.createDataFrame(rows, "id bigint, word string, x double").repartition(5)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))  # nulls come first
    index = OrderIndex(df, ["word", "id"], 4000, small=60)
    for start in (3000, 0, 3990, 1234, 1244, 363, 5000):
        got = [tuple(r) for r in index.rows(start, 10).collect()]
        assert got == want[start : start + 10]
    scans = index.scans
    assert [tuple(r) for r in index.rows(1240, 10).collect()] == want[1240:1250] and index.scans == scans  # kept boundaries
    assert sum(index.counts) == 4000
    same = OrderIndex(df.withColumn("one", F.lit(1)), ["one"], 4000, small=60)
    assert len(same.rows(2000, 10).collect()) == 10  # one key for all rows: nothing to cut
    deep = directory.page(df.select("word", "id"), ["word", "id"], 301, size=10, clamp=False, deep_from=50)
    assert [tuple(r)[:2] for r in deep.collect()] == [(r[1], r[0]) for r in want[3000:3010]]
    fallen = directory.page(df.select("id"), [F.desc("id")], 301, size=10, clamp=False, deep_from=50)
    assert [r.id for r in fallen.collect()] == list(range(999, 989, -1))


def test_dense_frames_are_split(spark):
    rng = np.random.default_rng(1)
    rows = [(0, i, tuple(int(x) for x in (*rng.integers(0, 60, 2), *rng.integers(3, 20, 2)))) for i in range(300)]  # one cell
    rows += [(0, 300 + i, (10, 10, 4000 + i, 4000)) for i in range(40)] + [(1, 400 + i, (-700 + 900 * i, 5, 300, 300)) for i in range(9)]
    boxes = spark.createDataFrame(rows, "frame bigint, box_id bigint, bbox struct<x: int, y: int, width: int, height: int>")

    def overlap(a, b):
        w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if w > 0 and h > 0 else 0

    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and overlap(a[2], b[2]) >= 0.2}
    for cell, dense in ((512, 50), (512, 7), (96, 20), (7, 30)):
        got = [(r.a_id, r.b_id) for r in spatial.box_overlap(boxes, boxes, ["frame"], 0.2, cell, dense).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_ids_are_never_given_twice(spark, tmp_path):
    rows = [("S1", i, 100 + i, "n", "r", "student", None, False, [1.0, float(i)]) for i in range(4)] + [("S2", 9, 1, "n", "r", "student", None, False, [1.0, 0.0])]
    table, base = spark.createDataFrame(rows, schemas.GALLERY), str(tmp_path)
    new = spark.createDataFrame([(1, "S1", 7, [0.0, 1.0]), (2, "S2", 8, [0.0, 1.0]), (3, "S3", 9, [0.0, 1.0])], "query_id bigint, school_id string, person_id bigint, embedding array<float>")
    gone = spark.createDataFrame([("S1", 3), ("S1", 2), ("S2", 9)], "school_id string, id bigint")
    snapshots.write_snapshot(gallery.tombstone(table, gone), base, "1", least_deleted=0.6)
    kept = sorted((r.school_id, r.id, r.deleted) for r in snapshots.read_snapshot(spark, base).collect())
    assert kept == [("S1", 0, False), ("S1", 1, False), ("S1", 2, True), ("S1", 3, True)]  # S1 has too few deleted rows
    for version in ("2", "3"):
        snapshots.write_snapshot(snapshots.read_snapshot(spark, base), base, version)
    assert snapshots.read_snapshot(spark, base).count() == 2
    added = gallery.append_gallery(new, snapshots.read_snapshot(spark, base), reserved=snapshots.reserved_ids(spark, base))
    assert sorted((r.school_id, r.id) for r in added.collect()) == [("S1", 4), ("S2", 10), ("S3", 0)]
