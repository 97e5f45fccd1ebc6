"""Vector queries over the embeddings table."""

from pyspark.sql import functions as F

from rollgrid.functions import vectors
from rollgrid.operators import directory, gallery, gallery_index
from rollgrid.plans.registry import query
from rollgrid.session import fresh_path
from rollgrid.sources import snapshots

PAIRS = """
    live AS (SELECT school_id, role, id, person_id, name, roll_no, reliability, CAST(embedding AS DOUBLE[]) AS e
             FROM gallery WHERE NOT deleted),
    wanted AS (SELECT query_id, school_id, {role} AS role, person_id, embedding FROM probe),
    scored AS (SELECT w.query_id, w.school_id, w.role, g.id, g.person_id, g.name, g.roll_no, g.reliability,
                      round(list_cosine_similarity(w.embedding, g.e), 9) AS score
               FROM wanted w JOIN live g ON g.school_id = w.school_id AND g.role = w.role),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, role ORDER BY score DESC, id) AS rank FROM scored)"""
AS_ASKED = PAIRS.format(role="CASE WHEN lower(role) = 'teacher' THEN 'teacher' ELSE 'student' END")
AS_STUDENT = PAIRS.format(role="'student'")
BOTH_ROLES = PAIRS.format(role="unnest(['student', 'teacher'])")


def scored(df, digits=6):
    return df.withColumn("score", F.round("score", digits))


@query("v1_cosine_normalize", "probe gallery", """
    SELECT p.query_id, round(list_cosine_similarity(p.embedding, CAST(g.embedding AS DOUBLE[])), 6) AS cosine,
           round(sqrt(list_inner_product(p.embedding, p.embedding)), 6) AS norm,
           round(p.embedding[1] / sqrt(list_inner_product(p.embedding, p.embedding)), 6) AS first_part,
           0.0 AS mixed_lengths
    FROM probe p JOIN gallery g ON g.id = p.query_id""")
def v1(v):
    pair = v.probe.select("query_id", "embedding").join(
        v.gallery.select(F.col("id").alias("query_id"), F.col("embedding").alias("stored")), "query_id")
    e, s = F.col("embedding"), F.col("stored")
    return pair.select(
        "query_id", F.round(vectors.cosine(e, s), 6).alias("cosine"), F.round(vectors.l2_norm(e), 6).alias("norm"),
        F.round(vectors.l2_normalize(e)[0], 6).alias("first_part"),
        vectors.cosine(F.slice(e, 1, 5), s).alias("mixed_lengths"))


KNN_SQL = "WITH " + AS_ASKED + """
    SELECT query_id, school_id, role, id, person_id, round(score, 6) AS score, CAST(rank AS INT) AS rank
    FROM ranked WHERE rank <= 5"""


@query("v2_knn_join", "probe gallery", KNN_SQL)
def v2(v):
    return scored(gallery.knn_join(v.probe, v.gallery, 5))


@query("v2_knn_join_tiled", "probe gallery", KNN_SQL)
def v2_tiled(v):
    return scored(gallery.knn_join(v.probe, v.gallery, 5, probe_bytes=0, tile_rows=64))


@query("v2_knn_join_pruned", "probe gallery", KNN_SQL)
def v2_pruned(v):
    """Same rows from a stored gallery, cut into groups of about 16 rows; groups that cannot hold one of the best are skipped."""
    base = fresh_path(v.spark, "grouped")
    gallery_index.build(v.gallery, base, group_rows=16)
    return scored(gallery_index.knn_join(v.probe, base, 5))


@query("v3_similar_ids", "probe gallery", "WITH " + AS_STUDENT + """
    SELECT query_id, string_agg(CAST(id AS STRING), ',' ORDER BY rank) AS ids FROM ranked WHERE rank <= 4 GROUP BY 1""")
def v3(v):
    return gallery.similar_ids(v.probe, v.gallery, 4).select(
        "query_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("v4_best_match", "probe gallery", "WITH " + AS_ASKED + """
    SELECT p.query_id, coalesce(r.id, -1) AS match_id, coalesce(r.person_id, -1) AS match_person_id,
           coalesce(round(r.score, 6), -2.0) AS score
    FROM probe p LEFT JOIN ranked r ON r.query_id = p.query_id AND r.rank = 1""")
def v4(v):
    return gallery.best_match(v.probe, v.gallery).select(
        "query_id", F.coalesce("match_id", F.lit(-1)).alias("match_id"),
        F.coalesce("match_person_id", F.lit(-1)).alias("match_person_id"),
        F.coalesce(F.round("score", 6), F.lit(-2.0)).alias("score"))


@query("v5_resolve_identity", "probe gallery", "WITH " + BOTH_ROLES + """
    SELECT query_id, school_id, arg_max(id, (score, role = 'student')) AS id,
           arg_max(role, (score, role = 'student')) AS role, round(max(score), 6) AS score
    FROM ranked WHERE rank = 1 AND score >= 0.55 GROUP BY query_id, school_id""")
def v5(v):
    return scored(gallery.resolve_identity(v.probe, v.gallery)).drop("person_id")


@query("v6_find_duplicates", "probe gallery", "WITH " + AS_ASKED + """
    SELECT query_id, school_id, id, person_id, round(score, 6) AS score, name AS match_name, roll_no AS match_roll_no,
           role AS match_role, reliability AS match_reliability FROM ranked WHERE rank = 1 AND score >= 0.75""")
def v6(v):
    return scored(gallery.find_duplicates(v.probe, v.gallery))


@query("v7_enrol", "probe gallery", "WITH " + AS_ASKED + """
    SELECT p.query_id, p.person_id, CASE WHEN r.person_id <> p.person_id AND r.score >= 0.75 THEN 'duplicate_face'
           WHEN r.person_id = p.person_id AND r.score < 0.65 THEN 'reenroll_mismatch' ELSE 'accept' END AS decision,
           coalesce(round(r.score, 6), -2.0) AS score
    FROM probe p LEFT JOIN ranked r ON r.query_id = p.query_id AND r.rank = 1""")
def v7(v):
    return gallery.enrol(v.probe, v.gallery).select(
        "query_id", "person_id", "decision", F.coalesce(F.round("score", 6), F.lit(-2.0)).alias("score"))


@query("v8_append_gallery", "probe gallery", """
    SELECT p.school_id, coalesce((SELECT max(id) + 1 FROM gallery g WHERE g.school_id = p.school_id), 0) - 1
           + row_number() OVER (PARTITION BY p.school_id ORDER BY query_id) AS id, person_id, role,
           round(CAST(CAST(p.embedding[2] / sqrt(list_inner_product(p.embedding, p.embedding)) AS FLOAT) AS DOUBLE), 5) AS second_part, false AS deleted
    FROM probe p""")
def v8(v):
    return gallery.append_gallery(v.probe, v.gallery).select(
        "school_id", "id", "person_id", "role", F.round(F.col("embedding")[1].cast("double"), 5).alias("second_part"),
        "deleted")


@query("v9_tombstone", "gallery", """
    SELECT school_id, id, deleted OR label_of.label = 3 AS deleted
    FROM gallery JOIN (SELECT vec_id, label FROM embeddings) label_of ON label_of.vec_id = id""")
def v9(v):
    ids = v.embeddings.filter("label = 3").selectExpr("concat('S', vec_id % 4) AS school_id", "vec_id AS id")
    unknown = ids.withColumn("id", F.col("id") + 10**9)
    return gallery.tombstone(v.gallery, ids.unionByName(ids).unionByName(unknown)).select("school_id", "id", "deleted")


@query("v10_vectors_of", "probe gallery", """
    WITH asked AS (SELECT DISTINCT school_id, CASE WHEN lower(role) = 'teacher' THEN 'teacher' ELSE 'student' END AS role,
                   person_id FROM probe)
    SELECT a.school_id, a.role, a.person_id, coalesce(g.id, -1) AS id, g.id IS NULL AS missing
    FROM asked a LEFT JOIN (SELECT * FROM gallery WHERE NOT deleted) g USING (school_id, role, person_id)""")
def v10(v):
    found = gallery.vectors_of(v.probe.select("school_id", "role", "person_id"), v.gallery)
    return found.select("school_id", "role", "person_id", F.coalesce("id", F.lit(-1)).alias("id"),
                        F.col("id").isNull().alias("missing"))


@query("v10_enrolled_ids", "gallery", "SELECT DISTINCT school_id, person_id FROM gallery WHERE NOT deleted")
def v10_ids(v):
    return gallery.enrolled_ids(v.gallery)


@query("v11_verify_pairs", "probe gallery", """
    SELECT p.query_id, round(list_cosine_similarity(p.embedding, CAST(g.embedding AS DOUBLE[])), 6) AS similarity
    FROM probe p JOIN gallery g ON g.person_id = p.person_id""")
def v11(v):
    pairs = v.probe.select("query_id", "person_id", F.col("embedding").alias("probe")).join(
        v.gallery.select("person_id", F.col("embedding").alias("claimed")), "person_id")
    return gallery.verify_pairs(pairs).select("query_id", F.round("similarity", 6).alias("similarity"))


@query("io4_io5_snapshot", "gallery", """
    SELECT school_id, id, person_id, name, roll_no, role, round(CAST(CAST(embedding[1] AS FLOAT) AS DOUBLE), 4) AS first_part
    FROM gallery WHERE NOT deleted""")
def snapshot(v):
    base = fresh_path(v.spark, "gallery")
    snapshots.write_snapshot(v.gallery.withColumn("reliability", F.col("reliability").cast("float")), base, "1")
    return snapshots.read_snapshot(v.spark, base).select(
        "school_id", "id", "person_id", "name", "roll_no", "role",
        F.round(F.col("embedding")[0].cast("double"), 4).alias("first_part"))


@query("v9_ids_after_compaction", "probe gallery", """
    WITH marked AS (SELECT school_id, id, deleted OR id >= (SELECT max(id) FROM gallery) - 60 OR school_id = 'S2' AS deleted FROM gallery),
    due AS (SELECT school_id FROM marked GROUP BY school_id HAVING count(*) FILTER (WHERE deleted) >= 0.25 * count(*)),
    tops AS (SELECT school_id, max(id) + 1 AS next_id FROM marked GROUP BY school_id)
    SELECT school_id, id, deleted, 'stored' AS kind FROM marked WHERE NOT deleted OR school_id NOT IN (SELECT school_id FROM due)
    UNION ALL
    SELECT p.school_id, t.next_id - 1 + row_number() OVER (PARTITION BY p.school_id ORDER BY query_id), false, 'new'
    FROM probe p JOIN tops t USING (school_id)""")
def v9_compaction(v):
    """The last ids of every school and all of one school are deleted; compaction twice, then people are appended."""
    base = fresh_path(v.spark, "compacted")
    last = F.col("id") >= v.gallery.agg(F.max("id")).first()[0] - 60
    marked = v.gallery.withColumn("reliability", F.col("reliability").cast("float")).withColumn(
        "deleted", F.col("deleted") | last | (F.col("school_id") == "S2"))
    snapshots.write_snapshot(marked, base, "1", least_deleted=0.25)
    snapshots.write_snapshot(snapshots.read_snapshot(v.spark, base), base, "2", least_deleted=0.9)
    stored = snapshots.read_snapshot(v.spark, base)
    new = gallery.append_gallery(v.probe, stored, reserved=snapshots.reserved_ids(v.spark, base))
    return stored.select("school_id", "id", "deleted", F.lit("stored").alias("kind")).unionByName(
        new.select("school_id", "id", "deleted", F.lit("new").alias("kind")))


@query("j11_with_identity", "gallery camera_match", """
    SELECT m.event_id, g.name AS match_name, g.roll_no AS match_roll_no, g.role AS match_role
    FROM camera_match m LEFT JOIN gallery g ON g.school_id = 'S' || CAST(m.branch_id AS STRING)
     AND g.id = CAST(m.person_id AS BIGINT) * 4 + m.branch_id""")
def j11(v):
    hits = v.camera_match.selectExpr("event_id", "concat('S', branch_id) AS school_id",
                                     "CAST(person_id AS BIGINT) * 4 + branch_id AS id")
    return directory.with_identity(hits, v.gallery).select("event_id", "match_name", "match_roll_no", "match_role")
