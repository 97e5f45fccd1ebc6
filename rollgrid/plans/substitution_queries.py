"""Substitution queries. Staff are the customers, their bookings the orders."""

from pyspark.sql import functions as F

from rollgrid.functions.text_vectors import hash_vector
from rollgrid.functions.vectors import l2_norm
from rollgrid.operators import substitution
from rollgrid.operators.bookings import has_odd
from rollgrid.plans.registry import query


def absences(v):
    """Every staff member is absent on the days of their finished orders."""
    days = v.orders.filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("absent_id"), F.to_date("o_orderdate").alias("date")).distinct()
    org = v.staff.select(F.col("id").alias("absent_id"), "organization_id")
    return days.join(org, "absent_id")


def practice_similarity(v):
    """Similarity from practice: mean size of a person's orders of that priority."""
    org = v.staff.select(F.col("id").alias("teacher_id"), "organization_id")
    return v.orders.groupBy(F.col("o_custkey").alias("teacher_id"), F.col("o_orderpriority").alias("subject")).agg(
        F.round(F.avg("o_totalprice") / 600000, 6).alias("similarity")).join(org, "teacher_id")


def vector_sql(text):
    """``hash_vector(text, 32)`` in SQL."""
    number = "('0x' || substr(md5({0}), 1, 8))::BIGINT".format
    padded = f"('  ' || lower(coalesce({text}, '')) || ' ')"
    grams = f"list_transform(range(1, length({padded}) - 1), lambda i: {number(f'substr({padded}, i, 3)')})"
    parts = f"""list_transform(range(0, 32), lambda d: CASE WHEN {number(padded)} % 32 = d THEN 0.5 ELSE 0.0 END + coalesce(list_sum(
        list_transform(list_filter({grams}, lambda h: h % 32 = d), lambda h: CASE WHEN (h // 32) % 2 = 0 THEN 1.0 ELSE -1.0 END)), 0.0))"""
    return f"list_transform([{parts}], lambda v: list_transform(v, lambda x: (x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::FLOAT))[1]"


PRACTICE_SQL = """sim AS (SELECT s.organization_id, o.o_custkey AS teacher_id, o.o_orderpriority AS subject,
                   round(avg(o.o_totalprice) / 600000, 6) AS similarity FROM orders o JOIN staff s ON s.id = o.o_custkey
            GROUP BY ALL),"""
DECLARED_SQL = f"""declared AS (SELECT organization_id, id AS teacher_id, unnest(subjects) AS declared FROM staff),
    texts AS (SELECT text, {vector_sql("text")} AS vector FROM (SELECT DISTINCT subject AS text FROM periods UNION SELECT declared FROM declared)),
    near AS (SELECT a.text AS wanted, b.text AS declared, round(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]), 9) AS similarity
             FROM texts a, texts b),
    sim AS (SELECT p.organization_id, d.teacher_id, p.subject, max(n.similarity) AS similarity
            FROM (SELECT DISTINCT organization_id, subject FROM periods) p JOIN declared d ON d.organization_id = p.organization_id
            JOIN near n ON n.wanted = p.subject AND n.declared = d.declared GROUP BY ALL),"""


def free_sql(sim):
    return """gone AS (SELECT DISTINCT o_custkey AS absent_id, CAST(o_orderdate AS DATE) AS date FROM orders
                  WHERE o_orderstatus = 'F'),
    periods AS (SELECT s.organization_id, g.absent_id, g.date, b.id AS booking_id, b.day_of_week, b.subject, b.start_min, b.end_min
                FROM gone g JOIN staff s ON s.id = g.absent_id
                JOIN staff_booking b ON b.teacher_id = g.absent_id AND b.day_of_week = dayname(g.date)),
    """ + sim + """
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY organization_id, subject
                                     ORDER BY similarity DESC, teacher_id) AS r FROM sim) WHERE r <= 30),
    free AS (SELECT p.*, t.teacher_id, t.similarity, coalesce(s.reliability_score, 0.8) AS reliability,
                    coalesce(s.reliability_score, 0.8) * t.similarity / (1 + ln(greatest(s.workload_score, 1))) AS score
             FROM periods p JOIN top t USING (organization_id, subject) JOIN staff s ON s.id = t.teacher_id
             WHERE t.teacher_id <> p.absent_id AND NOT EXISTS (SELECT 1 FROM staff_booking b WHERE b.teacher_id = t.teacher_id
                   AND b.day_of_week = p.day_of_week AND p.start_min < b.end_min AND p.end_min > b.start_min))"""

def _walk(name, keep):
    """A plan grows by one period a step: the six best people who are free in it, ranked by what they are worth with its counts."""
    return f"""{name} AS (
        SELECT DISTINCT organization_id, absent_id, date, CAST(0 AS BIGINT) AS i, n, CAST(0 AS DOUBLE) AS total, CAST([] AS BIGINT[]) AS ranks,
               CAST([] AS STRUCT(b BIGINT, s INT, e INT, t BIGINT, similarity DOUBLE, reliability DOUBLE, workload INT, gain DOUBLE)[]) AS plan
        FROM numbered
        UNION ALL
        SELECT organization_id, absent_id, date, i, n, total, ranks, plan FROM (
            SELECT *, row_number() OVER (PARTITION BY absent_id, date ORDER BY round(total, 9) DESC, ranks) AS kept FROM (
                SELECT organization_id, absent_id, date, i, n, total + worth / (1 + ln(times + 1)) AS total, list_append(ranks, r) AS ranks,
                       later, known, list_append(plan, {{'b': booking_id, 's': start_min, 'e': end_min, 't': teacher_id,
                           'similarity': similarity, 'reliability': reliability, 'workload': CAST(times + 1 AS INT),
                           'gain': worth / (1 + ln(times + 1))}}) AS plan
                FROM (SELECT *, row_number() OVER (PARTITION BY absent_id, date, ranks
                             ORDER BY worth / (1 + ln(greatest(times, 1))) DESC, teacher_id) AS r
                      FROM (SELECT w.organization_id, w.absent_id, w.date, o.i, w.n, w.total, w.ranks, w.plan, o.booking_id, o.start_min,
                                   o.end_min, o.teacher_id, o.similarity, o.reliability, o.worth, o.later, o.known,
                                   len(list_filter(w.plan, lambda x: x.t = o.teacher_id)) AS times,
                                   len(list_filter(w.plan, lambda x: x.t = o.teacher_id AND o.start_min < x.e AND o.end_min > x.s)) AS busy
                            FROM {name} w JOIN {name}_offers o ON o.absent_id = w.absent_id AND o.date = w.date AND o.i = w.i + 1)
                      WHERE busy = 0) WHERE r <= 6)) WHERE {keep}),
    {name}_best AS (SELECT *, row_number() OVER (PARTITION BY absent_id, date ORDER BY round(total, 9) DESC, ranks) AS place
                    FROM {name} WHERE i = n)"""


def beam_sql(sim):
    return "WITH RECURSIVE " + free_sql(sim) + """,
    numbered AS (SELECT *, row_number() OVER (PARTITION BY absent_id, date ORDER BY start_min, end_min, booking_id) AS i,
                        count(*) OVER (PARTITION BY absent_id, date) AS n FROM periods),
    offers AS (SELECT m.i, f.*, similarity * reliability AS worth FROM free f JOIN numbered m USING (absent_id, date, booking_id)),
    beam_offers AS (SELECT *, 0.0 AS later, 0.0 AS known FROM offers),""" + _walk("beam", f"kept <= {substitution.BEAM_WIDTH}")

# All plans, but for those that cannot reach the plan of the beam: what later periods add is at most their best worth.
BEST_SQL = beam_sql(PRACTICE_SQL) + """,
    best_worth AS (SELECT absent_id, date, i, max(worth) AS most FROM offers GROUP BY ALL),
    ahead AS (SELECT absent_id, date, i, coalesce(sum(most) OVER (PARTITION BY absent_id, date ORDER BY i
                     ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM best_worth),
    exact_offers AS (SELECT o.*, a.later, coalesce(b.total, -1) AS known FROM offers o JOIN ahead a USING (absent_id, date, i)
                     LEFT JOIN (SELECT * FROM beam_best WHERE place = 1) b USING (absent_id, date)),""" + _walk(
    "exact", "total + later >= known - 1e-8")

CHOSEN_SQL = """
    SELECT organization_id, absent_id, CAST(date AS STRING) AS date, p.b AS booking_id, p.s AS start_min, p.e AS end_min, p.t AS teacher_id,
           round(p.similarity, 6) AS similarity, p.reliability, p.workload, round(p.gain, 6) AS gain
    FROM (SELECT organization_id, absent_id, date, unnest(plan) AS p FROM {name}_best WHERE place = 1)"""


@query("h1_rank_candidates", "staff staff_booking", "WITH " + free_sql(PRACTICE_SQL) + """,
    ranked AS (SELECT *, row_number() OVER (PARTITION BY date, booking_id ORDER BY score DESC, teacher_id) AS rank FROM free)
    SELECT CAST(date AS STRING) AS date, booking_id, teacher_id, round(score, 6) AS score, CAST(rank AS INT) AS rank
    FROM ranked WHERE rank <= 6""")
def h1(v):
    periods = substitution.open_periods(absences(v), v.staff_booking)
    ranked = substitution.rank_candidates(
        periods, v.staff, practice_similarity(v), v.staff_booking, odd_periods=has_odd(v.staff_booking))
    return ranked.select(F.col("date").cast("string").alias("date"), "booking_id", "teacher_id", F.round("score", 6).alias("score"), "rank")


def _plan(v, search):
    periods = substitution.open_periods(absences(v), v.staff_booking)
    return _rounded(search(substitution.offers(
        periods, v.staff, practice_similarity(v), v.staff_booking, best_first="worth", odd_periods=has_odd(v.staff_booking))))


def _rounded(plans):
    return plans.withColumns({"date": F.col("date").cast("string"), "similarity": F.round("similarity", 6), "gain": F.round("gain", 6)})


@query("h2_assign_optimal", "staff staff_booking", BEST_SQL + CHOSEN_SQL.format(name="exact"))
def h2(v):
    return _plan(v, substitution.assign_optimal)


@query("h3_assign_beam", "staff staff_booking", beam_sql(PRACTICE_SQL) + CHOSEN_SQL.format(name="beam"))
def h3(v):
    return _plan(v, substitution.assign_beam)


@query("h4_plan_substitutions", "staff staff_booking",
       beam_sql(DECLARED_SQL) + f", chosen AS ({CHOSEN_SQL.format(name='beam')})"
       + " SELECT c.*, s.name AS teacher_name FROM chosen c JOIN staff s ON s.id = c.teacher_id")
def h4(v):
    return _rounded(substitution.plan_substitutions(absences(v), v.staff_booking, v.staff))


@query("v12_hash_embed", "", f"""
    WITH made AS (SELECT text, {vector_sql("text")} AS vector FROM (SELECT DISTINCT p_name || ' ' || p_type AS text FROM part))
    SELECT text, CAST(32 AS INT) AS dim, round(sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE * x))), 5) AS norm,
           round(vector[1]::DOUBLE, 5) AS first_part, round(list_sum(list_transform(vector, lambda x, i: x::DOUBLE * i)), 4) AS weighted FROM made""")
def v12(v):
    texts = v.part.select(F.concat_ws(" ", "p_name", "p_type").alias("text")).distinct()
    made = texts.withColumn("vector", hash_vector(F.col("text"), 32))
    return made.select("text", F.size("vector").alias("dim"), F.round(l2_norm(F.col("vector")), 5).alias("norm"),
                       F.round(F.col("vector")[0].cast("double"), 5).alias("first_part"),
                       F.round(F.aggregate(F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4)
                       .alias("weighted"))
