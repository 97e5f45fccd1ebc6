import pickle

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollgrid.operators import folding, folds, presence
from rollgrid.operators.folding import ordered_fold
from rollgrid.session import task_count

times = st.lists(st.integers(0, 400), min_size=1, max_size=60).map(sorted)


def us(seconds):
    return np.array(seconds, np.int64) * folds.SECOND


def run(fold, cols, cuts=()):
    state, parts = None, []
    edges = [0, *sorted(set(cuts)), len(next(iter(cols.values())))]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            state, out = fold.step(state, {n: c[a:b] for n, c in cols.items()})
            parts.append(out)
    return {n: [v for p in parts for v in list(p[n])] for n in parts[0]}


@settings(max_examples=80, deadline=None)
@given(times, st.integers(1, 4), st.integers(1, 90), st.data())
def test_rate_limit(ts, limit, window, data):
    opened, n, want = None, 0, []
    for t in ts:
        if opened is None or t >= opened + window:
            opened, n = t, 0
        n += 1
        want.append(n <= limit)
    cuts = data.draw(st.lists(st.integers(1, len(ts)), max_size=3))
    assert run(folds.RateLimit(limit, window), {"us": us(ts)}, cuts)["allowed"] == want


@settings(max_examples=80, deadline=None)
@given(times, st.integers(1, 4), st.integers(1, 90), st.data())
def test_lockout(ts, limit, timeout, data):
    count, last, want = 0, None, []
    for t in ts:
        if last is not None and t - last >= timeout:
            count = 0
        want.append(count >= limit)
        if count < limit:
            count, last = count + 1, t
    cuts = data.draw(st.lists(st.integers(1, len(ts)), max_size=3))
    assert run(folds.Lockout(limit, timeout), {"us": us(ts)}, cuts)["blocked"] == want


@settings(max_examples=80, deadline=None)
@given(times, st.integers(1, 90), st.data())
def test_ttl_dedup(ts, ttl, data):
    last, want = None, []
    for t in ts:
        want.append(last is None or t - last >= ttl)
        last = t if want[-1] else last
    cuts = data.draw(st.lists(st.integers(1, len(ts)), max_size=3))
    assert run(folds.TtlDedup(ttl), {"us": us(ts)}, cuts)["accepted"] == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**31), st.data())
def test_replay_guard(seed, data):
    rng = np.random.default_rng(seed)
    rows = np.cumsum(rng.normal(scale=0.1, size=(40, 4)), axis=0) + 1
    last, want = None, []
    for v in rows:
        keep = last is None or v @ last / np.linalg.norm(v) / np.linalg.norm(last) < 0.995
        want.append(bool(keep))
        last = v if keep else last
    cuts = data.draw(st.lists(st.integers(1, 40), max_size=3))
    assert run(folds.ReplayGuard(), {"embedding": rows}, cuts)["kept"] == want


def test_identity_lock_story():
    persons = [1, 1, 1, 1, 1, 2, 2, 2, -1, 2, 2]
    scores = [0.9, 0.9, 0.6, 0.6, 0.7, 0.65, 0.9, 0.9, 0.9, 0.9, 0.3]
    out = run(folds.IdentityLock(), {"match_person": np.array(persons), "score": np.array(scores)}, [4])
    assert out["hits"] == list(range(1, 12))
    assert out["person"][:5] == [-1, -1, 1, 1, 1] and out["locked"][:5] == [False, False, False, True, True]
    assert out["confidence"][4] == pytest.approx(0.6 * 0.7 + 0.7 * 0.3)
    assert out["person"][5] == 1 and out["locked"][5]  # 0.65 does not beat 0.63 by a tenth
    assert out["person"][6] == 2 and not out["locked"][6]
    assert out["locked"][7] and out["person"][8] == 2  # a miss does not clear a locked track
    assert out["locked"][10] and out["person"][10] == 2


def test_lock_opens_after_thirty_updates():
    n = 60
    out = run(folds.IdentityLock(), {"match_person": np.full(n, 5), "score": np.full(n, 0.9)})
    assert out["locked"][3] and all(out["locked"][3:])  # opens at 30 updates and closes at once on a match
    out = run(folds.IdentityLock(), {"match_person": np.array([5] * 30 + [-1]), "score": np.full(31, 0.9)})
    assert out["locked"][29] and not out["locked"][30] and out["person"][30] == -1


def tick(*faces):
    return {"x": np.array([f[0] for f in faces]), "y": np.zeros(len(faces), int), "width": np.full(len(faces), 50),
            "height": np.full(len(faces), 60), "match_person": np.array([f[2] for f in faces], np.int64),
            "score": np.full(len(faces), 0.9), "embedding": np.array([f[1] for f in faces], float).reshape(len(faces), 3)}


def test_tracks():
    a, b = [1, 0, 0], [0, 1, 0]
    frames = [tick((0, a, 7)), tick((9, b, 8), (1, a, 7)), tick(), tick((2, a, 7)), tick((3, a, 7)), tick(), tick()]
    fold = folds.TrackFold(max_age=2)
    whole = run(fold, {"detections": frames})["tracks"]
    assert run(fold, {"detections": frames}, [1, 3, 4])["tracks"] == whole
    assert [[(t["track_id"], t["hits"], t["age"]) for t in rows] for rows in whole] == [
        [(0, 1, 0)], [(0, 2, 0), (1, 1, 0)], [(0, 2, 1), (1, 1, 1)], [(0, 3, 0), (1, 1, 2)], [(0, 4, 0)],
        [(0, 4, 1)], [(0, 4, 2)]]
    # Third hit searches; the fourth has the same vector and is not searched again, so nothing locks.
    assert whole[3][0]["person"] == 7 and not whole[4][0]["locked"]


def test_unlike_detections_start_tracks():
    rows = run(folds.TrackFold(), {"detections": [tick((0, [1, 0, 0], -1)), tick((0, [0.2, 1, 0], -1))]})["tracks"]
    assert [t["track_id"] for t in rows[1]] == [0, 1]


def events(spark, n=600, keys=3, seed=5, dense=False):
    rng = np.random.default_rng(seed)
    at = np.sort(rng.integers(0, 20_000, n)) if not dense else np.arange(n)
    key = np.where(rng.random(n) < 0.7, 0, rng.integers(1, keys, n))
    rows = [(int(i), f"k{k}", int(t) * folds.SECOND, [float(x) for x in rng.normal(1, 0.1, 3)])
            for i, (k, t) in enumerate(zip(key, at))]
    return spark.createDataFrame(rows, "event_id bigint, key string, us bigint, embedding array<float>")


FOLDS = {
    "rate": folds.RateLimit(3, 200), "lockout": folds.Lockout(3, 60), "ttl": folds.TtlDedup(90),
    "replay": folds.ReplayGuard(0.99), "cameras": None,
}


@pytest.mark.parametrize("name", ["rate", "lockout", "ttl", "replay"])
@pytest.mark.parametrize("dense", [False, True])
def test_hot_keys_give_the_same_result(spark, name, dense):
    rows = events(spark, 240 if dense else 600, dense=dense)
    plain = ordered_fold(rows, ["key"], ["us", "event_id"], FOLDS[name], None)
    hot = ordered_fold(rows.repartition(7), ["key"], ["us", "event_id"], FOLDS[name], 60)
    columns = [c for c in plain.columns if c != "embedding"]
    assert sorted(hot.select(columns).collect()) == sorted(plain.select(columns).collect())


@pytest.mark.parametrize("dense, seconds", [(False, 30), (True, 1), (True, 700)])
def test_openings_of_hot_keys(spark, dense, seconds):
    rows = events(spark, 240 if dense else 600, dense=dense).drop("embedding")
    same_time = rows.filter("event_id % 5 = 0").withColumn("event_id", F.col("event_id") + 10_000)
    rows = rows.unionByName(same_time)
    for run_it in (lambda hot: presence.dedup_ttl(rows, ["key"], seconds, hot), lambda hot: presence.rate_limit(rows, ["key"], 3, seconds, hot)):
        plain = run_it(None)
        assert sorted(run_it(60).select(plain.columns).collect()) == sorted(plain.collect())


def test_null_outputs_keep_types(spark):
    rows = events(spark, 50)
    out = presence.dedup_ttl(rows, ["key"], 10)
    assert dict(out.dtypes)["event_id"] == "bigint" and dict(out.dtypes)["accepted"] == "boolean"
    assert presence.dedup_ttl(rows.filter("false"), ["key"], 10).count() == 0


@pytest.mark.parametrize("bucket", [None, 25])
def test_quorum_equals_brute_force(spark, bucket):
    rng = np.random.default_rng(9)
    rows = [(int(i), 1, f"p{rng.integers(0, 2)}", int(rng.integers(0, 5)), int(rng.integers(0, 400)) * folds.SECOND)
            for i in range(300)]
    matches = spark.createDataFrame(rows, "event_id bigint, branch_id bigint, person_id string, camera_id bigint, us bigint")
    cameras = spark.createDataFrame([(i, 1, i != 4) for i in range(5)], "id bigint, branch_id bigint, active boolean")
    got = presence.camera_quorum(matches, cameras, 10, bucket_s=bucket).collect()
    assert len(got) == len(rows)
    for r in got:
        seen = {m[3] for m in rows if m[2] == r.person_id and r.us - 10 * folds.SECOND <= m[4] <= r.us}
        assert (r.n_cameras, r.required, r.quorum) == (len(seen), 4, len(seen) >= 4)


def test_scans(spark):
    s = folds.SECOND
    sessions = spark.createDataFrame([("a", 20 * s, 5, False), ("b", 20 * s, 5, True)],
                                     "code string, expires_us bigint, grace_seconds int, used boolean")
    scans = spark.createDataFrame([(1, "a", 24 * s), (2, "a", 10 * s), (3, "a", 26 * s), (4, "b", 1 * s), (5, "c", 1 * s)],
                                  "event_id bigint, code string, us bigint")
    got = {r.event_id: r.verdict for r in presence.validate_scans(scans, sessions).collect()}
    assert got == {1: "used", 2: "ok", 3: "used", 4: "used", 5: "not_found"}
    late = presence.validate_scans(scans.filter("event_id = 3"), sessions).first()
    assert late.verdict == "expired"


def handed_over(fold, cols, cuts):
    """The fold over chunks whose entry states come from the tables of the chunks before, as pickles."""
    state, parts = None, []
    edges = [0, *sorted(set(cuts)), len(cols["us"])]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            part = {n: cols[n][a:b] for n in fold.inputs}
            parts.append(fold.step(state, part)[1])
            state = pickle.loads(pickle.dumps(fold.summary(part)))(state)
    return {n: [v for p in parts for v in list(p[n])] for n in parts[0]}


@settings(max_examples=200, deadline=None)
@given(times, st.integers(1, 4), st.integers(1, 90), st.data())
def test_lockout_summary(ts, limit, timeout, data):
    cuts = data.draw(st.lists(st.integers(1, len(ts)), max_size=9))
    fold = folds.Lockout(limit, timeout)
    assert handed_over(fold, {"us": us(ts)}, cuts) == run(fold, {"us": us(ts)})


@settings(max_examples=200, deadline=None)
@given(times, st.integers(1, 4), st.integers(1, 90), st.data())
def test_window_summaries(ts, limit, window, data):
    cuts = data.draw(st.lists(st.integers(1, len(ts)), max_size=9))
    for fold in (folds.RateLimit(limit, window), folds.TtlDedup(window)):
        assert handed_over(fold, {"us": us(ts)}, cuts) == run(fold, {"us": us(ts)})


@settings(max_examples=200, deadline=None)
@given(times, st.integers(1, 4), st.integers(1, 60), st.integers(0, 60), st.data())
def test_verification_summary(ts, limit, window, longer, data):
    inside = np.array(data.draw(st.lists(st.booleans(), min_size=len(ts), max_size=len(ts))))
    cuts = data.draw(st.lists(st.integers(1, len(ts)), max_size=9))
    fold, cols = folds.Verification(window + longer, limit, window), {"us": us(ts), "inside": inside}
    assert handed_over(fold, cols, cuts) == run(fold, {n: cols[n] for n in fold.inputs})
    assert not folds.Verification(window, limit, window + 1).summarised()  # goes by guessed states


def test_hot_bursts_whose_past_reaches_far(spark, monkeypatch):
    """Full windows from end to end, most rows within seconds; no round runs a chunk again."""
    rng = np.random.default_rng(2)
    at = np.sort(np.r_[rng.integers(0, 50, 300), rng.integers(0, 40_000, 200), rng.integers(30_000, 30_010, 200)])
    rows = [(i, k, int(t) * folds.SECOND, bool(rng.random() < 0.2)) for k in ("a", "b") for i, t in enumerate(at)] + [(0, "cold", 5, True)]
    df = spark.createDataFrame(rows, "event_id bigint, key string, us bigint, inside boolean")
    monkeypatch.setattr("rollgrid.operators.folding._settle_entries", None)  # must not be needed
    for fold in (folds.RateLimit(4, 3000), folds.TtlDedup(7000), folds.Lockout(3, 700), folds.Lockout(1, 9000), folds.Verification(5000, 2, 600), folds.Verification(60, 5, 60)):
        hot = ordered_fold(df, ["key"], ["us", "event_id"], fold, hot_rows=17)
        cold = ordered_fold(df, ["key"], ["us", "event_id"], fold, hot_rows=None)
        assert sorted(map(repr, hot.collect())) == sorted(map(repr, cold.collect()))


def test_ranges_of_hot_keys_do_not_follow_the_limit(spark):
    """A low limit on a large table asks for no more tasks than the session can use."""
    df = spark.range(6000).selectExpr("id AS event_id", "concat('k', id % 100) AS key", "id * 7000000 AS us")
    hot = folding.hot_keys(df, ["key"], "us", 5)
    rows = folding._chunked(df, hot, ["key"], "us", 5)
    assert rows.count() == 6000
    assert 1 < rows.select(folding.CHUNK).distinct().count() <= folding.RANGES_PER_TASK * task_count(spark)
    assert rows.groupBy("key", "us").agg(F.count_distinct(folding.CHUNK).alias("n")).where("n > 1").isEmpty()


def test_rows_of_hot_keys_stay_where_they_are_until_they_are_folded(spark):
    """Only keys and times are dealt in ranges; just the keys that a bound cuts have chunks, at most one a range."""
    df = spark.range(6000).selectExpr("id AS event_id", "concat('k', id % 100) AS key", "id * 7000000 AS us", "array(CAST(1 AS DOUBLE), sin(id)) AS embedding")
    rows = folding._chunked(df, folding.hot_keys(df, ["key"], "us", 5), ["key"], "us", 5)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert not any(x in plan for x in ("Exchange hashpartitioning", "Exchange rangepartitioning", "ExistingRDD"))
    cut = rows.where(F.col(folding.CHUNK).isNotNull()).select("key").distinct().count()
    assert 0 < cut <= folding.RANGES_PER_TASK * task_count(spark)
    plain, hot = (presence.replay_guard(df, ["key"], 0.9, n).select("event_id", "kept").collect() for n in (None, 5))
    assert len(hot) == 6000 and sorted(hot) == sorted(plain)


def test_only_new_vectors_of_a_frame_are_scaled(monkeypatch):
    """A live track keeps its unit vector; a frame costs what its own detections cost."""
    scaled = []
    plain = folds.unit_rows
    monkeypatch.setattr(folds, "unit_rows", lambda rows: scaled.append(len(rows)) or plain(rows))
    eye = np.eye(40)

    def frame(vectors):
        n = len(vectors)
        return {**{c: np.arange(n) for c in folds.BOX}, "match_person": np.full(n, -1), "score": np.zeros(n), "embedding": vectors}

    _, out = folds.TrackFold().step(None, {"detections": [frame(eye), frame(eye[:1]), frame(eye[5:7])]})
    assert scaled == [40, 1, 2] and out["tracks"].counts == [40, 40, 40]
    seen = [[t["track_id"] for t in row if t["seen"]] for row in out["tracks"]]
    assert seen == [list(range(40)), [0], [5, 6]]


def test_frames_with_vectors_of_other_lengths_start_tracks():
    short, long = [np.ones(3)], [np.ones(5), np.ones(3)]
    frame = lambda vectors: {**{c: np.arange(len(vectors)) for c in folds.BOX}, "match_person": np.full(len(vectors), -1),
                             "score": np.zeros(len(vectors)), "embedding": vectors}
    _, out = folds.TrackFold().step(None, {"detections": [frame(short), frame(long), frame(np.ones((1, 5)))]})
    assert [[(t["track_id"], t["hits"]) for t in row if t["seen"]] for row in out["tracks"]] == [[(0, 1)], [(0, 2), (1, 1)], [(1, 2)]]
