"""Step functions of the ordered operators.

Times are microseconds. Steps jump from decision to decision with binary search or matrix products
where they can; only the short state machines look at every row.
"""

from __future__ import annotations

import numpy as np

from rollgrid.functions.assignment import assign
from rollgrid.functions.vectors import NORM_FLOOR, cosine_block, unit_rows
from rollgrid.operators.folding import Fold, Ragged

SECOND = 1_000_000
# Fixed values: (limit, window in seconds) of the known rate limits.
ENDPOINT_LIMIT, CAMERA_LIMIT, ATTEMPT_LIMIT = (10, 10), (30, 1), (5, 60)
LOGIN_LIMIT = (5, 300)
MARK_TTL_S = 1800
REPLAY_AT, SEARCH_AGAIN_BELOW = 0.995, 0.992


class Runs:
    """What a chunk makes of a state that has run out, by the event at which a new run starts.

    ``next_start[i]`` is the first event after the run from event i (the number of events if the run outlasts the chunk).
    Runs follow one another, so the last one from any start is found by doubling the links.
    """

    def __init__(self, us: np.ndarray, next_start: np.ndarray):
        inside = next_start < len(us)
        self.last = np.where(inside, next_start, np.arange(len(us)))
        while not np.array_equal(further := self.last[self.last], self.last):
            self.last = further

    def pieces(self, us: np.ndarray, until: int) -> tuple[np.ndarray, np.ndarray]:
        """(times, last runs): a run that starts at the first event at or after t ends in the last run of the first piece whose
        time is at least t. For t up to the first event at or after ``until``."""
        reach = min(int(np.searchsorted(us, until)) + 1, len(us))
        first = np.flatnonzero(np.r_[True, us[1:reach] != us[: reach - 1]])  # of events at one time the first starts a run
        ends = np.flatnonzero(np.r_[self.last[first][1:] != self.last[first][:-1], True])
        return us[first[ends]], self.last[first[ends]]


class Pieces:
    """A step function from a time to a state; beyond the last time it has no value."""

    def __init__(self, times: np.ndarray, states: list[tuple]):
        self.times, self.states = times, states

    def at(self, time: int) -> tuple | None:
        k = int(np.searchsorted(self.times, time))
        return self.states[k] if k < len(self.states) else None


class WindowTable:
    """State after a chunk for a state before it, where windows of one length open at the first event after the last one closed."""

    def __init__(self, us: np.ndarray, window: int, state_of):
        self.window, self.begin, self.end, self.n = window, int(us[0]), int(us[-1]), len(us)
        times, starts = Runs(us, np.searchsorted(us, us + window)).pieces(us, self.begin + window)
        self.fresh = Pieces(times, [state_of(int(us[i]), self.n - int(i)) for i in starts])

    def __call__(self, state):
        closes = state[0] + self.window if state else self.begin
        if closes > self.end:
            return (state[0], *(seen + self.n for seen in state[1:]))
        return self.fresh.at(max(closes, self.begin))


class RateLimit(Fold):
    """A window opens with the first event after the last one closed; event n in it passes iff n ≤ limit."""

    inputs = ("us",)
    output = "nth BIGINT, allowed BOOLEAN"

    def __init__(self, limit: int, window_s: float):
        self.limit, self.window = limit, int(window_s * SECOND)

    def step(self, state, cols):
        us = cols["us"]
        opened, seen = state or (None, 0)
        nth = np.empty(len(us), np.int64)
        i = 0
        while i < len(us):
            if opened is None or us[i] >= opened + self.window:
                opened, seen = int(us[i]), 0
            j = i + int(np.searchsorted(us[i:], opened + self.window))
            nth[i:j] = seen + np.arange(1, j - i + 1)
            seen, i = seen + j - i, j
        return (opened, seen), {"nth": nth, "allowed": nth <= self.limit}

    def forget_at(self, state):
        return state[0] + self.window

    def summarised(self):
        return self.window > 0

    def summary(self, cols):
        return WindowTable(cols["us"], self.window, lambda start, seen: (start, seen))


class Lockout(Fold):
    """Counted attempts restart the timer; at the limit further ones are blocked and do not."""

    inputs = ("us",)
    output = "attempts INT, blocked BOOLEAN"

    def __init__(self, limit: int, timeout_s: float):
        self.limit, self.timeout = limit, int(timeout_s * SECOND)

    def step(self, state, cols):
        count, last = state or (0, None)
        attempts, blocked = [], []
        for us in cols["us"].tolist():
            if last is not None and us - last >= self.timeout:
                count = 0
            stop = count >= self.limit
            if not stop:
                count, last = count + 1, us
            attempts.append(count)
            blocked.append(stop)
        return (count, last), {"attempts": np.array(attempts, np.int32), "blocked": np.array(blocked, bool)}

    def forget_at(self, state):
        return state[1] + self.timeout

    def summarised(self):
        return self.limit > 0

    def summary(self, cols):
        us, n = cols["us"], len(cols["us"])
        pauses = np.flatnonzero(np.diff(us) >= self.timeout) + 1  # events that come long after the one before
        pause = np.r_[pauses, n][np.searchsorted(pauses, np.arange(n), side="right")]
        last = np.minimum(np.arange(n) + self.limit, pause) - 1  # the last event that the run from each event counts
        runs = Runs(us, np.searchsorted(us, us[last] + self.timeout))
        left = lambda i: (int(last[i] - i + 1), int(us[last[i]]))  # noqa: E731  state that the run from event i leaves
        times, ends = runs.pieces(us, int(us[0]) + self.timeout)
        fresh, counting = Pieces(times, [left(i) for i in ends]), []
        for count in range(1, self.limit):  # a run that is under way when the chunk begins
            stop = min(self.limit - count, int(pause[0])) - 1
            after = int(np.searchsorted(us, us[stop] + self.timeout))
            counting.append(left(runs.last[after]) if after < n else (count + stop + 1, int(us[stop])))
        return LockoutTable(self.limit, self.timeout, int(us[0]), int(us[-1]), fresh, counting)


class LockoutTable:
    """State after a chunk for a state before it: the lock runs out at some event, or a run goes on, or nothing is left."""

    def __init__(self, limit: int, timeout: int, first: int, end: int, fresh: Pieces, counting: list[tuple]):
        self.limit, self.timeout, self.first, self.end, self.fresh, self.counting = limit, timeout, first, end, fresh, counting

    def __call__(self, state):
        count, last = state or (0, None)
        if not count or self.first - last >= self.timeout:
            return self.fresh.at(self.first)
        if count < self.limit:
            return self.counting[count - 1]
        return state if last + self.timeout > self.end else self.fresh.at(last + self.timeout)


class TtlDedup(Fold):
    """An event passes iff no *passed* event of its key lies less than ``ttl_s`` back."""

    inputs = ("us",)
    output = "accepted BOOLEAN"

    def __init__(self, ttl_s: float = MARK_TTL_S):
        self.ttl = int(ttl_s * SECOND)

    def step(self, state, cols):
        us = cols["us"]
        last = state[0] if state else None
        accepted = np.zeros(len(us), bool)
        i = 0 if last is None else int(np.searchsorted(us, last + self.ttl))
        while i < len(us):
            accepted[i], last = True, int(us[i])
            i += int(np.searchsorted(us[i:], last + self.ttl))
        return (last,), {"accepted": accepted}

    def forget_at(self, state):
        return state[0] + self.ttl

    def summarised(self):
        return self.ttl > 0

    def summary(self, cols):
        return WindowTable(cols["us"], self.ttl, lambda start, seen: (start,))


def _cosines(vector: np.ndarray, block: np.ndarray) -> np.ndarray:
    norms = np.maximum(np.sqrt(np.einsum("ij,ij->i", block, block)), NORM_FLOOR)
    return block @ vector / (norms * max(np.sqrt(vector @ vector), NORM_FLOOR))


class ReplayGuard(Fold):
    """A vector is dropped iff its cosine with the last *kept* vector reaches the threshold."""

    inputs = ("embedding",)
    output = "kept BOOLEAN"
    STEP = 256

    def __init__(self, threshold: float = REPLAY_AT):
        self.threshold = threshold

    def step(self, state, cols):
        rows = cols["embedding"]
        if not isinstance(rows, np.ndarray):
            raise ValueError("vectors of one batch must have one length")
        kept = np.zeros(len(rows), bool)
        last, i = (np.frombuffer(state[0]) if state else None), 0
        if last is None and len(rows):
            kept[0], last, i = True, rows[0], 1
        while i < len(rows):
            block = rows[i : i + self.STEP]
            fresh = np.flatnonzero(_cosines(last, block) < self.threshold)
            if len(fresh):
                i += int(fresh[0])
                kept[i], last = True, rows[i]
                i += 1
            else:
                i += len(block)
        return (last.tobytes(),) if last is not None else None, {"kept": kept}


# Fixed values of the identity lock.
MIN_HITS, LOCK_SCORE, UNLOCK_AFTER, OVERRULE_BY = 3, 0.55, 30, 0.10
FREE_WEIGHT, LOCKED_WEIGHT = 0.4, 0.3
NOBODY = -1


class Identity:
    """Identity state of one track."""

    __slots__ = ("hits", "updates", "person", "confidence", "locked")

    def __init__(self, hits=0, updates=0, person=NOBODY, confidence=0.0, locked=False):
        self.hits, self.updates, self.person = hits, updates, person
        self.confidence, self.locked = confidence, locked

    def state(self) -> tuple:
        return self.hits, self.updates, self.person, self.confidence, self.locked

    def seen(self) -> None:
        """One more frame. The first is no update; a lock opens after enough updates."""
        self.hits += 1
        if self.hits > 1:
            self.updates += 1
        if self.locked and self.updates >= UNLOCK_AFTER:
            self.locked, self.updates = False, 0

    def resolve(self, person: int, score: float) -> None:
        """Result of a search; counts only once the track is old enough."""
        if self.hits < MIN_HITS:
            return
        same = person == self.person
        if person == NOBODY or not score >= LOCK_SCORE:
            if not self.locked:
                self.person, self.confidence = NOBODY, 0.0
        elif same:
            weight = LOCKED_WEIGHT if self.locked else FREE_WEIGHT
            self.confidence = self.confidence * (1 - weight) + score * weight
            self.locked = self.locked or self.confidence >= LOCK_SCORE
        elif not self.locked:
            self.person, self.confidence = person, score
        elif score > self.confidence + OVERRULE_BY:
            self.person, self.confidence, self.locked = person, score, False


class IdentityLock(Fold):
    """Identity per track update from the match (``match_person``, −1 for none) and its ``score``."""

    inputs = ("match_person", "score")
    output = "hits INT, person BIGINT, confidence DOUBLE, locked BOOLEAN"

    def step(self, state, cols):
        track = Identity(*state) if state else Identity()
        out = []
        for person, score in zip(cols["match_person"].tolist(), cols["score"].tolist()):
            track.seen()
            track.resolve(person, score)
            out.append((track.hits, track.person, track.confidence, track.locked))
        hits, person, confidence, locked = zip(*out)
        return track.state(), {
            "hits": np.array(hits, np.int32), "person": np.array(person, np.int64),
            "confidence": np.array(confidence), "locked": np.array(locked, bool),
        }


class Verification(Fold):
    """``already_marked`` → ``too_many_attempts`` → ``wrong_location`` → ``marked``, in that order.

    Only ``marked`` restarts the mark timer; ``already_marked`` uses up no attempt.
    """

    inputs = ("us", "inside")
    output = "status STRING"

    def __init__(self, ttl_s: float = MARK_TTL_S, limit: int = ATTEMPT_LIMIT[0], window_s: float = ATTEMPT_LIMIT[1]):
        self.ttl, self.limit, self.window = int(ttl_s * SECOND), limit, int(window_s * SECOND)

    def step(self, state, cols):
        marked, opened, tries = state or (None, None, 0)
        status = []
        for us, inside in zip(cols["us"].tolist(), cols["inside"].tolist()):
            if marked is not None and us - marked < self.ttl:
                status.append("already_marked")
                continue
            if opened is None or us >= opened + self.window:
                opened, tries = us, 0
            tries += 1
            if tries > self.limit:
                status.append("too_many_attempts")
            elif not inside:
                status.append("wrong_location")
            else:
                marked = us
                status.append("marked")
        return (marked, opened, tries), {"status": status}

    def summarised(self):
        """A mark must outlast the attempt window it was made in."""
        return self.limit > 0 and self.ttl >= self.window

    def summary(self, cols):
        us, n = cols["us"], len(cols["us"])
        at, inside = np.arange(n), np.flatnonzero(cols["inside"])
        closes = np.searchsorted(us, us + self.window)
        marks = np.r_[inside, n][np.searchsorted(inside, at)]  # first event inside, from each event on
        marked = marks < np.minimum(np.minimum(at + self.limit, closes), n)
        follows = np.where(marked, np.searchsorted(us, us[np.minimum(marks, n - 1)] + self.ttl), closes)
        runs = Runs(us, follows)

        def left(i):
            return (int(us[marks[i]]), int(us[i]), int(marks[i] - i + 1)) if marked[i] else (None, int(us[i]), int(min(closes[i], n) - i))

        times, ends = runs.pieces(us, int(us[0]) + self.ttl)
        first, settled = int(marks[0]), None
        if first < min(self.limit, n):  # what follows if the first event inside marks
            after = int(np.searchsorted(us, us[first] + self.ttl))
            settled = left(runs.last[after]) if after < n else (int(us[first]), int(us[first]), 0)
        return VerificationTable(self, us, first, settled, Pieces(times, [left(i) for i in ends]))

    def forget_at(self, state):
        marked, opened, _ = state
        ends = [t + span for t, span in ((marked, self.ttl), (opened, self.window)) if t is not None]
        return max(ends)


class VerificationTable:
    """State after a chunk for a state before it: a live mark runs out, an attempt window goes on, or nothing is left."""

    def __init__(self, fold: Verification, us: np.ndarray, first: int, settled: tuple | None, fresh: Pieces):
        self.ttl, self.limit, self.window = fold.ttl, fold.limit, fold.window
        self.begin, self.end, self.n = int(us[0]), int(us[-1]), len(us)
        self.first, self.settled, self.fresh = first, settled, fresh
        self.first_us = int(us[first]) if first < self.n else None

    def __call__(self, state):
        marked, opened, tries = state or (None, None, 0)
        if marked is not None and self.begin - marked < self.ttl:
            return state if marked + self.ttl > self.end else self.fresh.at(marked + self.ttl)
        if opened is None or self.begin >= opened + self.window:
            return self.fresh.at(self.begin)
        if self.settled is not None and self.first < self.limit - tries and self.first_us < opened + self.window:
            return self.settled
        return (None, opened, tries + self.n) if opened + self.window > self.end else self.fresh.at(opened + self.window)


class FirstOnly(Fold):
    """True for the first row of a key. ``period_s``: the key names a period of that length (a day)."""

    inputs = ("us",)
    output = "is_first BOOLEAN"

    def __init__(self, period_s: int | None = None):
        self.period = period_s and period_s * SECOND

    def step(self, state, cols):
        first = np.zeros(len(cols["us"]), bool)
        first[:1] = state is None
        return state or (int(cols["us"][0]),), {"is_first": first}

    def forget_at(self, state):
        return (state[0] // self.period + 1) * self.period if self.period else None


class CodeUse(Fold):
    """Verdict of each scan of a code: the first in time of an unused session consumes it.

    ``until`` is the last time at which the session is known; afterwards the state is not asked again.
    """

    inputs = ("found", "used", "in_time", "until")
    output = "verdict STRING"

    def step(self, state, cols):
        verdicts = []
        for found, used, in_time, until in zip(*(cols[c].tolist() for c in self.inputs)):
            if not found:
                verdicts.append("not_found")
            elif used or state:
                verdicts.append("used")
            elif in_time:
                state = (int(until),)
                verdicts.append("ok")
            else:
                verdicts.append("expired")
        return state, {"verdict": verdicts}

    def forget_at(self, state):
        return state[0] + 1


class CameraCount(Fold):
    """Distinct cameras among the rows of the last ``window_s`` seconds, this row included."""

    inputs = ("us", "camera_id")
    output = "n_cameras BIGINT"

    def __init__(self, window_s: float):
        self.window = int(window_s * SECOND)

    def step(self, state, cols):
        last = dict(state or ())
        counts = []
        for us, camera in zip(cols["us"].tolist(), cols["camera_id"].tolist()):
            last.pop(camera, None)
            last[camera] = us
            while last and next(iter(last.values())) < us - self.window:
                del last[next(iter(last))]
            counts.append(len(last))
        return tuple(last.items()), {"n_cameras": np.array(counts, np.int64)}

    def forget_at(self, state):
        return state[-1][1] + self.window + 1


# Fixed values of the tracker.
MAX_AGE, MIN_TRACK_SIMILARITY = 30, 0.35
BOX = ("x", "y", "width", "height")


class Track:
    """One live track: where it was last, what it looked like, and who it is."""

    __slots__ = ("number", "box", "vector", "unit", "age", "identity", "searched")

    def __init__(self, number, box, vector, age=0, identity=(), searched=None, unit=None):
        self.number, self.box, self.vector, self.age = number, box, vector, age
        self.unit = unit_rows(vector[None, :])[0] if unit is None else unit
        self.identity, self.searched = Identity(*identity), searched

    def state(self) -> tuple:
        return (self.number, self.box, self.vector.tobytes(), self.age, self.identity.state(),
                None if self.searched is None else self.searched.tobytes())

    @classmethod
    def restore(cls, state: tuple) -> Track:
        number, box, vector, age, identity, searched = state
        return cls(number, box, np.frombuffer(vector), age, identity,
                   None if searched is None else np.frombuffer(searched))

    def see(self, box, vector, unit) -> None:
        self.box, self.vector, self.unit, self.age = box, vector, unit, 0
        self.identity.seen()

    def search(self, person: int, score: float, again_below: float) -> None:
        """Use a match unless the track is locked, too young, or was searched with nearly this vector."""
        if self.identity.locked or self.identity.hits < MIN_HITS:
            return
        if self.searched is not None and _cosines(self.searched, self.vector[None, :])[0] >= again_below:
            return
        self.searched = self.vector
        self.identity.resolve(person, score)

    def row(self, seen: bool) -> tuple:
        who = self.identity
        return (self.number, *self.box, who.hits, self.age, seen, who.person, who.confidence, who.locked)


TRACK_FIELDS = ("track_id", *BOX, "hits", "age", "seen", "person", "confidence", "locked")


def _similar(live: list[Track], vectors, units) -> np.ndarray:
    """Cosines of live tracks and detections. A track keeps its unit vector, so only new vectors are scaled."""
    if isinstance(units, np.ndarray) and all(len(t.unit) == units.shape[1] for t in live):
        return np.array([t.unit for t in live]) @ units.T
    return cosine_block([t.vector for t in live], list(vectors))


class TrackFold(Fold):
    """Tracks of one camera, tick by tick; an input row is one tick with all its detections.

    Detections are assigned to live tracks at minimum total cost (1 − cosine); pairs under
    ``min_sim`` are undone. Unassigned tracks age, unassigned detections start tracks, tracks older
    than ``max_age`` ticks end. Detections may carry ``match_person`` and ``score``.
    """

    inputs = ("detections",)
    output = ("tracks ARRAY<STRUCT<track_id: BIGINT, x: INT, y: INT, width: INT, height: INT, hits: INT, age: INT, "
              "seen: BOOLEAN, person: BIGINT, confidence: DOUBLE, locked: BOOLEAN>>")

    def __init__(self, max_age: int = MAX_AGE, min_sim: float = MIN_TRACK_SIMILARITY,
                 again_below: float = SEARCH_AGAIN_BELOW):
        self.max_age, self.min_sim, self.again_below = max_age, min_sim, again_below

    def step(self, state, cols):
        next_number, stored = state or (0, ())
        live = [Track.restore(s) for s in stored]
        counts, rows = [], []
        for found in cols["detections"]:
            next_number, live, seen = self._tick(next_number, live, found)
            counts.append(len(live))
            rows.extend(t.row(t.number in seen) for t in live)
        return (next_number, tuple(t.state() for t in live)), {"tracks": Ragged(TRACK_FIELDS, counts, rows)}

    def _tick(self, next_number, live, found):
        vectors = found["embedding"]
        boxes = list(zip(*(found[c].tolist() for c in BOX)))
        units = unit_rows(vectors) if isinstance(vectors, np.ndarray) and len(vectors) else [unit_rows(v[None, :])[0] for v in vectors]
        taken, seen = set(), set()
        if len(vectors) and live:
            similar = _similar(live, vectors, units)
            for i, j in enumerate(assign(1.0 - similar)):
                if j >= 0 and similar[i, j] >= self.min_sim:
                    track = live[i]
                    taken.add(int(j))
                    seen.add(track.number)
                    track.see(boxes[j], vectors[j], units[j])
                    track.search(int(found["match_person"][j]), float(found["score"][j]), self.again_below)
        for track in live:
            track.age += track.number not in seen
        for j in range(len(vectors)):
            if j not in taken:
                track = Track(next_number, boxes[j], vectors[j], identity=(1,), unit=units[j])
                live.append(track)
                seen.add(track.number)
                next_number += 1
        return next_number, [t for t in live if t.age <= self.max_age], seen


class CameraFold(Fold):
    """The live path of one camera: frames over the frame limit are ignored, the others are tracked."""

    inputs = ("us", "detections")
    output = TrackFold.output

    def __init__(self, limit: int = CAMERA_LIMIT[0], window_s: float = CAMERA_LIMIT[1], **tracking):
        self.rate, self.tracker = RateLimit(limit, window_s), TrackFold(**tracking)

    def step(self, state, cols):
        frames, tracks = state or (None, None)
        frames, passed = self.rate.step(frames, {"us": cols["us"]})
        chosen = np.flatnonzero(passed["allowed"])
        tracks, out = self.tracker.step(tracks, {"detections": [cols["detections"][i] for i in chosen]})
        counts = np.zeros(len(cols["us"]), int)
        counts[chosen] = out["tracks"].counts
        return (frames, tracks), {"tracks": Ragged(TRACK_FIELDS, counts.tolist(), out["tracks"].structs)}
