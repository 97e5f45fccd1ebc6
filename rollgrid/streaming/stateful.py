"""Stream form of the ordered folds.

The same step functions as in batch, driven by ``transformWithStateInPandas``. Rows wait in the state
store until the watermark has passed them and are then folded in (time, event_id) order, so a stream
over shuffled files gives the batch result. Rows behind the watermark are dropped by Spark.
A state that no longer matters (``Fold.forget_at``) is removed by a timer, so idle keys cost nothing.

Keys are grouped in buckets by their hash, and a bucket's rows wait as blocks of columns: the state store is called per
block and per folded key, not per row. A bucket is folded by one task per micro-batch; what it holds is bounded by its rows of
one micro-batch and one watermark delay, which the source options bound.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rollgrid.operators import folds
from rollgrid.operators.folding import Fold
from rollgrid.operators.presence import day_of


def _column(values: list, kind: T.DataType):
    """State-store values as the arrays a step expects."""
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StructType):
            return [_struct_arrays(v, kind.elementType) for v in values]
        return np.array([np.asarray(v, dtype=np.float64) for v in values]) if values else np.empty((0, 0))
    return np.array(values, dtype=object if isinstance(kind, T.StringType) else None)


def _struct_arrays(items, kind: T.StructType) -> dict:
    rows = [tuple(i.values()) if isinstance(i, dict) else i for i in items]
    columns = list(zip(*rows)) if rows else [[] for _ in kind.fields]
    return {f.name: _column(list(c), f.dataType) for f, c in zip(kind.fields, columns)}


#: Buckets of keys of a fold, and of a day's marks. Part of what a checkpoint holds: other numbers need a new one.
BUCKETS, MARK_BUCKETS = 4096, 512
#: Rows that one entry of the waiting list holds at most.
BLOCK_ROWS = 10_000
BUCKET = "_bucket"


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class FoldProcessor(StatefulProcessor):
    """Folds the rows of a bucket of keys in time order, once the watermark has passed them.

    A call to the state store costs more than a row, so rows wait as blocks of columns for all keys of the bucket. States are
    kept by key and only those of folded keys are read and written.
    """

    def __init__(self, fold: Fold, keys: list[str], schema: T.StructType, order: list[str], keep: list[str]):
        self.fold, self.keys, self.schema, self.order, self.keep = fold, keys, schema, order, keep
        self.names = schema.fieldNames()
        self.out_names = [f.name for f in T._parse_datatype_string(fold.output).fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getMapState("states", "key STRING", "value BINARY")
        self.ends = handle.getValueState("ends", "value BINARY")  # when the states of the keys end, as far as they do
        self.waiting = handle.getListState("waiting", "rows BINARY")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList([(pickle.dumps({n: pdf[n].to_numpy() for n in self.names}),)])
                low = int(pdf[self.order[0]].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = [pickle.loads(b[0]) for b in self.waiting.get()]
        due = {n: np.concatenate([b[n] for b in blocks]) for n in self.names} if blocks else None
        ends = pickle.loads(self.ends.get()[0]) if self.ends.exists() else {}
        before = dict(ends)
        if due is not None:
            time = due[self.order[0]].astype(np.int64)
            ready = time <= done
            if ready.any():
                self._keep_waiting({n: v[~ready] for n, v in due.items()}, time[~ready])
                yield self._fold({n: v[ready] for n, v in due.items()}, ends, done)
        for name in [k for k, at in ends.items() if at <= done]:
            self.states.removeKey((name,))
            del ends[name]
        if ends != before:
            if ends:
                self.ends.update((pickle.dumps(ends),))
                self.handle.registerTimer(min(ends.values()) // 1000 + 1)
            else:
                self.ends.clear()

    def _fold(self, due: dict, ends: dict, done: int) -> pd.DataFrame:
        """The due rows with the fold's columns; ``ends`` follows the states."""
        codes = {}
        owner = np.array([codes.setdefault(k, len(codes)) for k in zip(*(due[k].tolist() for k in self.keys))], np.int64)
        line = np.lexsort((*(due[c].astype(np.int64) for c in reversed(self.order)), owner))
        due, owner = {n: v[line] for n, v in due.items()}, owner[line]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        added = {n: [] for n in self.out_names}
        for mine, a, b in zip(codes, starts, [*starts[1:], len(owner)]):
            name = repr(mine)
            stored = self.states.getValue((name,))
            state = pickle.loads(stored[0]) if stored else None
            state, out = self.fold.step(state, {n: _slice(due[n][a:b], self.schema[n].dataType) for n in self.fold.inputs})
            for n in self.out_names:
                added[n].extend(out[n])
            at = self.fold.forget_at(state) if state is not None else None
            if at is not None and (stored or at > done):
                ends[name] = at
            elif at is None:
                ends.pop(name, None)
            if state is not None and (at is None or at > done):
                self.states.updateValue((name,), (pickle.dumps(state),))
        return pd.DataFrame({**{n: due[n] for n in self.keep}, **{n: pd.Series(v, dtype=None if v else object) for n, v in added.items()}})

    def _keep_waiting(self, rows: dict, time: np.ndarray) -> None:
        if len(time):
            self.waiting.put([(pickle.dumps({n: v[at : at + BLOCK_ROWS] for n, v in rows.items()}),) for at in range(0, len(time), BLOCK_ROWS)])
            self.handle.registerTimer(int(time.min()) // 1000 + 1)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def _slice(values: np.ndarray, kind: T.DataType):
    """Waiting values of one key as the arrays a step expects."""
    if values.dtype.kind in "if":
        return values.astype(np.int64 if values.dtype.kind == "i" else np.float64)
    return values if values.dtype.kind == "b" else _column(list(values), kind)


def fold_stream(events: DataFrame, keys: list[str], fold: Fold, order: tuple[str, ...] = ("us", "event_id"),
                keep: list[str] | None = None) -> DataFrame:
    """Streaming ``ordered_fold``; append output. ``events`` needs a watermark and no NULL keys.

    ``keep`` names the columns of the rows that come out (all, if None); the others only wait if the fold needs them.
    """
    keep = events.columns if keep is None else keep
    held = [c for c in events.columns if c in {*keys, *order, *fold.inputs, *keep}]
    schema = T.StructType([events.schema[c] for c in held])
    added = T._parse_datatype_string(fold.output)
    return events.select(bucket_of(keys, BUCKETS).alias(BUCKET), *held).groupBy(BUCKET).transformWithStateInPandas(
        statefulProcessor=FoldProcessor(fold, keys, schema, list(order), keep),
        outputStructType=T.StructType([*(events.schema[c] for c in keep), *added.fields]),
        outputMode="Append", timeMode="EventTime")


class FirstSeen(StatefulProcessor):
    """Emits the first row of each key when it comes: in the micro-batch that brings the key, the first in order.

    A group is a bucket of keys and a day. Its state is the keys that are marked, which go when the watermark has passed
    ``ends_col`` (milliseconds).
    """

    def __init__(self, keys: list[str], schema: T.StructType, order: list[str], ends_col: str):
        self.keys, self.names, self.order, self.ends = keys, schema.fieldNames(), order, ends_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marked = handle.getListState("marked", "keys BINARY")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, ends = None, None
        for pdf in rows:
            if len(pdf):
                ends = int(pdf[self.ends].iloc[0])
                both = pdf if best is None else pd.concat([best, pdf], ignore_index=True)
                best = both.sort_values(self.order, kind="stable").drop_duplicates(self.keys)
        if best is None:
            yield pd.DataFrame()
            return
        known = set().union(*(pickle.loads(m[0]) for m in self.marked.get()))
        mine = list(zip(*(best[k].tolist() for k in self.keys)))
        fresh = np.array([k not in known for k in mine], np.bool_)
        if fresh.any():
            self.marked.appendList([(pickle.dumps([k for k, new in zip(mine, fresh) if new]),)])
            self.handle.registerTimer(ends)
        yield best.loc[fresh, self.names].reset_index(drop=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.marked.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def rate_limit_stream(events, keys, limit, window_s, keep=None):
    return fold_stream(events, keys, folds.RateLimit(limit, window_s), keep=keep)


def lockout_stream(events, keys, limit=folds.LOGIN_LIMIT[0], timeout_s=folds.LOGIN_LIMIT[1], keep=None):
    return fold_stream(events, keys, folds.Lockout(limit, timeout_s), keep=keep)


def dedup_ttl_stream(events, keys, ttl_s=folds.MARK_TTL_S, keep=None):
    return fold_stream(events, keys, folds.TtlDedup(ttl_s), keep=keep)


def replay_guard_stream(events, keys, threshold=folds.REPLAY_AT, keep=None):
    return fold_stream(events, keys, folds.ReplayGuard(threshold), keep=keep)


def lock_identity_stream(updates, keys, keep=None):
    return fold_stream(updates, keys, folds.IdentityLock(), keep=keep)


def verify_attendance_stream(placed, keys, ttl_s=folds.MARK_TTL_S, limit=folds.ATTEMPT_LIMIT[0],
                             window_s=folds.ATTEMPT_LIMIT[1], keep=None):
    """``placed`` are requests after ``geofence`` (a stream joins the static branch table)."""
    return fold_stream(placed, keys, folds.Verification(ttl_s, limit, window_s), keep=keep)


def camera_count_stream(matches, keys, window_s, keep=None):
    """Distinct cameras per match; the quorum follows from a join with the static camera table."""
    return fold_stream(matches, keys, folds.CameraCount(window_s), keep=keep)


def once_per_day_stream(events: DataFrame, keys: list[str], time_col: str = "ts") -> DataFrame:
    """First event per key and day, once the watermark has left the day.

    A plain windowed aggregation, so it stays in the JVM whatever the number of keys, and its state
    goes with the day. ``once_now_stream`` answers at once.
    """
    row = F.struct(*[c for c in events.columns if c not in ("us", "event_id")], "us", "event_id")
    days = events.groupBy(*keys, F.window(time_col, "1 day")).agg(F.min_by(row, F.struct("us", "event_id")).alias("r"))
    return days.select("r.*").withColumn("day", day_of())


def once_now_stream(events: DataFrame, keys: list[str]) -> DataFrame:
    """The mark of each key and day (UTC) in the micro-batch that first brings one; append output.

    Within a micro-batch the first in (time, event_id) order marks. A mark once given stays: an earlier event of the day
    that comes in a later micro-batch, though not late, finds the day marked and gives no row. The state of a day goes when
    the watermark has left it; events behind the watermark are dropped (``late.split_late`` keeps them).
    """
    dated = events.withColumn("day", day_of())
    held = dated.withColumn("ends_ms", (F.col("day") + F.lit(1)).cast("bigint") * F.lit(86_400_000))
    return held.withColumn(BUCKET, bucket_of(keys, MARK_BUCKETS)).groupBy(BUCKET, "day").transformWithStateInPandas(
        statefulProcessor=FirstSeen(keys, dated.schema, ["us", "event_id"], "ends_ms"),
        outputStructType=T.StructType(list(dated.schema.fields)), outputMode="Append", timeMode="EventTime")
