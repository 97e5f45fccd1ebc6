"""Ordered folds: per key, rows in order, each output depending on the state all earlier rows left.

Window functions cannot express these ("seconds since the last *accepted* row"). A fold runs as one
shuffle by key, a sort inside the partitions and a pass that streams Arrow batches and holds one
state, never the rows of a key.

A key with more than ``hot_rows`` rows would still be one long task. The rows of such keys are dealt in
sampled ranges of (key, time), found from keys and times alone; a key that lies in one range is folded
like any other, and a key that a bound cuts is cut into chunks there, so a burst is several chunks. Rows
of cut keys are sorted and written once, by chunk, and all passes read them there; all other rows move
once. How a chunk learns its entry state:

* A fold with a ``summary`` says, per chunk and without knowing how it is entered, what comes out for
  every state that can come in, as a small table of pieces. All chunks are summarised in parallel,
  then one light pass per key hands the state from table to table. Three passes, whatever the number
  of chunks and however far the past reaches.
* Other folds guess: chunks run in parallel with guessed entry states and report the state they end
  with; chunks whose true entry state (the exit of the chunk before) differs run again, until nothing
  changes. The first chunk is right from the start and each round makes at least the next one right.
  Folds that forget their past settle after one or two rounds. Where the past reaches far only the
  first wrong chunk of a key runs again per round: the work stays linear, in as many rounds as chunks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rollgrid.functions.vectors import matrix
from rollgrid.session import reliable_folder, spread_by, task_count, written

HOT_ROWS = 5_000_000
RANGES_PER_TASK = 4
FREE_ROUNDS = 3
CHUNK, ENTRY, EXIT, USED = "_chunk", "_entry", "_exit", "_used"


class Fold:
    """A pure step over consecutive rows of one key, shared by the batch and the stream form.

    ``inputs`` names the columns the step reads, ``output`` is the DDL of the columns it adds.
    States are tuples of plain values (or None at the start), so equal states pickle equally.
    """

    inputs: tuple[str, ...] = ()
    output: str = ""

    def step(self, state: tuple | None, cols: dict[str, np.ndarray]) -> tuple[tuple | None, dict]:
        raise NotImplementedError

    def forget_at(self, state: tuple) -> int | None:
        """Time in microseconds from which ``state`` means the same as none; None for never."""
        return None

    def summary(self, cols: dict[str, np.ndarray]) -> Callable[[tuple | None], tuple] | None:
        """The state that these rows, all of a chunk, leave for each state before them; None if the fold has no such table.

        The table pickles. A state it gives need not equal the step's, but every later row must be treated alike.
        """
        return None

    def summarised(self) -> bool:
        return type(self).summary is not Fold.summary


class Ragged:
    """Output column of lists of structs: how many structs each row has, and all of them as tuples."""

    def __init__(self, names: tuple[str, ...], counts: list[int], structs: list[tuple]):
        self.names, self.counts, self.structs = names, counts, structs

    def __iter__(self):
        at = 0
        for n in self.counts:
            yield [dict(zip(self.names, s)) for s in self.structs[at : at + n]]
            at += n

    @staticmethod
    def arrow(parts: list[Ragged], kind: pa.ListType) -> pa.Array:
        structs = [s for p in parts for s in p.structs]
        columns = zip(*structs) if structs else [[] for _ in kind.value_type]
        values = [pa.array(c, type=f.type) for c, f in zip(columns, kind.value_type)]
        ends = np.cumsum([0, *(n for p in parts for n in p.counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(values, fields=list(kind.value_type)), type=kind)


def struct_rows(column: pa.ListArray) -> list[dict]:
    """List-of-struct column as one dict of arrays per row; the arrays are views of flat columns."""
    ends = column.offsets.to_numpy()
    ends = ends - ends[0]
    flat = column.flatten()
    fields = {}
    for field in flat.type:
        part = flat.field(field.name)
        fields[field.name] = matrix(part) if pa.types.is_list(field.type) else part.to_numpy(zero_copy_only=False)
    return [{n: x[a:b] for n, x in fields.items()} for a, b in zip(ends[:-1], ends[1:])]


def as_arrays(batch, names: tuple[str, ...]) -> dict:
    arrays = {}
    for name in names:
        column = batch.column(name)
        if pa.types.is_list(column.type):
            inner = column.type.value_type
            arrays[name] = struct_rows(column) if pa.types.is_struct(inner) else matrix(column)
        else:
            arrays[name] = column.to_numpy(zero_copy_only=False)
    return arrays


def _run_starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows at which the key changes; nulls are a key of their own."""
    change = np.zeros(batch.num_rows, bool)
    change[0] = True
    for key in keys:
        codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def _fold_batches(batches: Iterator[pa.RecordBatch], keys: list[str], fold: Fold, entries: dict):
    """Yields ``(batch, outputs, finished)`` where ``finished`` lists (key, state) of completed keys.

    ``entries`` has the pickled states of the keys that do not start from nothing.
    """
    key, state = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _run_starts(batch, keys)
        arrays = as_arrays(batch, fold.inputs)
        pieces, finished = [], []
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            mine = tuple(batch.column(k)[int(a)].as_py() for k in keys)
            if mine != key:
                if key is not None:
                    finished.append((key, state))
                key, state = mine, pickle.loads(entries[mine]) if mine in entries else None
            state, out = fold.step(state, {n: x[a:b] for n, x in arrays.items()})
            pieces.append(out)
        yield batch, pieces, finished
    if key is not None:
        yield None, [], [(key, state)]


def _join_pieces(pieces: list[dict], field: pa.Field) -> pa.Array:
    values = [p[field.name] for p in pieces]
    if isinstance(values[0], Ragged):
        return Ragged.arrow(values, field.type)
    if isinstance(values[0], np.ndarray):
        return pa.array(np.concatenate(values), type=field.type)
    return pa.array([v for part in values for v in part], type=field.type)


def _carried(entries: DataFrame | None, keys: list[str]) -> Callable[[], dict]:
    """Entry states by key, sent to the tasks: one per chunk at most, and chunks are few (``_ranges``)."""
    if entries is None:
        return dict
    *columns, states = (c.to_pylist() for c in entries.select(*keys, ENTRY).toArrow().columns)
    carried = entries.sparkSession.sparkContext.broadcast(dict(zip(zip(*columns), states)))
    return lambda: carried.value


def _output_pass(df: DataFrame, keys: list[str], keep: list[str], fold: Fold, entries: DataFrame | None = None) -> DataFrame:
    added = T._parse_datatype_string(fold.output)
    schema = T.StructType([df.schema[c] for c in keep] + list(added.fields))
    fields, carried = list(to_arrow_schema(added)), _carried(entries, keys)

    def run(batches):
        for batch, pieces, _ in _fold_batches(batches, keys, fold, carried()):
            if batch is not None:
                columns = [batch.column(c) for c in keep] + [_join_pieces(pieces, f) for f in fields]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def _exit_pass(df: DataFrame, keys: list[str], fold: Fold, entries: DataFrame | None = None) -> DataFrame:
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(EXIT, T.BinaryType())])
    arrow, carried = to_arrow_schema(schema), _carried(entries, keys)

    def run(batches):
        for _, _, finished in _fold_batches(batches, keys, fold, carried()):
            if finished:
                columns = [*zip(*[key for key, _ in finished]), [pickle.dumps(s) for _, s in finished]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.select(*keys, *(c for c in fold.inputs if c not in keys)).mapInArrow(run, schema)


def _settle_entries(rows: DataFrame, keys: list[str], order: list[str], fold: Fold) -> DataFrame:
    """True entry state per (keys, chunk); chunks that start from nothing are absent. Rows lie by chunk and in order."""
    unit = [*keys, CHUNK]
    before = Window.partitionBy(*keys).orderBy(CHUNK)
    nothing = F.lit(None).cast("binary")
    done = _exit_pass(rows, unit, fold).withColumn(USED, nothing).checkpoint()
    rounds = 0
    while True:
        current = done.withColumn(ENTRY, F.lag(EXIT).over(before))
        stale = current.filter(~F.col(ENTRY).eqNullSafe(F.col(USED)))
        if rounds >= FREE_ROUNDS:  # long chains: only their first stale chunk, its entry is final
            first = stale.groupBy(*keys).agg(F.min(CHUNK).alias(CHUNK))
            stale = stale.join(first, unit, "left_semi")
        redo = stale.select(*unit, ENTRY).checkpoint()
        if redo.isEmpty():
            return current.filter(F.col(ENTRY).isNotNull()).select(*unit, ENTRY)
        again = rows.join(F.broadcast(redo.select(*unit)), unit, "left_semi")  # as many as chunks; the rows stay where they are
        redone = _exit_pass(again.sortWithinPartitions(*unit, *order), unit, fold, redo).withColumnRenamed(EXIT, "_new")
        done = done.join(redo, unit, "left").join(redone, unit, "left").select(
            *unit, F.coalesce("_new", EXIT).alias(EXIT), F.coalesce(ENTRY, USED).alias(USED)).checkpoint()
        rounds += 1


def _summary_pass(rows: DataFrame, unit: list[str], fold: Fold) -> DataFrame:
    """One row per chunk with its table; a task holds the step's inputs of one chunk."""
    schema = T.StructType([rows.schema[k] for k in unit] + [T.StructField("_table", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def table_of(key: tuple, held: list[dict]) -> pa.RecordBatch:
        cols = {n: np.concatenate([part[n] for part in held]) for n in fold.inputs}
        values = [*([k] for k in key), [pickle.dumps(fold.summary(cols))]]
        return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(values, arrow)], schema=arrow)

    def run(batches):
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, arrays = _run_starts(batch, unit), as_arrays(batch, fold.inputs)
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                mine = tuple(batch.column(k)[int(a)].as_py() for k in unit)
                if mine != key:
                    if held:
                        yield table_of(key, held)
                    key, held = mine, []
                held.append({n: x[a:b].copy() for n, x in arrays.items()})
        if held:
            yield table_of(key, held)

    return rows.select(*unit, *[c for c in fold.inputs]).mapInArrow(run, schema)


def _summarised_entries(rows: DataFrame, keys: list[str], order: list[str], fold: Fold) -> DataFrame:
    """True entry state per (keys, chunk), handed from table to table; chunks that start from nothing are absent."""
    unit = [*keys, CHUNK]
    tables = _summary_pass(rows, unit, fold).checkpoint()
    lined = spread_by(tables, keys).sortWithinPartitions(*unit)
    schema = T.StructType([rows.schema[k] for k in unit] + [T.StructField(ENTRY, T.BinaryType())])

    def run(batches):
        key, state = None, None
        for batch in batches:
            entries = []
            for *mine, table in zip(*(batch.column(c).to_pylist() for c in [*keys, "_table"])):
                if mine != key:
                    key, state = mine, None
                entries.append(None if state is None else pickle.dumps(state))
                state = pickle.loads(table)(state)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in unit), pa.array(entries, pa.binary())], names=[*unit, ENTRY])

    return lined.mapInArrow(run, schema).where(F.col(ENTRY).isNotNull()).checkpoint()


def _ranges(df: DataFrame, hot: DataFrame, keys: list[str], time_col: str, hot_rows: int) -> DataFrame:
    """First and last place (key, time) of sampled ranges of about ``hot_rows`` rows of hot keys; only keys and times move.

    Rows of one key and time stay together. There are no more ranges than balance the session's tasks, however low
    ``hot_rows`` is; only rows beyond ``HOT_ROWS`` a range, which a summary holds at once, ask for more.
    """
    total = hot.agg(F.sum("_n")).first()[0]
    ranges = min(-(-total // hot_rows), max(RANGES_PER_TASK * task_count(df.sparkSession), -(-total // HOT_ROWS)))
    places = df.join(hot.select(*keys), keys, "left_semi").select(*keys, time_col)
    place = F.struct(*keys, time_col)
    return written(places.repartitionByRange(ranges, *keys, time_col).groupBy(F.spark_partition_id().alias(CHUNK)).agg(
        F.min(place).alias("_first"), F.max(place).alias("_last")), "ranges")


def _chunked(df: DataFrame, hot: DataFrame, keys: list[str], time_col: str, hot_rows: int) -> DataFrame:
    """All rows with ``CHUNK``: NULL unless their key is hot and a bound of the ranges cuts it; there it rises with time.

    The cut keys, at most one per range, are sent to the rows, so no row moves.
    """
    ranges = _ranges(df, hot, keys, time_col, hot_rows)
    opened = ranges.select(*(F.col(f"_last.{k}").alias(k) for k in keys), CHUNK).groupBy(*keys).agg(F.min(CHUNK).alias("_opened"))
    bounds = ranges.select(*(F.col(f"_first.{k}").alias(k) for k in keys), F.col(f"_first.{time_col}").alias("_bound"), CHUNK)
    cut = written(bounds.join(opened, keys).filter(F.col(CHUNK) > F.col("_opened")).groupBy(*keys).agg(
        F.collect_list("_bound").alias("_bounds")), "cut-keys")
    passed = F.size(F.filter("_bounds", lambda bound: bound <= F.col(time_col)))
    return df.join(F.broadcast(cut), keys, "left").select(*df.columns, F.when(F.col("_bounds").isNotNull(), passed).alias(CHUNK))


def hot_keys(df: DataFrame, keys: list[str], time_col: str, hot_rows: int | None) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows and their count ``_n``; None if there are none."""
    if hot_rows is None:
        return None
    reliable_folder(df.sparkSession)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = written(sizes.filter(F.col("_n") > hot_rows), "hot-keys")
    return None if hot.isEmpty() else hot


def ordered_fold(
    df: DataFrame, keys: list[str], order: list[str], fold: Fold, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """``df`` plus the fold's columns. ``order[0]`` must be a BIGINT time; keys must not be NULL.

    ``hot_rows=None`` skips the search for hot keys.
    """
    keep = df.columns
    hot = hot_keys(df, keys, order[0], hot_rows)
    rows = df if hot is None else _chunked(df, hot, keys, order[0], hot_rows)
    whole = rows if hot is None else rows.filter(F.col(CHUNK).isNull()).select(keep)
    result = _output_pass(spread_by(whole, keys).sortWithinPartitions(*keys, *order), keys, keep, fold)
    if hot is None:
        return result
    unit = [*keys, CHUNK]
    cut = spread_by(rows.filter(F.col(CHUNK).isNotNull()), unit).sortWithinPartitions(*unit, *order).checkpoint()
    settle = _summarised_entries if fold.summarised() else _settle_entries
    return result.unionByName(_output_pass(cut, unit, keep, fold, settle(cut, keys, order, fold)))


def resumed_fold(rows: DataFrame, keys: list[str], order: list[str], fold: Fold, keep: list[str], states: DataFrame | None = None) -> DataFrame:
    """``keep`` and the fold's columns of rows that go on from earlier ones, and the states to go on from next.

    ``states`` has the keys and their state (``EXIT``); keys without one start anew. The rows of a key are followed by one row
    of the key and its new state alone; in all others ``EXIT`` is NULL.
    """
    marked = rows.withColumn(ENTRY, F.lit(None).cast("binary"))
    if states is not None:
        marked = marked.unionByName(states.select(*keys, F.col(EXIT).alias(ENTRY)), allowMissingColumns=True)
    lined = spread_by(marked, keys).sortWithinPartitions(*keys, F.col(ENTRY).isNull(), *order)
    added = T._parse_datatype_string(fold.output)
    schema = T.StructType([rows.schema[c] for c in keep] + list(added.fields) + [T.StructField(EXIT, T.BinaryType())])
    for field in schema.fields:
        field.nullable = True
    arrow = to_arrow_schema(schema)

    def run(batches):
        entries = {}
        for batch, pieces, finished in _fold_batches(_unmarked(batches, keys, entries), keys, fold, entries):
            if batch is not None:
                columns = [batch.column(c) for c in keep] + [_join_pieces(pieces, arrow.field(f.name)) for f in added.fields]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(batch.num_rows, pa.binary())], schema=arrow)
            if finished:
                ends = dict(zip(keys, zip(*(key for key, _ in finished)))) | {EXIT: [pickle.dumps(state) for _, state in finished]}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ends[f.name], type=f.type) if f.name in ends else pa.nulls(len(finished), f.type) for f in arrow], schema=arrow)

    return lined.mapInArrow(run, schema)


def _unmarked(batches: Iterator[pa.RecordBatch], keys: list[str], entries: dict) -> Iterator[pa.RecordBatch]:
    """The rows without those that carry the entry state of a key, which go to ``entries``."""
    for batch in batches:
        marks = batch.column(ENTRY).is_valid()
        told = batch.filter(marks)
        for *key, state in zip(*(told.column(c).to_pylist() for c in [*keys, ENTRY])):
            entries[tuple(key)] = state
        yield batch.filter(pa.compute.invert(marks))
