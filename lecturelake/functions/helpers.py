"""Arrow helpers for the two running states that no window expresses.

Both read partitions sorted by lecture and time, carry one small state from batch to batch and add
an integer column, so a lecture of any length streams through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType


def _by_lecture(rows: DataFrame, key: str, name: str, start: Callable) -> DataFrame:
    """Add ``name``: ``start()`` gives a function from a batch's columns to numbers, made anew for
    each lecture; it is called with the row numbers of the lecture's part of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for b in batches:
            keys = b.column(key).to_pandas().to_numpy()
            out = np.zeros(len(keys), np.int64)
            if len(keys):
                cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    if step is None or keys[i] != now:
                        now, step = keys[i], start()
                    out[i:j] = step(b, i, j)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, LongType())]))


def _fill(ends: np.ndarray, held: int, least: int) -> tuple[np.ndarray, int, int]:
    """Group numbers from 0 for running sizes ``ends``, of which ``held`` came before; groups closed and what is held after."""
    out, at, base, group = np.zeros(len(ends), np.int64), 0, -held, 0
    while at < len(ends):
        close = int(np.searchsorted(ends, base + least))
        out[at : close + 1] = group
        if close >= len(ends):
            break
        group, base, at = group + 1, int(ends[close]), close + 1
    return out, group, int(ends[-1]) - base if len(ends) else held


def greedy_fill(rows: DataFrame, key: str, size: str, least: int, name: str, held: str | None = None, first: str | None = None) -> DataFrame:
    """Number groups of rows: a group closes as soon as its ``size`` adds up to ``least``.

    A key's rows begin with what its columns ``held`` (size in the open group) and ``first`` (its
    number) say, else with nothing and 0.
    """

    def start() -> Callable:
        now = group = None

        def step(b: pa.RecordBatch, i: int, j: int) -> np.ndarray:
            nonlocal now, group
            if now is None:
                now, group = (b.column(c)[i].as_py() if c else 0 for c in (held, first))
            found, closed, now = _fill(np.cumsum(b.column(size).to_numpy(zero_copy_only=False)[i:j]), now, least)
            found, group = found + group, group + closed
            return found

        return step

    return _by_lecture(rows, key, name, start)


def fill_function(sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``_fill`` does to each size from 0 to ``least - 1`` that may be held before: held after, and groups closed.

    Every row points to the one after the close of a group that begins with it; pointers
    are doubled until all have left.
    """
    n, ends = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    after = np.searchsorted(ends, ends[:-1] + least)  # ends[after] is the first sum that closes
    closes = after <= n
    jump, hops = np.append(np.where(closes, after, np.arange(n)), n), np.append(closes, False).astype(np.int64)
    for _ in range(n.bit_length()):
        jump, hops = jump[jump], hops + hops[jump]
    first = np.searchsorted(ends, least - np.arange(least))
    stays = first > n
    at = np.where(stays, 0, np.minimum(first, n))
    left = ends[n] - ends[jump[at]]
    return np.where(stays, np.arange(least) + ends[n], left), np.where(stays, 0, 1 + hops[at])


def fill_functions(rows: DataFrame, keys: list[str], size: str, least: int) -> DataFrame:
    """``keys, held, closed``: the function of each run of rows with equal ``keys``, batch after batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            own = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            sizes, at, out = b.column(size).to_numpy(zero_copy_only=False), 0, []
            while at < len(own):
                to = at
                while to < len(own) and own[to] == own[at]:
                    to += 1
                held, closed = fill_function(sizes[at:to], least)
                if own[at] == now:
                    state = held[state[0]], state[1] + closed[state[0]]
                else:
                    if now is not None:
                        out.append((*now, *state))
                    now, state = own[at], (held, closed)
                at = to
            yield table(out)
        yield table([(*now, *state)] if now is not None else [])

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * (len(keys) + 2)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*keys, "held", "closed"])

    kinds = {f.name: f for f in rows.schema.fields}
    types = [*(pa.string() if isinstance(kinds[k].dataType, StringType) else pa.int64() for k in keys), *[pa.list_(pa.int64())] * 2]
    lists = [StructField(c, ArrayType(LongType())) for c in ("held", "closed")]
    return rows.mapInArrow(run, StructType([*(kinds[k] for k in keys), *lists]))


def fill_starts(functions: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, held, first``: with what each run begins, from the functions of those before it (rows by the first
    of ``keys``, in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, first = None, 0, 0
        for b in batches:
            starts, after, closed = [], b.column("held"), b.column("closed")
            for i, key in enumerate(b.column(keys[0]).to_pylist()):
                if key != now:
                    now, held, first = key, 0, 0
                starts.append((held, first))
                held, first = after[i].values[held].as_py(), first + closed[i].values[held].as_py()
            columns = [pa.array([x[i] for x in starts], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *columns], [*keys, "held", "first"])

    kinds = {f.name: f for f in functions.schema.fields}
    return functions.mapInArrow(run, StructType([*(kinds[k] for k in keys), StructField("held", LongType()), StructField("first", LongType())]))


def step_windows(rows: DataFrame, key: str, begin: str, end: str, width: int, name: str) -> DataFrame:
    """Number windows: a row that ends after the window advances it by exactly one."""

    def start() -> Callable:
        now, close = 0, None

        def step(b: pa.RecordBatch, i: int, j: int) -> np.ndarray:
            nonlocal now, close
            out = np.zeros(j - i, np.int64)
            if close is None:
                close = b.column(begin)[i].as_py() + width
            for k, e in enumerate(b.column(end).to_numpy(zero_copy_only=False)[i:j].tolist()):
                if e > close:
                    now, close = now + 1, close + width
                out[k] = now
            return out

        return step

    return _by_lecture(rows, key, name, start)
