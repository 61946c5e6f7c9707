"""Vector codes: vectors cut into parts, each part coded by the nearest entry of its codebook.

Codebooks are fitted by Lloyd rounds in exact integers.  Every vector keeps, for each part, an upper
bound on the distance to its entry and a lower bound on the distance to all others, each with
the round it was measured in.  The codebooks of all rounds are retained, so a later round loosens a bound
by how far an entry has moved in all since then (the norm of the summed moves), which is never
more than the sum of the norms of its moves.  Only where the bounds leave a doubt is the distance to the
own entry measured, and only where that leaves one are all entries compared again.

A round is one pass: tasks read vectors and bounds, write the new bounds and one row of partial
sums a task, and the sums are added up by Spark.  Codebooks (parts x entries x width numbers a round) are
all that comes to the driver or goes to tasks, whatever the number of vectors.

Defined results: rows whose vector is null or holds a null or non-finite component are left out; so
are rows with a component of 2 ** 16 or more (their error would not fit a long), and rows that can't be
cut or whose length is not that of the smallest id's; fewer rows than entries make smaller codebooks;
null ids come last, equal ids are ordered by their vectors, and repeated rows count each; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Components must stay below this, so that squared distances fit a long.
LARGEST = float(1 << 16)
STATE = ["code", "upper", "lower", "upper_at", "lower_at"]


def usable(rows: DataFrame, vector: str, parts: int, scale: int, *others: str) -> DataFrame:
    """``others`` and ``v`` (integers), for rows whose vector can be cut."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LARGEST))
    able = rows.where(F.coalesce(fine & (F.size(vector) > 0) & (F.size(vector) % parts == 0), F.lit(False)))
    return able.select(*others, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def moves(history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every part, round and entry: how far the entry has moved since, and how far any other has at most."""
    own = np.sqrt(((history[-1] - history) ** 2).sum(axis=-1, dtype=np.float64)).transpose(1, 0, 2)
    first = own.argmax(axis=2)
    rest = own.copy()
    np.put_along_axis(rest, first[:, :, None], 0, axis=2)
    other = np.where(np.arange(own.shape[2]) == first[:, :, None], rest.max(axis=2)[:, :, None], own.max(axis=2)[:, :, None])
    return own, other


def squares(v: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((v - entries) ** 2).sum(axis=-1)


def scan(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower of equals), its squared distance, and the next one's as a root."""
    d = squares(v[:, None, :], book[None])
    near = d.argmin(axis=1)
    least = np.take_along_axis(d, near[:, None], 1)[:, 0]
    far = np.full(len(v), np.inf)
    if d.shape[1] > 1:
        far = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))
    return near, least, far


def assign(v: np.ndarray, state: list[np.ndarray] | None, history: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The state of every part after the last round of ``history``, and how many parts were compared
    with all entries.  ``v``: rows x parts x width; ``history``: rounds x parts x entries x width."""
    now, (n, parts, _), scans = len(history) - 1, v.shape, 0
    if state is None:
        state = [np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf), np.zeros((n, parts)), *np.zeros((2, n, parts), np.uint8)]
    code, upper, lower, upper_at, lower_at = (x.copy() for x in state)
    own, other = moves(history)
    for p in range(parts):
        book, a = history[-1][p], code[:, p].astype(np.int64)
        low = lower[:, p] - other[p][lower_at[:, p], a]
        up = upper[:, p] + own[p][upper_at[:, p], a]
        # Roots are rounded: bounds must differ by more than that.
        sure = lambda u, w: u + 1e-9 * (1 + u + np.abs(w)) < w
        open_ = np.flatnonzero(~sure(up, low))
        upper[open_, p] = np.sqrt(squares(v[open_, p], book[a[open_]]).astype(np.float64))
        upper_at[open_, p] = now
        open_ = open_[~sure(upper[open_, p], low[open_])]
        near, least, far = scan(v[open_, p], book)
        code[open_, p], upper[open_, p], lower[open_, p], lower_at[open_, p] = near, np.sqrt(least.astype(np.float64)), far, now
        scans += len(open_)
    return [code, upper, lower, upper_at, lower_at], scans


def _open(b: pa.RecordBatch, parts: int) -> tuple[np.ndarray, list[np.ndarray] | None]:
    """Vectors and state of a batch."""
    v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, parts, -1)
    if "code" not in b.schema.names:
        return v, None
    kinds = [np.uint8, np.float64, np.float64, np.uint8, np.uint8]
    return v, [np.frombuffer(b"".join(b.column(c).to_pylist()), k).reshape(-1, parts) for c, k in zip(STATE, kinds, strict=True)]


def _rows(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _pass(table: DataFrame, history: np.ndarray) -> DataFrame:
    """The table with its new state, and a row with ``sums`` (counts, then components) from each task."""
    parts, entries, width = history.shape[1:]
    names = ["vec_id", "label", "v", *STATE, "sums"]
    kind = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    schema = f"vec_id long, label {kind['label']}, v array<int>, code binary, upper binary, lower binary, upper_at binary, lower_at binary, sums array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, none = np.zeros((parts, entries, width + 1), np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            v, state = _open(b, parts)
            state, _ = assign(v, state, history)
            for p in range(parts):
                a = state[0][:, p]
                sums[p, :, 0] += np.bincount(a, minlength=entries)
                for j in range(width):
                    sums[p, :, j + 1] += np.bincount(a, v[:, p, j].astype(np.float64), entries).astype(np.int64)
            none = [pa.nulls(1, t) for t in b.select(["vec_id", "label", "v"]).schema.types]
            columns = [b.column(c) for c in ("vec_id", "label", "v")] + [_rows(x) for x in state]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(b.num_rows, pa.list_(pa.int64()))], names)
        if none:
            yield pa.RecordBatch.from_arrays([*none, *[pa.nulls(1, pa.binary())] * 5, pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], names)

    return table.mapInArrow(run, schema)


def fit(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[np.ndarray, DataFrame] | None:
    """All codebooks (rounds + 1 x parts x entries x width) and the table after the last round: ``vec_id,
    label, v`` and bounds.  None if no row can be used."""
    own = usable(rows, vector, parts, scale, F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"))
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = own.orderBy(*order).limit(1).collect()
    if not first:
        return None
    own = own.where(F.size("v") == len(first[0]["v"]))
    seeds = np.array([r["v"] for r in own.orderBy(*order).limit(entries).collect()], np.int64)
    book = seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    history, table, before = [book], own, None
    for _ in range(rounds):
        after = materialize(_pass(table, np.stack(history)))
        each = after.where("sums is not null").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x"))
        sums = np.array([int(r["x"]) for r in each.orderBy("i").collect()], object).reshape(*book.shape[:2], -1)
        count, total = sums[:, :, :1], sums[:, :, 1:]
        book = np.where(count > 0, total // np.where(count > 0, count, 1), book).astype(np.int64)
        history.append(book)
        table = after.where("sums is null").drop("sums")
        if before is not None:
            discard(before)
        before = after
    return np.stack(history), table


def coded(table: DataFrame, history: np.ndarray) -> DataFrame:
    """``vec_id, label, code`` (bytes) and ``error`` under the last codebooks."""
    parts = history.shape[1]
    kind = {f.name: f.dataType.simpleString() for f in table.schema.fields}["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, state = _open(b, parts)
                code = assign(v, state, history)[0][0]
                error = sum(squares(v[:, p], history[-1][p][code[:, p]]) for p in range(parts))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _rows(code), pa.array(error)], ["vec_id", "label", "code", "error"])

    return table.mapInArrow(run, f"vec_id long, label {kind}, code binary, error long")


def decode(code: bytes, book: np.ndarray, scale: int = 4096) -> np.ndarray:
    """The vector that a code stands for (the middle of its step)."""
    return np.concatenate([book[p][e] for p, e in enumerate(code)]) / scale + 0.5 / scale


def fingerprint(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def product_codes(rows: DataFrame, **how) -> DataFrame:
    """``vec_id, code`` (two hex digits a part), ``error, label_error, codebooks_sha256`` for every usable row."""
    found = fit(rows, **how)
    if found is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    history, table = found
    result = materialize(coded(table, history))
    by_label = result.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    return result.join(by_label, F.col("label").eqNullSafe(F.col("_l"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(fingerprint(history[-1])).alias("codebooks_sha256")
    )
