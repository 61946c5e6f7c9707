"""Ordinal quality classifier: cumulative-link regression on graded ratings over hashed text.

One weight vector is shared by all grades; ordered thresholds cut its score into grades:
``P(grade <= k) = sigmoid(threshold[k] - w . x)``.  From these follow the expected grade and the
tail probability of the top grade, which selects.  Features are the distinct hashed words of a
whole text (ASCII letters lower-cased, marks at the end as a feature of their own), and three
hashed classes: how many words there are, which share of them is distinct, and which ends in a
mark other than ``.,;:``.

The fit uses a bounded sample of rated rows (its bound is a parameter), in one task; scoring runs
over every row, with the weights sent along (``dims`` numbers, whatever the corpus holds).

Defined results: a null or empty text has the class features only; repeated rows are scored
each on their own, and a repeated rating counts once; of the rows of one id the one whose text has
the smallest hash trains; rows with a null rating or id don't train;
without ratings nothing is rejected (tail probability 1); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_names
from .tokens import Places, slices

#: Words whose features a worker keeps before it starts afresh.
WORDS_KEPT = 500_000
MARKS = b".,!?;:*#$%&|\"'()<>[]{}-_/\\"

_FEATURES: dict[int, Features] = {}


class Features:
    """Distinct hashed features of texts."""

    def __init__(self, dims: int):
        self.dims = dims
        self.reset()

    def reset(self) -> None:
        self.place = Places()
        self.own = np.zeros((1024, 3), np.int64)

    def index(self, kind: bytes, value: bytes) -> int:
        return xxhash.xxh64_intdigest(kind + value) % self.dims

    def learn(self) -> None:
        new, self.place.new = self.place.new, []
        k = len(self.place) - len(new)
        while len(self.place) > len(self.own):
            self.own = np.concatenate([self.own, np.zeros_like(self.own)])
        cores = [w.rstrip(MARKS).lstrip(MARKS) for w in new]
        self.own[k : k + len(new), 0] = [self.index(b"word ", c) for c in cores]
        ends = [w[len(w.rstrip(MARKS)) :] for w in new]
        self.own[k : k + len(new), 1] = [self.index(b"end ", e) for e in ends]
        self.own[k : k + len(new), 2] = [len(e.rstrip(b".,;:")) > 0 for e in ends]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers, ascending within each text, and how many each text has."""
        if len(self.place) > WORDS_KEPT:
            self.reset()
        split = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.place.new:
            self.learn()
        row = np.repeat(np.arange(len(texts)), counts)
        words = np.unique(row * self.dims + self.own[at, 0])
        ends = np.unique(row * self.dims + self.own[at, 1])
        distinct = np.bincount(words // self.dims, minlength=len(texts))
        tenths, size = 10 * distinct // np.maximum(counts, 1), np.ceil(np.log2(counts + 1)).astype(np.int64)
        marked = 10 * np.bincount(row, self.own[at, 2], len(texts)).astype(np.int64) // np.maximum(counts, 1)
        classes = [
            i * self.dims + self.index(kind, value)
            for i, (t, s, m) in enumerate(zip(tenths.tolist(), size.tolist(), marked.tolist(), strict=True))
            for kind, value in ((b"distinct ", b"%d of %d" % (t, min(s, 8))), (b"size ", b"%d" % s), (b"marked ", b"%d" % m))
        ]
        keys = np.unique(np.concatenate([words, ends, np.array(classes, np.int64)]))
        return keys % self.dims, np.bincount(keys // self.dims, minlength=len(texts))


def features(dims: int) -> Features:
    if dims not in _FEATURES:
        _FEATURES[dims] = Features(dims)
    return _FEATURES[dims]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def ease(col: np.ndarray, row: np.ndarray, grades: np.ndarray, count: int) -> np.ndarray:
    """How freely the weight of each of ``count`` features may move: a third of the standard score by
    which the mean grade of its texts differs from that of all."""
    n = np.maximum(np.bincount(col, minlength=count), 1)
    mean = np.bincount(col, grades[row], count) / n
    return np.maximum(np.abs(mean - grades.mean()) * np.sqrt(n) / max(grades.std(), 1e-9) / 3, 0.05)


def fit(index: np.ndarray, sizes: np.ndarray, grades: np.ndarray, dims: int, levels: int, l2: float, steps: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch Adam, with falling steps, on the likelihood with
    a ridge penalty, which is smaller for features that tell grades apart (``ease``).

    Features of fewer than ``least`` texts keep weight 0.
    """
    n = len(sizes)
    keep = np.bincount(index, minlength=dims) >= least
    row = np.repeat(np.arange(n), sizes)[keep[index]]
    used, col = np.unique(index[keep[index]], return_inverse=True)
    penalty = l2 / ease(col, row, grades, len(used)) ** 2
    share = np.cumsum(np.bincount(grades, minlength=levels) + 1.0)[:-1] / (n + levels)
    cut = np.log(share / (1 - share))
    # First threshold, then the logs of the gaps: the order can't be lost.
    theta = np.concatenate([np.zeros(len(used)), cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, first, gaps = theta[: len(used)], theta[len(used)], np.exp(theta[len(used) + 1 :])
        cuts = first + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(row, w[col], n)
        cdf = np.concatenate([np.zeros((n, 1)), _sigmoid(cuts - s[:, None]), np.ones((n, 1))], axis=1)
        p = np.maximum(cdf[np.arange(n), grades + 1] - cdf[np.arange(n), grades], 1e-12)
        slope = cdf * (1 - cdf)
        upper, lower = slope[np.arange(n), grades + 1] / p, slope[np.arange(n), grades] / p
        by_cut = np.array([lower[grades == k + 1].sum() - upper[grades == k].sum() for k in range(levels - 1)])
        grad = np.concatenate([
            np.bincount(col, (upper - lower)[row], len(used)) + penalty * w,
            [by_cut.sum()],
            np.cumsum(by_cut[::-1])[::-1][1:] * gaps,
        ])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - 0.1 * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(dims, np.float32)
    weights[used] = theta[: len(used)]
    cuts = theta[len(used)] + np.concatenate([[0], np.cumsum(np.exp(theta[len(used) + 1 :]))])
    return weights, cuts


def grade(quality: Column, toxic: Column) -> Column:
    """0: toxic, 1: poor, 2: good; null where either is missing."""
    return F.when(toxic == 1, 0).when(toxic.isNotNull() & (quality == 0), 1).when(toxic.isNotNull() & (quality == 1), 2)


def train(docs: DataFrame, ratings: DataFrame, levels: int, rated_rows: int, dims: int, l2: float = 3.0, steps: int = 150, least: int = 3) -> tuple[np.ndarray, np.ndarray] | None:
    """Fit on at most ``rated_rows`` rows of ``ratings`` (``doc_id, grade``), by smallest hash; each
    rating trains with one document, so this also bounds what the fitting task reads."""
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rated_rows)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash")).join(F.broadcast(rated), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = features(dims)
        for b in batches:
            for part in slices(iter([b])):
                index, sizes = make(part.column("text").to_pylist())
                data = [x.astype(np.int32).tobytes() for x in np.split(index, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "hash", "grade")), pa.array(data, pa.binary())], ["doc_id", "hash", "grade", "data"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades, data = [], []
        for b in batches:
            grades += b.column("grade").to_pylist()
            data += [np.frombuffer(x, np.int32) for x in b.column("data").to_pylist()]
        if grades:
            sizes = np.fromiter(map(len, data), np.int64, len(data))
            weights, cuts = fit(np.concatenate(data), sizes, np.array(grades), dims, levels, l2, steps, least)
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([cuts.tolist()], pa.list_(pa.float64()))], ["weights", "cuts"])

    rows = sample.mapInArrow(hashed, "doc_id long, hash long, grade int, data binary")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("hash", "grade", "data")).alias("r")).select("doc_id", "r.grade", "r.data")
    rows = one.repartition(1).sortWithinPartitions("doc_id")
    found = rows.mapInArrow(fitted, "weights binary, cuts array<double>").collect()
    return (np.frombuffer(found[0]["weights"], np.float32), np.array(found[0]["cuts"])) if found else None


def classify(
    docs: DataFrame,
    ratings: DataFrame,
    levels: int = 3,
    rated_rows: int = 20_000,
    dims: int = 1 << 18,
    least_tail: float = 0.6,
) -> DataFrame:
    """``doc_id, expected_grade, tail_probability, kept`` for every row of ``docs``."""
    names = ["expected_grade", "tail_probability"]
    scored = with_grades(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ratings, levels, rated_rows, dims, names)
    return scored.select("doc_id", *names, (F.col("tail_probability") >= least_tail).alias("kept"))


def select(docs: DataFrame, ratings: DataFrame, levels: int = 3, rated_rows: int = 20_000, dims: int = 1 << 18, least_tail: float = 0.6) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose tail probability is large enough."""
    grade, tail = free_names(docs.columns, "_grade", "_tail")
    return with_grades(docs, ratings, levels, rated_rows, dims, [grade, tail]).where(F.col(tail) >= least_tail).drop(grade, tail)


def with_grades(docs: DataFrame, ratings: DataFrame, levels: int, rated_rows: int, dims: int, names: list[str]) -> DataFrame:
    """``docs`` and, under the two ``names``, the expected grade and the probability of the top grade."""
    model = train(docs, ratings, levels, rated_rows, dims)
    weights, cuts = model if model else (np.zeros(dims, np.float32), np.full(levels - 1, -np.inf))
    weights = docs.sparkSession.sparkContext.broadcast(weights)  # dims numbers
    schema = StructType([*docs.schema.fields, *[StructField(n, DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, w = features(dims), weights.value
        for b in slices(batches):
            index, sizes = make(b.column("text").to_pylist())
            s = np.add.reduceat(w[index].astype(np.float64), np.cumsum(sizes) - sizes)
            above = 1 - _sigmoid(cuts - s[:, None])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(above.sum(axis=1)), pa.array(above[:, -1])], schema.names)

    return docs.mapInArrow(run, schema)
