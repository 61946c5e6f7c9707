import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lecturelake.llm import quality_classifier as c


def numeric_gradient(f, x, e=1e-5):
    out = np.zeros_like(x)
    for i in range(len(x)):
        a, b = x.copy(), x.copy()
        a[i] += e
        b[i] -= e
        out[i] = (f(a) - f(b)) / (2 * e)
    return out


@pytest.mark.parametrize("levels", [2, 3, 5])
def test_fit_finds_the_optimum(levels):
    """At the fitted point the penalised likelihood has no slope left."""
    rng = np.random.default_rng(levels)
    n, dims = 400, 6
    rows = [np.flatnonzero(rng.random(dims) < 0.5) for _ in range(n)]
    truth = rng.normal(size=dims) * 2
    score = np.array([truth[r].sum() for r in rows]) + rng.logistic(size=n)
    grades = np.searchsorted(np.quantile(score, np.arange(1, levels) / levels), score)
    sizes = np.array([len(r) for r in rows])
    w, cuts = c.fit(np.concatenate(rows), sizes, grades, dims, levels, 1.0, 3000, 1)
    assert (np.diff(cuts) > 0).all()

    col, row = np.concatenate(rows), np.repeat(np.arange(n), sizes)
    penalty = 1 / c.ease(col, row, grades, dims) ** 2

    def loss(x):
        s = np.array([x[:dims][r].sum() for r in rows])
        cdf = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-(x[dims:] - s[:, None]))), np.ones((n, 1))], axis=1)
        return -np.log(cdf[np.arange(n), grades + 1] - cdf[np.arange(n), grades]).sum() + 0.5 * (penalty * x[:dims] ** 2).sum()

    assert np.abs(numeric_gradient(loss, np.concatenate([w.astype(float), cuts]))).max() < 0.2


def ratings(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", c.grade(F.col("quality"), F.col("toxic")).alias("grade"))


def test_held_out_accuracy(spark):
    """Fitted on two thirds of the ratings, good and other documents of the rest come apart."""
    d = "/root/testdata/sf0.1"
    docs, rated = spark.read.parquet(f"{d}/documents.parquet"), ratings(spark, d)
    out = c.classify(docs, rated.where("doc_id % 3 <> 0")).join(rated.where("doc_id % 3 = 0"), "doc_id")
    share = {r["grade"]: r["k"] for r in out.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[2] > 0.98 and share[0] < 0.1 and share[1] < 0.1


def test_probabilities(spark, docs, sf_dir):
    out = c.classify(docs, ratings(spark, sf_dir))
    assert out.count() == docs.count()
    assert out.where("not (tail_probability between 0 and 1) or not (expected_grade between 0 and 2) or expected_grade < tail_probability").count() == 0
    again = c.classify(docs.repartition(3), ratings(spark, sf_dir).repartition(2))
    assert out.join(again.withColumnRenamed("tail_probability", "t"), "doc_id").where("abs(t - tail_probability) > 1e-9").count() == 0


SPACE = re.compile(rb"[\x20\x09-\x0d]+")


def plain_features(text, dims):
    """Feature numbers of a text, from the definition."""
    number = lambda kind, value: xxhash.xxh64_intdigest(kind + value) % dims
    words = [w for w in SPACE.split(re.sub(rb"[A-Z]+", lambda x: x[0].lower(), (text or "").encode())) if w]
    out, cores, marked = set(), set(), 0
    for w in words:
        n = len(w)
        while n and w[n - 1] in c.MARKS:
            n -= 1
        start = 0
        while start < n and w[start] in c.MARKS:
            start += 1
        cores.add(number(b"word ", w[start:n]))
        out |= {number(b"word ", w[start:n]), number(b"end ", w[n:])}
        marked += any(x not in b".,;:" for x in w[n:])
    k, size = max(len(words), 1), math.ceil(math.log2(len(words) + 1))
    out.add(number(b"distinct ", b"%d of %d" % (10 * len(cores) // k, min(size, 8))))
    return out | {number(b"size ", b"%d" % size), number(b"marked ", b"%d" % (10 * marked // k))}


def test_against_brute_force(spark, docs, sf_dir, texts):
    """Features by the definition, the fit on them, and the model's formulas, for a whole table."""
    dims = 1 << 18
    rated = {r["doc_id"]: r["grade"] for r in ratings(spark, sf_dir).collect() if r["grade"] is not None}
    own = {d: sorted(plain_features(t, dims)) for d, t in texts.items()}
    train = sorted(d for d in rated if d in own)
    w, cuts = c.fit(np.concatenate([own[d] for d in train]), np.array([len(own[d]) for d in train]), np.array([rated[d] for d in train]), dims, 3, 3.0, 150, 3)
    out = c.classify(docs, ratings(spark, sf_dir)).collect()
    assert len(out) == len(texts)
    for r in out:
        s = math.fsum(float(w[i]) for i in own[r["doc_id"]])
        above = [1 / (1 + math.exp(x - s)) for x in cuts]
        assert (r["expected_grade"], r["tail_probability"]) == pytest.approx((sum(above), above[-1]), abs=1e-6)
        assert r["kept"] == (above[-1] >= 0.6) or abs(above[-1] - 0.6) < 1e-6


def test_copies_of_a_row_train_once(spark):
    """Thousands of rows of two rated ids give the model of two rows."""
    rated = spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, grade int")
    one = spark.createDataFrame([(1, "good words here"), (2, "bad stuff there")], "doc_id long, text string")
    many = one.union(spark.range(3000).select(F.lit(1).cast("long"), F.lit("good words here")))
    (w, cuts), (v, same) = c.train(one, rated, 3, 10, 1 << 10, least=1), c.train(many.repartition(4), rated, 3, 10, 1 << 10, least=1)
    assert (w == v).all() and (cuts == same).all()


def test_edges(spark, edge, clashing, empty, rows):
    rated = spark.createDataFrame([(1, 2), (1, 2), (5, 0), (None, 1), (3, None), (7, 1)], "doc_id long, grade int")
    out = c.classify(edge, rated)
    assert out.count() == edge.count()
    assert rows(c.classify(clashing, rated)) == rows(out)
    assert c.classify(empty, rated).count() == 0
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert c.classify(edge, none).where("kept and tail_probability = 1").count() == edge.count()
    assert c.select(clashing, none).columns == clashing.columns


def test_sample_bound(spark, docs, sf_dir):
    assert c.train(docs, ratings(spark, sf_dir), 3, 10, 1 << 10) is not None


def test_grades(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (0, 0), (1, 0), (None, 0), (1, None)], "q int, t int")
    assert [r[0] for r in df.select(c.grade(F.col("q"), F.col("t"))).collect()] == [0, 0, 1, 2, None, None]
