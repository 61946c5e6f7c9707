from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lecturelake.llm import mixing as m
from lecturelake.llm.oracles import ORACLES
from lecturelake.llm.queries import queries


def test_query(spark, sf_dir, duck, agree):
    agree(queries()["op6_source_mix"](spark, sf_dir), duck.sql(ORACLES["op6_source_mix"]))


def targets(sizes, weights=(3, 1, 2)):
    """Reshare until no target is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        share = sum(w[s] for s in sizes if s not in capped)
        t = {s: 2.0 * sizes[s] if s in capped else left * w[s] / share for s in sizes}
        over = {s for s in sizes if s not in capped and t[s] >= 2 * sizes[s]}
        if not over:
            return t
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 900, None: 40}, {"a": 1}, {"b": 0, "a": 7}, {f"s{i}": i * i for i in range(25)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in m.source_targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    assert got == pytest.approx(targets(sizes))


def test_each_source_meets_its_target(docs):
    out = m.mix(docs, rows_per_interval=7).collect()
    taken, target = defaultdict(int), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    again = m.mix(docs.repartition(3), rows_per_interval=500).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in out)


def test_smaller_keys_are_taken_first(docs):
    for _, own in _by_source(m.mix(docs).collect()):
        part = [(r["key"], r["taken"] / r["size"]) for r in own if r["size"]]
        shares = [t for _, t in sorted(part)]
        assert shares == sorted(shares, reverse=True)


def _by_source(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["source"]].append(r)
    return out.items()


def test_heavier_documents_come_earlier(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, "a b c d").otherwise("a#### b#### c#### d####").alias("text"))
    first = m.mix(df, share=0.3, cap=1.0).where("taken > 0")
    assert first.where("doc_id % 2 = 0").count() > 2 * first.where("doc_id % 2 = 1").count()


def test_edges(edge, clashing, empty, rows):
    out = m.mix(edge).collect()
    assert len(out) == edge.count() and all(r["taken"] == 0 for r in out if r["size"] == 0)
    assert rows(m.mix(clashing)) == rows(m.mix(edge))
    assert m.mix(empty).count() == 0 and m.take(empty).count() == 0


def test_rows_of_one_id_do_not_depend_on_their_order(spark):
    """Repeated and missing ids with texts of other sizes: any order of rows gives the same mix."""
    given = [(i, "w " * (1 + (7 * k + (i or 0)) % 13), "s") for i in (1, 2, None) for k in range(40)] + [(1, "w " * 5, "s")] * 3
    frames = [spark.createDataFrame(x, "doc_id long, text string, source string").repartition(n) for x, n in ((given, 1), (given[::-1], 3), (given[60:] + given[:60], 5))]
    want = [Counter(m.mix(f, share=0.7).select("doc_id", "size", "taken", "key").collect()) for f in frames]
    assert want[0] == want[1] == want[2] and sum(want[0].values()) == len(given)
    nameless = [r for r in want[0] if r["doc_id"] is None]
    assert len({r["key"] for r in nameless}) == len(nameless) == 13
    texts = [Counter(r["text"] for r in m.take(f, share=0.7).collect()) for f in frames]
    assert texts[0] == texts[1] == texts[2]


def test_levels_of_the_running_sum_do_not_matter(docs):
    pick = lambda n: sorted((r["doc_id"], r["taken"]) for r in m.mix(docs, rows_per_interval=n).collect())
    assert pick(1) == pick(3) == pick(10**6)


def test_take_repeats_and_cuts(docs):
    out = m.take(docs)
    assert out.columns == docs.columns
    words = out.select(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))).first()[0]
    assert words == m.mix(docs).agg(F.sum("taken")).first()[0]
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0
