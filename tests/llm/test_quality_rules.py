import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from lecturelake.llm import quality_rules as q
from lecturelake.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def buckets(text, n):
    w = [x.encode() for x in WORD.findall(text or "")]
    one = [xxhash.xxh64_intdigest(x, 42) for x in w]
    two = [xxhash.xxh64_intdigest(b, a) for a, b in zip(one, w[1:], strict=False)]
    return [signed(h) % n for h in one + two]


def brute(texts, trusted, n, alpha, threshold):
    raw, target = Counter(), Counter()
    for d, t in texts:
        raw.update(buckets(t, n))
        if d in trusted:
            target.update(buckets(t, n))
    r, t = sum(raw.values()), sum(target.values())
    ratio = {b: math.log((target[b] + alpha) / (t + alpha * n)) - math.log((raw[b] + alpha) / (r + alpha * n)) if t else 0.0 for b in raw}
    out = []
    for d, text in texts:
        own, m = buckets(text, n), measures(text)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        llr = sum(ratio[b] for b in own) / len(own) if own else 0.0
        out.append((d, *m, failed, llr, not failed and llr >= threshold))
    return out


def check(spark, frame, trusted, n=512):
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    got = sorted((r["doc_id"] or -1, *[r[c] for c in q.MEASURES], r["base_failed"], r["llr"], r["kept"]) for r in q.quality_rules(frame, ids, n).collect())
    want = sorted((r[0] or -1, *r[1:]) for r in brute([(r["doc_id"], r["text"]) for r in frame.collect()], set(trusted), n, 1.0, -0.1))
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert all(abs(a[7] - b[7]) < 1e-9 and (a[8] == b[8] or abs(a[7] + 0.1) < 1e-9) for a, b in zip(got, want, strict=True))


def test_against_brute_force(spark, docs):
    check(spark, docs, range(0, 10_000, 3), 1 << 16)


def test_edges(spark, edge, clashing, empty, rows):
    check(spark, edge, [1, 5])
    ids = spark.createDataFrame([(1,)], "doc_id long")
    assert rows(q.quality_rules(clashing, ids)) == rows(q.quality_rules(edge, ids))
    assert q.quality_rules(empty, ids).count() == 0 and q.select(empty, ids).count() == 0


def test_without_trusted_rows_only_the_base_rule_decides(spark, docs):
    none = spark.createDataFrame([], "doc_id long")
    assert q.quality_rules(docs, none).where(F.col("kept") == F.col("base_failed")).count() == 0


def test_selection_keeps_whole_rows(spark, docs):
    ids = q.trusted_ids(spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int"))
    assert ids.count() == 50
    kept = {r["doc_id"] for r in q.quality_rules(docs, ids).where("kept").collect()}
    out = q.select(docs, ids)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == kept


def test_every_trusted_document_counts(spark, tmp_path):
    """With all documents trusted both multinomials are the same, however many documents there are."""
    docs = spark.range(20_400).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), (F.col("id") % 50).cast("string"), F.lit(" x")).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (queries()["op1_quality_rules"](spark, str(tmp_path)), q.quality_rules(docs, docs)):
        assert rows.count() == 20_400 and rows.where(F.abs("llr") > 1e-12).count() == 0


@pytest.mark.parametrize("text, n", [("a b c a b c", 6), ("a a a a", 4), ("a b", 0), ("x a b c y a b c z", 6)])
def test_repeated_windows(spark, text, n):
    assert q.base_measures(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["n_repeat_words"] == n
