import random

import numpy as np
from pyspark.sql import functions as F

from lecturelake.llm import simhash as s
from lecturelake.llm.components import components


def brute_components(values):
    """Smallest index reachable, for u64 values by brute force."""
    v, top = np.array(values, np.uint64), list(range(len(values)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(v)):
        for j in (np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 3) + i + 1).tolist():
            a, b = root(i), root(j)
            top[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(v))]


def test_fingerprints(edge):
    import xxhash

    def plain(text):
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    texts = [r["text"] for r in edge.collect() if len(r["text"] or "") < 1000] + ["A b C", "one", "one two", "a a a a a"]
    assert s.fingerprints_of(texts).tolist() == [plain(t) for t in texts]
    assert s.fingerprints_of([]).tolist() == []
    # Very long texts, hashed in blocks, beside short ones.
    rng = random.Random(1)
    gaps = [" ", "  ", "\n", "\t \r\n", "\x0b"]
    long = "".join(rng.choice(["Der", "word", "é", "x" * 9]) + rng.choice(gaps) for _ in range(300_000))
    texts = ["a b c d", long, None, "  " + long[:-1] + "End", " " * (1 << 21), "y" * (1 << 21), "one two"]
    assert s.fingerprints_of(texts).tolist() == [plain(t) for t in texts]


def linked(spark, values, in_place=s.COMPARED_IN_PLACE):
    fps = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in sorted(set(values))], "fp long")
    label = {r["node"]: r["label"] for r in components(s.links(fps, in_place)).collect()}
    groups = {}
    for v in values:
        k = int(np.uint64(v).astype(np.int64))
        groups.setdefault(label.get(k, k), set()).add(v)
    return sorted(map(sorted, groups.values()))


def test_links_find_every_pair_within_three_bits(spark):
    rng = random.Random(7)
    values = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(60):
        at = rng.getrandbits(64)
        values.append(at)
        for _ in range(rng.randint(0, 5)):
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4, 5])):
                at ^= 1 << b
            values.append(at)
    # All three bits in one block, two and one, one each.
    values += [5 << 40, (5 << 40) ^ 0b10101, (5 << 40) ^ 0b10101 ^ (3 << 21) ^ (1 << 63), (5 << 40) ^ 0b10101 ^ (3 << 21) ^ (1 << 63) ^ 1 ^ (1 << 30) ^ (1 << 50)]
    values = sorted(set(values))
    groups = {}
    for v, c in zip(values, brute_components(values), strict=True):
        groups.setdefault(c, set()).add(v)
    expected = sorted(map(sorted, groups.values()))
    assert linked(spark, values) == expected
    assert linked(spark, values, in_place=0) == expected


def test_dense_clouds(spark):
    """Many fingerprints around a few, linked in part: variants that many share, and several groups at one."""
    rng = random.Random(11)
    values = set()
    for spread in (2, 4, 6, 8):
        at = rng.getrandbits(64)
        near = rng.sample(range(64), 14)
        for _ in range(150):
            v = at
            for b in rng.sample(near, rng.randint(0, spread)):
                v ^= 1 << b
            values.add(v ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)))
            values.add(v)
    values = sorted(values)
    groups = {}
    for v, c in zip(values, brute_components(values), strict=True):
        groups.setdefault(c, set()).add(v)
    expected = sorted(map(sorted, groups.values()))
    assert linked(spark, values) == expected
    assert linked(spark, values, in_place=0) == expected


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(1000, x) for x in range(1001, 1100)] + [(rng.randint(2000, 2060), rng.randint(2000, 2060)) for _ in range(40)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    low = {}
    for a, b in edges:
        low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(60):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {k: v for k, v in low.items() if any(a != b and k in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_whole_table(spark, docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in s.near_duplicates(docs).collect()}
    ids = sorted(got)
    values = [int(got[i][0], 16) for i in ids]
    assert [got[i][1] for i in ids] == [ids[c] for c in brute_components(values)]


def test_edges(edge, clashing, empty, rows):
    out = s.near_duplicates(edge).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert len(out) == edge.count() and by[2] == by[3] == by[4] == {("0" * 16, 2)}
    assert by[6] == by[1] and next(iter(by[1]))[1] == 1 and next(iter(by[None]))[1] is None
    assert rows(s.near_duplicates(clashing)) == rows(s.near_duplicates(edge))
    assert s.near_duplicates(empty).count() == 0 and s.one_of_each(empty).count() == 0


def test_one_of_each(edge):
    out = s.one_of_each(edge)
    assert out.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "5", "7", "None"]
    assert out.where(F.col("doc_id") == 1).count() == 1
