import hashlib
import math

import numpy as np
import pytest

from lecturelake.llm import product_codes as pc
from lecturelake.llm.oracles import OP13

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd rounds in Python integers; rows of ``vec_id, vector, label`` in any order."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = sorted(((d, [math.floor(4096 * float(np.float32(x))) for x in v], g) for d, v, g in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own, strict=True) if o == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    last = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in x) for x in last]
    by = {}
    for (_, _, g), e in zip(kept, errors, strict=True):
        by[g] = by.get(g, 0) + e
    return sorted(((d, "".join(f"{i:02x}" for _, i in x), e, by[g], sha) for (d, _, g), x, e in zip(kept, last, errors, strict=True)), key=repr)


def of(spark, rows, kind=KIND):
    return spark.createDataFrame(rows, kind).repartition(3)


def test_edges(spark, rows):
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(size=16).round(1).tolist(), i % 3 or None) for i in range(120)]
    data += data[:5] + [(7, data[9][1], 1), (None, data[3][1], None), (None, rng.normal(size=16).tolist(), 2)]
    odd = [(200, None, 1), (201, [None] + [0.0] * 15, 1), (202, [float("nan")] * 16, 1), (203, [float("inf")] + [0.0] * 15, 2), (204, [1.0] * 8, 1), (205, [1.0] * 15, 1), (206, [], 1), (207, [1e9] * 16, 1)]
    got = rows(pc.product_codes(of(spark, data + odd)))
    assert got == plain(data)
    # Columns named like the operation's own are neither read nor in the way.
    more = of(spark, data).selectExpr("*", "'x' AS code", "'x' AS v", "'x' AS error", "1 AS sums", "2 AS upper")
    assert rows(pc.product_codes(more)) == got


@pytest.mark.parametrize("n", [1, 5, 40])
def test_few_rows_and_equal_entries(spark, rows, n):
    data = [(i, [float(i // 2 % 3)] * 8, 0) for i in range(n)]
    assert rows(pc.product_codes(of(spark, data))) == plain(data)


def test_empty(spark):
    for data in ([], [(1, None, 1)]):
        got = pc.product_codes(of(spark, data))
        assert got.collect() == [] and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_bounds_leave_out_most_comparisons_and_change_nothing():
    rng = np.random.default_rng(8)
    centers = rng.integers(-4000, 4000, (12, 2, 4))
    v = (centers[rng.integers(0, 12, 3000)] + rng.integers(-300, 300, (3000, 2, 4))).astype(np.int64)
    history, state, scans = [v[:12].transpose(1, 0, 2)], None, []
    for _ in range(12):
        state, n = pc.assign(v, state, np.stack(history))
        scans.append(n)
        for p in range(2):
            near, least, far = pc.scan(v[:, p], history[-1][p])
            assert (state[0][:, p] == near).all()
            # Bounds hold, loosened by what entries have moved since they were measured.
            own, other = pc.moves(np.stack(history))
            assert (state[1][:, p] + own[p][state[3][:, p], near] >= np.sqrt(least) - 1e-6).all()
            assert (state[2][:, p] - other[p][state[4][:, p], near] <= far + 1e-6).all()
        book = history[-1].copy()
        for p in range(2):
            for e in range(12):
                if (mine := state[0][:, p] == e).any():
                    book[p, e] = v[mine, p].sum(axis=0) // mine.sum()
        history.append(book)
    assert scans[0] == 6000 and sum(scans[6:]) < 0.2 * 6 * 6000


def test_net_moves_are_below_summed_moves():
    rng = np.random.default_rng(1)
    history = rng.integers(-100, 100, (6, 1, 4, 3))
    own, other = pc.moves(history)
    steps = np.sqrt(((history[1:] - history[:-1]) ** 2).sum(axis=-1))
    for t in range(6):
        assert (own[0, t] <= steps[t:, 0].sum(axis=0) + 1e-9).all()
        for e in range(4):
            assert other[0, t, e] == max(own[0, t, k] for k in range(4) if k != e)


def test_codes_stand_for_their_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    history, table = pc.fit(rows)
    got = {r["vec_id"]: r for r in pc.coded(table, history).collect()}
    total = base = 0.0
    mean = np.mean([r["embedding"] for r in rows.collect()], axis=0)
    for r in rows.collect():
        total += ((pc.decode(bytes(got[r["vec_id"]]["code"]), history[-1]) - r["embedding"]) ** 2).sum()
        base += ((mean - r["embedding"]) ** 2).sum()
    assert total < 0.8 * base


def test_query_agrees_with_sql(spark, duck, sf_dir, agree):
    from lecturelake.llm.queries import op13_vector_codes

    agree(op13_vector_codes(spark, sf_dir), duck.sql(OP13))
