import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lecturelake.llm import prefix_trie as t
from lecturelake.llm.oracles import OP11

KIND = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in by.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        saved[p] += (len(members[p]) - 1) * (len(p[-1][1].encode().split()) if p else 0)
        if p:
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha))
    return sorted(out, key=repr)


def talks(seed, n):
    """Conversations that share beginnings, a third of them copies of one."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        if c % 3 == 0:
            said = [("user", "hello there you"), ("assistant", "hi"), ("user", "bye now")]
        else:
            said = [(rng.choice(["user", "assistant"]), rng.choice(["a b", "a  b", "c", "", "x y z"])) for _ in range(rng.randint(1, 7))]
        rows += [(c, i, *x) for i, x in enumerate(said)]
    rows += [(n, i, "user", f"only here {i}") for i in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit,held", [(1 << 16, 1 << 18), (50, 2), (3, 1), (2, 5)])
def test_totals_are_those_of_plain_code(spark, rows, limit, held):
    data = talks(limit, 130)
    got = t.conversation_trie(spark.createDataFrame(data, KIND).repartition(3), limit, held)
    assert got.columns == COLUMNS
    assert rows(got) == plain(data)


def test_edges(spark, rows):
    data = [
        (0, None, None, None), (0, 1, "user", "first"), (0, 1, "user", "first"), (0, 1, "system", "first"), (0, 2, None, "x"),
        (1, 5, "user", "first"), (3, 1, None, None), (5, 2, "user", "tab\tand\x0bnbsp word"), (5, 1, "", "first"),
        (None, 1, "user", "lost"), (None, None, None, None), (20, 1, "user", "first"), (25, 1, "user", "only"), (47, 1, "a", "b"), (48, 1, "ab", ""),
        (7, 1, "user", "word " * 50_000), (7, 1, "user", "word " * 50_000),
    ]
    df = spark.createDataFrame(data, KIND)
    want = plain(data)
    assert rows(t.conversation_trie(df)) == want
    more = df.select("*", *[F.lit("x").alias(c) for c in ("o", "h", "n", "base", "depth", "k1", "top", "taken")])
    assert rows(t.conversation_trie(more, 4, 1)) == want
    assert t.conversation_trie(spark.createDataFrame([], KIND)).collect() == []
    assert t.conversation_trie(spark.createDataFrame([(None, 1, "user", "lost")], KIND)).collect() == []


def test_a_turnless_conversation_is_a_member_of_the_root(spark, rows):
    """3 takes as many turns of its own away as it gets from a conversation that isn't there."""
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    data = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    got = rows(t.conversation_trie(spark.createDataFrame(data, KIND)))
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_shards_are_bounded_and_whole(spark):
    """No shard of the first round holds more nodes than the limit, and only its top's parent lies outside."""
    data = talks(9, 200)
    paths = t.materialize(t.paths(t.rebuilt(spark.createDataFrame(data, KIND))))
    nodes = t.with_shards(t.nodes_of(paths, 30), paths).collect()
    assert len(nodes) == len({(r["k1"], r["k2"]) for r in nodes}) == paths.select("k1", "k2").distinct().count()
    shard = {(r["k1"], r["k2"]): (r["round"], r["s1"], r["s2"]) for r in nodes}
    sizes = {}
    for r in nodes:
        sizes[shard[r["k1"], r["k2"]]] = sizes.get(shard[r["k1"], r["k2"]], 0) + 1
        if (r["k1"], r["k2"]) != (r["s1"], r["s2"]):
            assert shard[r["p1"], r["p2"]] == shard[r["k1"], r["k2"]]
        elif r["depth"]:
            assert shard[r["p1"], r["p2"]][0] > r["round"]
    assert max(n for (r, *_), n in sizes.items() if r == 0) <= 30
    assert len({r for r, *_ in sizes}) > 1


def test_queue_spills_and_keeps_order():
    rng = random.Random(4)
    queue, model, out, want = t.SpillingQueue(held=7, width=2), [], [], []
    for i in range(3000):
        if rng.random() < 0.6 or not model:
            x = (rng.randrange(-50, 50), i)
            queue.push(x)
            model.append(x)
        else:
            model.sort()
            want.append(model.pop(0))
            assert queue.top() == want[-1]
            out.append(queue.pop())
    assert out == want and queue.spilled > 10
    assert [queue.pop() for _ in range(len(model))] == sorted(model) and queue.top() is None and not len(queue)


def test_query_agrees_with_sql(spark, duck, sf_dir, agree):
    from lecturelake.llm.queries import op11_prefix_trie

    agree(op11_prefix_trie(spark, sf_dir), duck.sql(OP11))
