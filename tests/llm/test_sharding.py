import hashlib
from collections import defaultdict

import pytest

from lecturelake.llm import sharding as s
from lecturelake.llm.oracles import ORACLES
from lecturelake.llm.queries import queries


def test_query(spark, sf_dir, duck, agree):
    agree(queries()["op9_hash_shards"](spark, sf_dir), duck.sql(ORACLES["op9_hash_shards"]))


def bits(doc_id):
    return bin(int(hashlib.md5(b"" if doc_id is None else str(doc_id).encode()).hexdigest()[:15], 16))[2:].zfill(60)


def split(rows, limit, depth=0):
    """Shards of (bits, bytes) by splitting on one more bit."""
    if sum(b for _, b in rows) <= limit or len(rows) == 1:
        return {(k, rows[0][0][:depth] or "-") for k, _ in rows}
    out = set()
    for bit in "01":
        own = [r for r in rows if r[0][depth] == bit]
        out |= split(own, limit, depth + 1) if own else set()
    return out


@pytest.mark.parametrize("limit, spread", [(1 << 20, 6), (20_000, 0), (3_000, 2), (50, 1)])
def test_against_splitting(docs, texts, limit, spread):
    rows = [(bits(d), len((t or "").encode())) for d, t in texts.items()]
    got = s.assign(docs, limit, spread=spread, more=2).collect()
    assert {(bits(r["doc_id"]), r["shard"]) for r in got} == split(rows, limit)
    sums = defaultdict(int)
    for r in got:
        sums[r["shard"]] += r["bytes"]
    assert all(r["shard_bytes"] == sums[r["shard"]] and (sums[r["shard"]] <= limit or r["shard_docs"] == 1) for r in got)
    assert all(r["depth"] == (0 if r["shard"] == "-" else len(r["shard"])) for r in got)


def test_equal_ids_are_split_by_place(spark):
    df = spark.createDataFrame([(1, "x" * 10)] * 40 + [(2, "y" * 10)] * 3, "doc_id long, text string")
    got = s.assign(df, 45).collect()
    sums = defaultdict(int)
    for r in got:
        sums[r["shard"]] += r["bytes"]
    assert len(got) == 43 and max(sums.values()) <= 45 and max(r["depth"] for r in got) > 60


def test_edges(edge, clashing, empty, rows):
    assert s.assign(edge, 100).count() == edge.count()
    assert rows(s.assign(clashing, 100)) == rows(s.assign(edge, 100))
    assert s.assign(empty, 100).count() == 0


def test_written_shards(spark, docs, tmp_path):
    s.write_shards(docs, str(tmp_path / "out"), 100_000)
    back = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(docs.columns) < set(back.columns)


def test_directory(docs):
    """Every bucket's slots are the ones its documents' hashes begin with, and no slot is two buckets'."""
    placed = s.assign(docs, 20_000)
    rows = s.directory(placed).orderBy("first_slot").collect()
    deep = max(r["depth"] for r in rows)
    assert {r["global_depth"] for r in rows} == {deep} and deep > 3
    runs = {r["shard"]: range(int(r["first_slot"], 2), int(r["first_slot"], 2) + r["slots"]) for r in rows}
    assert len(runs) == len(rows) and all(len(x) == 2 ** (deep - r["depth"]) for x, r in zip(runs.values(), rows, strict=True))
    order = list(runs.values())
    assert all(a.stop <= b.start for a, b in zip(order, order[1:], strict=False)) and order[-1].stop <= 2**deep
    for r in placed.collect():
        assert int(bits(r["doc_id"])[:deep], 2) in runs[r["shard"]]


def test_directory_of_one_bucket(edge, empty):
    (row,) = s.directory(s.assign(edge, 1 << 30)).collect()
    assert (row["shard"], row["global_depth"], row["first_slot"], row["slots"]) == ("-", 0, "", 1)
    assert s.directory(s.assign(empty, 100)).count() == 0


def test_carried_columns_keep_clear_of_the_results(clashing, spark, tmp_path):
    assert s.carried_names(["doc_id", "shard", "_shard", "Bytes"]) == {"doc_id": "doc_id", "shard": "__shard", "_shard": "_shard", "Bytes": "_Bytes"}
    s.write_shards(clashing, str(tmp_path / "out"), 100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == clashing.count() and back.where("_shard = 'x' and _bytes = 'x'").count() == back.count()


def test_global_depth_is_that_of_the_rows(docs, rows):
    from lecturelake.llm.sharding import assign, assign_with_slots, with_slots

    for limit in (1 << 12, 1 << 16, 1 << 40):
        assert rows(assign_with_slots(docs, limit)) == rows(with_slots(assign(docs, limit)))


def test_what_a_session_has_written_can_be_removed(spark, docs):
    from pathlib import Path

    from lecturelake.llm.common import clean_up, discard, materialize

    one, two = (materialize(docs.limit(5)) for _ in range(2))
    paths = [Path(x._shared_path.removeprefix("file://")) for x in (one, two)]
    discard(one)
    assert not paths[0].exists() and paths[1].exists() and two.count() == 5
    assert clean_up(spark) >= 1 and not paths[1].exists()
    assert clean_up(spark) == 0
