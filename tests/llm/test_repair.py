import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lecturelake.llm import repair as r
from lecturelake.llm.tokens import encoder, vocabulary

HOW = {"passes": 6, "per_pass": 100, "least": 2}


def shard_of(docs, terminals=1000):
    seq = np.array([x for d in docs for x in [*d, terminals - 1]], np.uint16)
    return r.Shard(r.pack_shard(list(range(len(docs))), np.array([len(d) + 1 for d in docs]), seq, terminals, **HOW), 2)


@pytest.mark.parametrize("seed", range(5))
def test_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.choice([1, 2, 3, 7, 998], rng.integers(0, 400)).tolist() for _ in range(20)] + [[5] * 1000, [], [1, 2] * 300]
    s = shard_of(docs)
    whole = [x for d in docs for x in [*d, 2]]
    assert s.ids().tolist() == whole and len(s.symbols) < len(whole)
    for i in (0, 7, 20, 21, 22):
        assert s.ids(i, i + 1).tolist() == [*docs[i], 2]
    assert s.ids(3, 6).tolist() == [x for d in docs[3:6] for x in [*d, 2]]
    assert s.rule_sizes.tolist() == s.tables[2][1000:].tolist()


def test_runs_of_one_symbol_shrink():
    assert len(shard_of([[5] * 1024]).symbols) < 40


@pytest.mark.parametrize("ids", [range(1, 641), np.random.default_rng(1).integers(1, 900, 640).tolist()])
def test_each_of_many_copies_becomes_one_symbol(ids):
    seq, rules = r.replace_pairs(np.array([*ids, 999] * 200, np.uint16), 1000)
    assert len(seq) == 400 and len(set(seq[::2].tolist())) == 1 and (seq[1::2] == 999).all()


def pair_counts(seq):
    return Counter((a, b) for a, b in itertools.pairwise(seq.tolist()) if 999 not in (a, b))


@pytest.mark.parametrize("seed", range(3))
def test_no_frequent_pair_is_left(seed):
    ids = np.random.default_rng(seed).zipf(1.3, 60_000) % 998
    seq, rules = r.replace_pairs(np.append(ids, 999).astype(np.uint16), 1000)
    left = pair_counts(seq)
    assert max(left.values()) < 8 and not set(left) & set(map(tuple, rules.tolist()))


def test_symbols_are_used_up_before_a_frequent_pair_is_left():
    terminals = r.SYMBOLS - 50
    ids = np.random.default_rng(3).integers(0, 30, 20_000)
    seq, rules = r.replace_pairs(np.append(ids, terminals - 1).astype(np.uint16), terminals)
    assert len(rules) == len(set(map(tuple, rules.tolist()))) == 50
    assert not {*zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True)} & set(map(tuple, rules.tolist()))


def test_pairs_that_share_a_slot_are_both_counted():
    pair = lambda a, b: np.array([a << 16 | b], np.uint32)
    taken = {int(r._slots(pair(a, b))[0]): (a, b) for a in range(1, 500) for b in range(500, 998)}
    often, rare = next(((a, b), taken[s]) for a in range(500, 998) for b in range(1, 500) if (s := int(r._slots(pair(a, b))[0])) in taken)
    seq, rules = r.replace_pairs(np.array([*often, 999] * 20 + [*rare, 999], np.uint16), 1000)
    assert rules.tolist() == [list(often)] and len(seq) == 43


def test_not_a_shard():
    with pytest.raises(ValueError):
        r.Shard(b"XXXX" + bytes(30), 2)


def expected(frame):
    tok, at, out = encoder(vocabulary()).tokenizer, 0, []
    for d, t in sorted(((x["doc_id"], x["text"]) for x in frame.collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard_ids", [1 << 21, 2000])
def test_whole_table(docs, shard_ids):
    few = docs.where("doc_id < 120").repartition(5)
    assert sorted(tuple(x) for x in r.token_shards(few, vocabulary(), shard_ids=shard_ids).collect()) == expected(few)


def test_edges(edge, clashing, empty, rows):
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted((tuple(x) for x in r.token_shards(edge, vocabulary()).collect()), key=key) == expected(edge)
    assert rows(r.token_shards(clashing, vocabulary())) == rows(r.token_shards(edge, vocabulary()))
    assert r.token_shards(empty, vocabulary()).count() == 0


def test_special_tokens_capitals_and_one_id_for_many_rows(spark):
    texts = ["<| Hello", "F# code: xs <| List.map", "BELEDİYESİ.", "x <|ENDOFTEXT|>", "A<|endoftext|>B", "plain Words"]
    df = spark.createDataFrame([(i % 2 or None, texts[i % 6]) for i in range(60)], "doc_id long, text string").repartition(6)
    got = sorted((tuple(x) for x in r.token_shards(df, vocabulary(), shard_ids=40).collect()), key=lambda x: x[1])
    tok = encoder(vocabulary()).tokenizer
    want = [(i % 2 or None, zlib.crc32(np.array([*tok.encode(texts[i % 6], add_special_tokens=False).ids, 2], "<u4").tobytes())) for i in range(60)]
    assert Counter((x[0], x[3]) for x in got) == Counter(want)
    assert [x[1] for x in got] == [0, *itertools.accumulate(x[2] for x in got)][:-1]
    assert [x[0] for x in got] == [None] * 30 + [1] * 30


def test_pairs_that_share_a_slot_are_found_by_order():
    pairs = np.unique(np.random.default_rng(5).integers(0, 1 << 32, 60_000).astype(np.uint32))
    some = pairs[::2]
    assert len(set(r._slots(some).tolist())) < len(some)
    found, place = r._known(pairs, r._slots(pairs), some)
    want, at = r._among(pairs, some)
    assert (found == want).all() and found.sum() == len(some) and (place[found] == at[want]).all()


def test_words_with_marks_are_kept_once():
    enc, marks = type(encoder(vocabulary()))(vocabulary()), ["", ".", ",", "!?", "***", ".,;:"]
    texts = [" ".join(f"{w}{m}" for m in marks for w in ("alpha", "gamma", "words")), None, " \n ", "alpha\x0bGAMMA.\x1cx  don't. x1. ... ñu.. a|b"]
    before = len(enc.place)
    ids, counts = enc.encode(texts[:1])
    assert len(enc.place) - before == 3 + len(marks) - 1
    ids, counts = enc.encode(texts)
    want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [x for t in want for x in t] and counts.tolist() == [len(t) for t in want]
    again, sizes = enc.encode(pa.array(texts))
    assert again.tolist() == ids.tolist() and sizes.tolist() == counts.tolist()
    assert [len(x) for x in enc.encode([])] == [0, 0]
