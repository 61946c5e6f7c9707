import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lecturelake.llm import packing as p
from lecturelake.llm.tokens import Encoder, encoder, vocabulary


def layout(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def best(counts, room):
    sums = {0}
    for n, k in counts.items():
        sums |= {s + i * n for s in sums for i in range(k + 1) if s + i * n <= room}
    return max(sums)


def test_fullest_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        room = rng.randint(1, 60)
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(0, 12)))
        chosen = p.fullest(np.array([counts[i] for i in range(61)]), room)
        assert all(counts[n] >= k for n, k in chosen.items())
        assert sum(n * k for n, k in chosen.items()) == best(counts, room)


def test_plan_covers_every_rank_once():
    rng = random.Random(4)
    for _ in range(50):
        histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, 65), rng.randint(1, 30))}
        seen = defaultdict(list)
        for n, a, b, *_ in p.plan(histogram, 64):
            seen[n].append((a, b))
        for n, k in histogram.items():
            at = 0
            for a, b in sorted(seen[n]):
                assert a == at
                at = b
            assert at == k


def test_whole_table(docs, texts):
    out = p.pack_documents(docs, vocabulary(), 2048).collect()
    n = layout(out, 2048)
    assert n <= 1.01 * sum(r["length"] for r in out) / 2048 + 1
    tok = encoder(vocabulary()).tokenizer
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: r["piece"]):
        by[r["doc_id"]].append(r)
    assert by.keys() == texts.keys()
    for d in sorted(texts)[::5]:
        ids = [*tok.encode(texts[d] or "", add_special_tokens=False).ids, 0]
        assert [(r["piece"], r["start"], r["length"]) for r in by[d]] == [(i, s, min(2048, len(ids) - s)) for i, s in enumerate(range(0, len(ids), 2048))]
        for r in by[d]:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


@pytest.mark.parametrize("group", [1, 3, 4096])
def test_small_groups_and_few_bins(spark, group):
    rng = random.Random(group)
    df = spark.createDataFrame([(i, 0, rng.choice([1, 5, 5, 7, 16])) for i in range(300)], "doc_id long, piece int, length long")
    out = p.pack(df, 16, group).collect()
    assert len(out) == 300
    bins = []  # first-fit decreasing, for comparison
    for n in sorted((r["length"] for r in out), reverse=True):
        for i, used in enumerate(bins):
            if used + n <= 16:
                bins[i] += n
                break
        else:
            bins.append(n)
    assert layout(out, 16) <= len(bins)


def test_edges(edge, clashing, empty, rows):
    out = p.pack_documents(edge, vocabulary(), 64)
    assert layout(out.collect(), 64)
    assert sorted(r["length"] for r in out.where("doc_id in (2, 3, 4)").collect()) == [1, 1, 1]
    assert rows(p.pack_documents(clashing, vocabulary(), 64)) == rows(out)
    assert p.pack_documents(empty, vocabulary()).count() == 0


def test_sequences_hold_the_ids(docs):
    few = docs.where("doc_id < 30")
    ids = {(r["doc_id"], r["piece"]): r["ids"] for r in p.pieces(few, vocabulary(), 2048, keep_ids=True).collect()}
    seqs = {r["sequence_id"]: r["ids"] for r in p.sequences(few, vocabulary()).collect()}
    for r in p.pack_documents(few, vocabulary()).collect():
        assert seqs[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids[r["doc_id"], r["piece"]]


def test_encoder_equals_the_library(texts, edge, monkeypatch):
    import lecturelake.llm.tokens as t

    enc = Encoder(vocabulary())
    odd = ["<|endoftext|> Hi<|STARTOFTEXT|>X", "NO\x1dsep é É ́x İI ΑΣ", "İSTANBUL Straße ﬁne é!! ..., a.b,c", "ÀÉ*** x|y| z|", "a　b c", "กำ हिन्दी", "a\x00b", "''s don't"]
    odd += ["<| Hello", "F# code: xs <| List.map", "BELEDİYESİ.", "<|ENDOFTEXT|> a<|endoftext|>b <|EndOfText|>c <|startoftext|>. İ. İ", "\u0958. \u0958", "A<|startoftext|>B<|", "K. Å;"]
    every = [None, "", *odd, *[r["text"] for r in edge.collect()], *list(texts.values())[:80]]
    monkeypatch.setattr(t, "WORDS_KEPT", 50)
    for part in (every, every[::-1]):
        ids, counts = enc.encode(part)
        at = 0
        for text, n in zip(part, counts.tolist(), strict=True):
            assert ids[at : at + n].tolist() == enc.tokenizer.encode(text or "", add_special_tokens=False).ids
            at += n


def test_encoder_equals_the_library_on_random_strings():
    enc, rng = Encoder(vocabulary()), random.Random(5)
    letters = [*"<|>.,!?;:*#$%&'sStTdD aAzZ İıéÉ ß\u0307\u0301\u0958K İ ñ你好👍3٣\n\x1c", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|EndOfText|>", "Hello", "İS", "'ll"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    for k in range(0, len(texts), 1000):
        ids, counts = enc.encode(texts[k : k + 1000])
        found = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert found == [x.ids for x in enc.tokenizer.encode_batch(texts[k : k + 1000], add_special_tokens=False)]


def test_pieces_of_one_id_are_split_over_groups(spark):
    """One id (or none) holds nearly all pieces, equal in every column."""
    rows = [(None, 0, 5)] * 300 + [(1, 0, 5)] * 200 + [(i, 0, 7) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long").repartition(4)
    out = p.pack(df, 16, 10).collect()
    assert len(out) == 520 and layout(out, 16)
    assert Counter(r["doc_id"] for r in out if r["length"] == 5) == {None: 300, 1: 200}
