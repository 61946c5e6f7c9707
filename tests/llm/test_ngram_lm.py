import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lecturelake.llm import ngram_lm as lm


def tokens(text):
    return [*(text or "").encode().lower().split(), b"</s>"]


def discounts(counts):
    n = Counter(counts)
    if not all(n[k] for k in (1, 2, 3, 4)):
        return [0.5, 1.0, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3)]


class Plain:
    """The model's formulas over dictionaries."""

    def __init__(self, texts):
        self.one, self.two = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.one.update(w)
            self.two.update(zip([b"<s>", *w], w, strict=False))
        self.d, self.total, self.follow, self.left = discounts(self.two.values()), Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
        for (h, w), c in self.two.items():
            self.total[h] += c
            self.follow[h][min(c, 3) - 1] += 1
            self.left[w] += 1
        self.low, self.n, self.v = discounts(self.left.values()), sum(self.one.values()), len(self.one)
        spare = sum(self.low[min(c, 3) - 1] for c in self.left.values()) / len(self.two) if self.two else 1.0
        self.unknown = spare / (self.v + 1)

    def lower(self, w):
        c = self.left[w]
        return (max(c - self.low[min(c, 3) - 1], 0) / len(self.two) if c else 0) + self.unknown

    def p(self, h, w):
        if not self.total[h]:
            return self.lower(w)
        c = self.two[h, w]
        spare = sum(a * b for a, b in zip(self.d, self.follow[h], strict=True))
        return ((max(c - self.d[min(c, 3) - 1], 0) if c else 0) + spare * self.lower(w)) / self.total[h]

    def score(self, text):
        w = tokens(text)
        base = sum(math.log10((self.one[x] + 0.1) / (self.n + 0.1 * (self.v + 1))) for x in w)
        return base, sum(math.log10(self.p(h, x)) for h, x in zip([b"<s>", *w], w, strict=False))


def kept_out(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0


def check(frame):
    given = frame.select("doc_id", "text").collect()
    plain = Plain([r["text"] for r in given if not kept_out(r["doc_id"])])
    got = sorted(((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["held_out"], r["train_tokens"], r["base_score"], r["score"]) for r in lm.language_model_scores(frame).collect()))
    want = sorted((r["doc_id"] or -1, len(tokens(r["text"])), sum(plain.one[x] > 0 for x in tokens(r["text"])), kept_out(r["doc_id"]), plain.n, *plain.score(r["text"])) for r in given)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    return plain


def test_against_brute_force(docs):
    plain = check(docs)
    h = plain.two.most_common(1)[0][0][0]
    spare = sum(a * b for a, b in zip(plain.d, plain.follow[h], strict=True)) / plain.total[h] * plain.unknown
    assert abs(sum(plain.p(h, w) for w in plain.one) + spare - 1) < 1e-9


@pytest.mark.parametrize("shard_entries", [1000, 50])
def test_shards_do_not_matter(docs, shard_entries, rows):
    few = docs.where("doc_id < 40")
    pick = lambda df: rows(df.selectExpr("doc_id", "n_known", "round(score, 6)"))
    assert pick(lm.score(few, lm.train(few, shard_entries))) == pick(lm.language_model_scores(few))


def test_groups_of_shards_do_not_matter(docs, rows, monkeypatch):
    """With few groups, whose files hold several shards, as on very large tables."""
    few = docs.where("doc_id < 40")
    pick = lambda df: rows(df.selectExpr("doc_id", "n_known", "round(score, 6)"))
    want = pick(lm.language_model_scores(few))
    monkeypatch.setattr(lm, "GROUP_BITS", 2)
    model = lm.train(few, 200)
    assert model["bits"] > 4 and len(model["tops"]) == 5
    words = lm.Words(model)
    ids = np.arange(model["types"] + 1)
    owner = words.owner(ids)
    assert owner[-1] == 1 << model["bits"] and (np.diff(owner) >= 0).all()
    assert all(words.span(s)[0] <= i < words.span(s)[1] for i, s in zip(ids[:-1].tolist(), owner[:-1].tolist(), strict=True))
    lm._SCORERS.clear()
    assert pick(lm.score(few, model)) == want


def test_counts_past_32_bits(tmp_path):
    keys = np.array([3, 5, 9], np.uint64)
    counts = np.array([1, (1 << 32) + 7, 2])
    back = lm.open_run(lm.pack_run(keys, counts, counts * 0), 2)
    assert [x.tolist() for x in back] == [keys.tolist(), counts.tolist(), [0, 0, 0]]
    assert [x.tolist() for x in lm.open_run(lm.pack_run(keys[:0], counts[:0]), 1)] == [[], []]
    _, (sums,) = lm.combine(np.concatenate([keys, keys]), [np.concatenate([counts, counts])])
    assert sums.tolist() == (2 * counts).tolist()
    for name, own in (("0/counts-1", counts), ("0/counts-2", counts[:1])):
        lm.save_counts(str(tmp_path), name, own)
        assert lm.Maps(str(tmp_path), "u32", "u64")[name].tolist() == own.tolist()
    assert sorted(p.name for p in (tmp_path / "0").iterdir()) == ["counts-1.u64", "counts-2.u32"]


def test_edges(edge, clashing, empty, rows):
    check(edge)
    assert rows(lm.language_model_scores(clashing)) == rows(lm.language_model_scores(edge))
    assert lm.language_model_scores(empty).count() == 0


def test_without_training_rows(spark):
    held = next(i for i in range(100) if kept_out(i))
    r = lm.language_model_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"]) == (0, 0, 3) and r["score"] == 0.0


def test_mix_is_a_bijection():
    x = np.random.default_rng(1).integers(0, 1 << 63, 10_000).astype(np.uint64)
    assert (lm.unmix(lm.mix(x)) == x).all()


def test_model_beats_the_base_on_held_out_text(docs):
    r = lm.language_model_scores(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r["s"] > r["b"]
