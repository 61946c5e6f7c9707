"""Each stage against its operator, on what its predecessor kept, and the whole against plain code."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as p
from lecturelake.llm import mixing, packing, quality_classifier, quality_rules, simhash, tokens
from lecturelake.llm.common import materialize
from lecturelake.llm.tokens import vocabulary


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert [n for n, _ in p.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "source_mix", "packing"]

    one = materialize(p.rules(spark, docs, sf_dir))
    judged = quality_rules.quality_rules(docs, quality_rules.trusted_ids(labels))
    assert ids(one) == ids(judged.where("kept")) and one.columns == docs.columns

    two = materialize(p.classifier(spark, one, sf_dir))
    rated = labels.select("doc_id", quality_classifier.grade(labels["quality"], labels["toxic"]).alias("grade"))
    assert ids(two) == ids(quality_classifier.classify(one, rated).where("kept")) and two.columns == docs.columns

    three = materialize(p.near_dedup(spark, two, sf_dir))
    groups = defaultdict(set)
    for r in simhash.near_duplicates(two).collect():
        groups[r["component_id"]].add(r["doc_id"])
    assert Counter(r["doc_id"] for r in three.collect()) == Counter(min(g) for g in groups.values())

    four = materialize(p.mix(spark, three, sf_dir))
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(three).where("taken > 0").collect()}
    assert Counter(r["doc_id"] for r in four.collect()) == {d: -(-t // s) for d, (t, s) in taken.items()}

    five = p.pack(spark, four, sf_dir)
    assert five.count() == packing.pieces(four, vocabulary()).count()
    assert five.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_run(spark, sf_dir):
    out = p.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)


def test_empty(spark, sf_dir, empty):
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_edges(spark, sf_dir, edge, clashing, rows):
    """Nulls, ties, repeated rows, long texts and clashing columns go through every stage in turn."""
    for given in (edge, clashing):
        kept = given
        for name, stage in p.STAGES[1:]:  # of the first, below: its base rule wants fifty words
            before, kept = kept, materialize(stage(spark, kept, sf_dir))
            if name != "packing":
                assert kept.columns == given.columns
            if name == "near_dedup":
                fps = {r["fingerprint"] for r in simhash.near_duplicates(before).collect()}
                assert 0 < kept.count() <= len(fps)
            if name == "source_mix":
                assert kept.count() == mixing.mix(before).agg(F.sum(F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))))).first()[0]
        assert kept.count() == packing.pieces(before, vocabulary()).count() > 0
    long = edge.where("length(text) > 1000").select(*[F.col(c) for c in edge.columns if c != "text"], F.concat_ws(" ", *[F.lit(f"w{i}") for i in range(80)]).alias("text"))
    given = edge.unionByName(long).unionByName(long)
    judged = quality_rules.quality_rules(given, quality_rules.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))).where("kept")
    assert rows(p.rules(spark, given, sf_dir).select("doc_id")) == rows(judged.select("doc_id")) == [(5,), (5,)]


def test_whole_run_against_plain_code(spark, sf_dir, docs):
    """The rows of ``run`` from plain restatements of what follows the trained classifier.

    The first two stages are held against plain code with their operators; from their result on,
    groups, mix and pieces are computed here by brute force.
    """
    start = materialize(p.classifier(spark, materialize(p.rules(spark, docs, sf_dir)), sf_dir))
    given = start.collect()
    prints = dict(zip([r["doc_id"] for r in given], simhash.fingerprints_of([r["text"] for r in given]).tolist(), strict=True))
    group = {d: d for d in prints}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((root(a), root(b)))
            group[y] = x
    left = [r for r in given if root(r["doc_id"]) == r["doc_id"]]

    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in left}
    names = sorted({r["source"] for r in left if r["source"] is not None}) + [None] * any(r["source"] is None for r in left)
    size = {s: sum(len(words[r["doc_id"]]) for r in left if r["source"] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(size.values())
    while True:
        rest = total - sum(2 * size[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * size[s] if s in full else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] >= 2 * size[s]}
        if not over:
            break
        full |= over

    def key(r):
        text, n = r["text"] or "", len(words[r["doc_id"]])
        digits = hashlib.md5(f"{r['doc_id']}|{hashlib.md5(text.encode()).hexdigest()}|mix".encode()).hexdigest()[:13]
        return -math.log((int(digits, 16) + 0.5) / 2**52) * (n + 1 + sum(text.count(c) for c in mixing.MARKS)) / (n + 1)

    tokenizer, want = tokens.encoder(vocabulary()).tokenizer, Counter()
    for s in names:
        epochs = int(target[s] // size[s]) if size[s] else 0
        budget = round(target[s]) - epochs * size[s]
        for r in sorted((r for r in left if r["source"] == s), key=key):
            own = words[r["doc_id"]]
            part = max(0, min(len(own), budget))
            budget -= len(own)
            texts = [r["text"]] * (epochs + (part == len(own) > 0)) + [" ".join(own[:part])] * (0 < part < len(own))
            for text in texts:
                ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
                for k, at in enumerate(range(0, len(ids), 2048)):
                    piece = ids[at : at + 2048]
                    want[r["doc_id"], k, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    out = p.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        ends = list(itertools.accumulate(n for _, n in sorted(own)))
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048
    fits: list[int] = []  # first-fit decreasing, for comparison
    for n in sorted((r["length"] for r in out), reverse=True):
        i = next((i for i, used in enumerate(fits) if used + n <= 2048), len(fits))
        fits[i:] = [n, *fits[i + 1 :]] if i == len(fits) else [fits[i] + n, *fits[i + 1 :]]
    assert len(bins) <= len(fits) + 1  # on few pieces the method may lose a bin at the end


def test_registered():
    import __spark_entry__ as e

    found = e.queries()
    assert {"pipeline", *(k for k in found if k.startswith("op"))} <= set(found) and len([k for k in found if k.startswith("op")]) == 13


def test_stages_keep_rows_and_columns_with_clashing_names(spark, sf_dir, docs, clashing, rows):
    """Columns named like any helper of any stage come through, and decide nothing."""
    more = [c for c in clashing.columns if c not in docs.columns]
    wide = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in more])
    for name, stage in p.STAGES[:-1]:
        plain, kept = stage(spark, docs, sf_dir), stage(spark, wide, sf_dir)
        assert kept.columns == wide.columns, name
        assert rows(kept.select(*docs.columns)) == rows(plain), name
        assert kept.where(" and ".join(f"`{c}` = concat('{c}', doc_id)" for c in more)).count() == kept.count() > 0, name
    assert rows(p.pack(spark, wide, sf_dir)) == rows(p.pack(spark, docs, sf_dir))
