"""SimHash near-duplicates: fingerprints of word shingles, linked by meeting in the middle.

Two fingerprints within ``2k + 1`` bits differ in some block of the bits, so with that block set
aside they are within ``2k`` on the rest, and the balls of radius ``k`` around them share a
variant.  Every distinct fingerprint therefore emits, for each of three blocks, all variants of
the other bits within one bit (k = 1, radius 3), and the variants are shuffled.  Only variants
that two fingerprints share go on.

Colliding fingerprints are verified without forming pairs.  Whoever is within three bits of the
smallest at its variant is linked to it; where that holds for all, nothing is left to find there,
and where only two meet, by chance mostly, nothing either.  Nor is it at a variant whose
fingerprints these links have joined already, as in large groups of near copies.  At most others
few meet, and each is held against the few of other groups.  Where more than 256 meet, each is
expanded to the full 64-bit points near it that the shared variant allows.  At a point, whoever is within
one bit is linked to everyone within two (the distances add up to 3 at most), so one edge from
each to the smallest of the nearest keeps all links; each pair within 3 bits meets at such a point.

Defined results: a null text is empty; texts without words have fingerprint 0 and are linked like
any other; equal fingerprints (repeated rows, copies) are one node from the start, so copies cost
nothing; a null id takes part in links but is never a group's name unless the group has no other;
an empty table gives an empty result; further columns are ignored.  A very long text is hashed
in blocks of shingles, so it costs a small multiple of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, free_names, materialize
from .components import components
from .tokens import slices

#: The blocks of bits set aside in turn, as first bit and bit after the last.
BLOCKS = ((0, 21), (21, 43), (43, 64))
#: Texts of more bytes than this are hashed alone, this many shingles at a time.
LONG_TEXT, HASHED_AT_ONCE = 1 << 20, 1 << 16
#: Up to so many fingerprints at a variant are compared in place; comparing more costs more than laying out points.
COMPARED_IN_PLACE = 256


def _long_ones(text: bytes, words_per_shingle: int, seed: int) -> tuple[np.ndarray, int]:
    """Set bits by place over all shingles of a long lower-cased text, and the number of shingles."""
    b = np.frombuffer(text, np.uint8)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    before = np.concatenate([[True], gap[:-1]])
    kept = b[~(gap & before)].copy()
    kept[gap[~(gap & before)]] = 32
    joined = kept.tobytes().rstrip(b" ")
    if not joined:
        return np.zeros(64, np.int64), 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])
    if len(starts) > words_per_shingle:
        starts, ends = starts[: 1 - words_per_shingle or None], ends[words_per_shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), HASHED_AT_ONCE):
        spans = zip(starts[i : i + HASHED_AT_ONCE].tolist(), ends[i : i + HASHED_AT_ONCE].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(joined[x:y], seed) for x, y in spans], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return ones, len(starts)


def fingerprints_of(texts: list[str | None], words_per_shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit fingerprint of every text, as u64."""
    digest, hashes, counts, alone = xxhash.xxh64_intdigest, [], [], {}
    for t in texts:
        lowered = (t or "").encode("utf-8", "replace").lower()
        if len(lowered) > LONG_TEXT:
            ones, n = _long_ones(lowered, words_per_shingle, seed)
            alone[len(counts)] = np.packbits(2 * ones > n).view(">u8")[0]
            counts.append(0)
            continue
        split = lowered.split()
        joined = b" ".join(split)
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(split) else ends
        if len(split) > words_per_shingle:
            starts, ends = starts[: 1 - words_per_shingle or None], ends[words_per_shingle - 1 :]
        elif len(split):
            starts, ends = starts[:1], ends[-1:]
        hashes += [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        counts.append(len(starts))
    out, n = np.zeros(len(texts), np.uint64), np.array(counts, np.int64)
    if hashes:
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        full = np.flatnonzero(n)
        ones = np.add.reduceat(bits, (np.cumsum(n) - n)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > n[full, None], axis=1).view(">u8").ravel()
    for i, fp in alone.items():
        out[i] = fp
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long) and ``text_hash``, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = fingerprints_of(b.column("text").to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp), b.column("text_hash")], ["doc_id", "fp", "text_hash"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return own.mapInArrow(run, "doc_id long, fp long, text_hash long")


def _bit(i: int) -> int:
    """Bit ``i`` as a signed long."""
    return 1 << i if i < 63 else -(1 << 63)


def _masks(*flips: tuple[int, ...]) -> list[int]:
    return [sum(_bit(i) for i in f) for f in flips]


def variants(fps: DataFrame) -> DataFrame:
    """``fp, block, key``: the 132 variants of each."""
    emitted = []
    for b, (low, high) in enumerate(BLOCKS):
        aside = sum(_bit(i) for i in range(low, high))
        for m in [0, *_masks(*((i,) for i in range(64) if not low <= i < high))]:
            emitted.append((b, ~aside, m))
    rows = ", ".join(f"struct({b}, {rest}L, {m}L)" if m >= -(1 << 63) + 1 else f"struct({b}, {rest}L, shiftleft(1L, 63))" for b, rest, m in emitted)
    shifted = fps.select("fp", F.explode(F.expr(f"array({rows})")).alias("x"))
    return shifted.select(
        "fp",
        F.col("x.col1").cast("byte").alias("block"),
        F.col("fp").bitwiseAND(F.col("x.col2")).bitwiseXOR(F.col("x.col3")).alias("key"),
    )


def _near() -> Column:
    """0 where ``key`` is the unchanged rest of ``fp``, else 1."""
    aside = F.lit(None).cast("long")
    for b, (low, high) in enumerate(BLOCKS):
        aside = F.when(F.col("block") == b, F.lit(sum(_bit(i) for i in range(low, high))).cast("long")).otherwise(aside)
    return (F.col("fp").bitwiseAND(F.bitwise_not(aside)) != F.col("key")).cast("byte")


def links(fps: DataFrame, in_place: int = COMPARED_IN_PLACE) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints; they connect all pairs within 3 bits and no others.

    The fingerprints are spread over all tasks first, since each becomes 132 rows.  Variants of more than
    ``in_place`` fingerprints go to points; the bound changes the way, not the result.
    """
    bucket = W.partitionBy("block", "key")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = materialize(
        variants(fps.repartition(tasks, "fp"))
        .withColumn("near", _near())
        .withColumn("_n", F.count(F.lit(1)).over(bucket))
        .withColumn("_exact", F.sum(1 - F.col("near")).over(bucket))
        .withColumn("_low", F.min("fp").over(bucket))
        .where("_n > 1")
        .withColumn("_linked", F.expr("bit_count(fp ^ _low) <= 3"))
        .withColumn("_done", F.min("_linked").over(bucket) | (F.col("_n") == 2))
        .where("not _done or _linked and fp <> _low")
    )
    stars = shared.where("_linked and fp <> _low").select(F.col("fp").alias("u"), F.col("_low").alias("v"))
    joined = materialize(components(stars))
    apart = materialize(
        shared.where("not _done")
        .join(joined.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("label", F.coalesce("label", "fp"))
        .withColumn("_apart", F.min("label").over(bucket) != F.max("label").over(bucket))
        .where("_apart")
        .select("fp", "label", "block", "key", "near", "_n", "_exact")
    )
    discard(shared)
    few = apart.where(F.col("_n") <= in_place).groupBy("block", "key").agg(F.collect_list(F.struct("fp", "label")).alias("m"))
    compared = few.select(F.explode(F.expr("""
        flatten(transform(m, a -> transform(
            filter(m, b -> b.fp < a.fp and b.label <> a.label and bit_count(a.fp ^ b.fp) <= 3),
            b -> struct(a.fp as u, b.fp as v))))""")).alias("e")).select("e.u", "e.v")  # fmt: skip
    more = apart.where(F.col("_n") > in_place)
    points = []
    for b, (low, high) in enumerate(BLOCKS):
        bits = range(low, high)
        one = _masks(*((i,) for i in bits))
        two = _masks(*((i, j) for i in bits for j in bits if i < j))
        rest = ~sum(_bit(i) for i in bits)
        own = more.where(F.col("block") == b).select(
            "fp", "near", "_exact", F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.lit(~rest))).alias("p")
        )
        at = F.array([F.lit(m).cast("long") for m in [0, *one]])
        points.append(own.select("fp", "p", "near", F.explode(at).alias("m")).select(
            "fp", F.col("p").bitwiseXOR(F.col("m")).alias("p"), (F.col("near") + (F.col("m") != 0).cast("int")).alias("d")
        ))
        at = F.array([F.lit(m).cast("long") for m in two])
        points.append(own.where("near = 0 and _exact > 1").select("fp", "p", F.explode(at).alias("m")).select(
            "fp", F.col("p").bitwiseXOR(F.col("m")).alias("p"), F.lit(2).alias("d")
        ))
    near = points[0]
    for x in points[1:]:
        near = near.unionByName(x)
    least = F.min(F.when(F.col("d") <= 1, F.col("fp"))).over(W.partitionBy("p"))
    met = near.withColumn("v", least).where("v is not null and v <> fp").select(F.col("fp").alias("u"), "v")
    edges = materialize(met.unionByName(compared).distinct().unionByName(joined.select(F.col("node").alias("u"), F.col("label").alias("v"))))
    discard(apart)
    discard(joined)
    return edges


def grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, text_hash, component_id, label``; the smallest fingerprint labels a group."""
    prints = materialize(fingerprints(docs))
    fps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    edges = links(fps.select("fp"))
    label = components(edges).withColumnRenamed("node", "fp")
    discard(edges)
    joined = materialize(fps.join(label, "fp"))
    group = joined.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    linked = joined.join(group, "label").select("fp", "label", "component_id")
    named = fps.join(linked, "fp", "left").select(
        "fp", F.coalesce("component_id", "first_doc").alias("component_id"), F.coalesce("label", "fp").alias("label")
    )
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per input row."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the document with the smallest id."""
    best = grouped(docs).groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("b"))
    d, h, own = free_names(docs.columns, "_d", "_h", "_own")
    kept = best.select(F.col("b.doc_id").alias(d), F.col("b.text_hash").alias(h))
    rows = docs.withColumn(own, F.xxhash64("text"))
    met = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(own) == F.col(h)), "left_semi")
    return met.dropDuplicates(["doc_id", own]).drop(own)
