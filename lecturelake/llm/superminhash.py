"""MinHash near-duplicates: SuperMinHash signatures, banding, verification, grouping.

An element (a hashed shingle of words) draws a random order of the signature's places; the value it
offers to the place it puts at rank ``j`` is ``j`` and a random fraction, and each place keeps the
smallest offer.  So the values of an element are spread over the ranks, which makes the estimate of
similarity less scattered than independent minima.  Once a place of every rank is taken below
``j``, later ranks can't win, so a text of many shingles ends after a rank or two: all texts of a
batch go through rank after rank, and leave when their largest value is below the next.

Rows with equal sets are one class from the start, so copies cost nothing, and classes are
banded.  Candidates are verified on the full sets, without forming the pairs of a bucket: in a round,
each bucket's members are held against a few pivots of it, those in its group already left out.  A
pivot has then met everyone, so it leaves the bucket, and a bucket whose members are in one
group is done.  Rounds go on with more pivots until all buckets are; near copies are joined in the
first, and nothing is ever capped.  Before the full sets are read, two short rows of bits are compared.
Two bits of every place of the signatures: a pair goes on unless more places differ than six standard
deviations beyond what the limit allows.  And an odd sketch: every element flips one of 512 bits, so
two sets differ in at least as many elements as their sketches in bits, and a pair for which that
is too many has surely not enough in common.  This bound loses no pair; it is close for sets
of up to about a thousand shingles, while larger ones fill the bits and are left to the other test.

Defined results: a null or empty text, or one without words, has the empty set and is a group of its
own; texts of fewer words than a shingle have one shingle, all their words; repeated rows and
equal sets are in one group; a null id takes part in links, is never a group's name unless the group
has no other, and then counts as kept; an empty table gives an empty result; further columns
are ignored.  A very long text is hashed in blocks of words, so it costs a small multiple of its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import components
from .tokens import Places, slices

#: Bands and places in each: two sets of similarity 0.85 share no band once in 10 ** 8 pairs.
BANDS, PLACES = 32, 5
#: Words whose hashes a worker keeps before it starts afresh.
WORDS_KEPT = 200_000
#: Texts of more bytes than this are hashed alone, this many words at a time.
LONG_TEXT, HASHED_AT_ONCE = 1 << 20, 1 << 16
#: Elements whose orders are held at once; a larger set needs none, as its first draws fill all places.
ORDERED_AT_ONCE = 1 << 16
#: Pivots of the rounds of verification; later rounds take so many times as many as the one before.
FIRST_PIVOTS, MORE_PIVOTS = 1, 64
#: Bits of the odd sketch, and sets whose bits are counted at once.
PARITY_BITS, COUNTED_AT_ONCE = 512, 1024
#: Bands that a round of their own looks at first, so that a large group isn't linked once for every band.
EARLY_BANDS = 3

_GOLDEN, _NONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFFFFFFFFFF)
_HASHES: list[WordHashes] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of the words of texts, each new word hashed once."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.place, self.own = Places(), np.zeros(1024, np.uint64)

    def long(self, text: bytes) -> np.ndarray:
        b = np.frombuffer(text, np.uint8)
        gap = np.concatenate([[True], (b == 32) | ((b >= 9) & (b <= 13)), [True]])
        starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        out = np.empty(len(starts), np.uint64)
        for i in range(0, len(starts), HASHED_AT_ONCE):
            spans = zip(starts[i : i + HASHED_AT_ONCE].tolist(), ends[i : i + HASHED_AT_ONCE].tolist(), strict=True)
            out[i : i + HASHED_AT_ONCE] = [xxhash.xxh64_intdigest(text[x:y]) for x, y in spans]
        return out

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, text after text, and the number of words of each."""
        if len(self.place) > WORDS_KEPT:
            self.reset()
        parts, counts = [], []
        for t in texts:
            lowered = (t or "").encode("utf-8", "replace").lower()
            parts.append(self.long(lowered) if len(lowered) > LONG_TEXT else lowered.split())
            counts.append(len(parts[-1]))
        short = [p for p in parts if isinstance(p, list)]
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(short)), np.int64, sum(map(len, short)))
        if self.place.new:
            new, self.place.new = self.place.new, []
            while len(self.place) > len(self.own):
                self.own = np.concatenate([self.own, np.zeros_like(self.own)])
            self.own[len(self.place) - len(new) : len(self.place)] = [xxhash.xxh64_intdigest(w) for w in new]
        found, used, out = self.own[at], 0, []
        for p in parts:
            out.append(found[used : used + len(p)] if isinstance(p, list) else p)
            used += len(p) if isinstance(p, list) else 0
        return np.concatenate(out) if out else found, np.array(counts, np.int64)


def shingle_sets(texts: list[str | None], words_per_shingle: int = 5) -> list[np.ndarray]:
    """The distinct hashed shingles of every text, ascending."""
    if not _HASHES:
        _HASHES.append(WordHashes())
    words, counts = _HASHES[0](texts)
    factor = mixed(_GOLDEN * np.arange(1, words_per_shingle + 1, dtype=np.uint64)) | np.uint64(1)
    starts = max(0, len(words) - words_per_shingle + 1)
    rolled = np.zeros(starts, np.uint64)
    for i, f in enumerate(factor):
        rolled += words[i : i + starts] * f
    rolled = mixed(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words_per_shingle:
            s = np.sort(rolled[at : at + n - words_per_shingle + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            out.append(mixed((words[at : at + n] * factor[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """A row of ``places`` values for every set: the rank above 32 bits of fraction; all ones for empty sets."""
    group = np.cumsum([len(s) for s in sets]) // ORDERED_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sets)] if len(sets) else [0, 0]
    return np.concatenate([_signatures(sets[i:j], places) for i, j in zip(cuts, cuts[1:], strict=False)])


def _signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    sig = np.full((len(sets), places), _NONE, np.uint64)
    flat, element = sig.reshape(-1), np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row, order = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), None
    for rank in range(places):
        drawn = mixed(element + np.uint64((rank + 1) * int(_GOLDEN) & int(_NONE)))
        other = rank + (((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(places - rank)) >> np.uint64(32)).astype(np.int64)
        value = (drawn >> np.uint64(32)) | np.uint64(rank << 32)
        if rank:
            # Fisher and Yates: what stands at a random later place comes to this one.
            each = np.arange(len(element))
            place = order[each, other].astype(np.int64)
            order[each, other] = order[:, rank]
        else:
            place = other
        np.minimum.at(flat, row * places + place, value)
        stays = (sig.max(axis=1) >= np.uint64((rank + 1) << 32))[row]
        if not stays.any():
            break
        if rank:
            order = order[stays]
        else:
            order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (np.count_nonzero(stays), 1))
            order[np.arange(len(order)), other[stays]] = 0
        element, row = element[stays], row[stays]
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One hash a band, as signed longs."""
    parts = sig.reshape(len(sig), bands, -1)
    key = np.zeros(parts.shape[:2], np.uint64)
    for i in range(parts.shape[2]):
        key = mixed((key ^ parts[:, :, i]) + _GOLDEN)
    return key.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of every place, as signed longs."""
    bits = (mixed(sig ^ _GOLDEN) & np.uint64(3)).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 32))).reshape(len(sig), -1, 4)
    return np.ascontiguousarray(bits[:, :, 0] | bits[:, :, 1] << 2 | bits[:, :, 2] << 4 | bits[:, :, 3] << 6).view(np.int64)


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The parity of the number of elements at each of so many bits, as signed longs."""
    out = np.zeros((len(sets), PARITY_BITS // 8), np.uint8)
    for i in range(0, len(sets), COUNTED_AT_ONCE):
        some = sets[i : i + COUNTED_AT_ONCE]
        row = np.repeat(np.arange(len(some)), [len(s) for s in some])
        bit = (mixed(np.concatenate(some) + _GOLDEN) % np.uint64(PARITY_BITS)).astype(np.int64)
        odd = np.bincount(row * PARITY_BITS + bit, minlength=len(some) * PARITY_BITS) & 1
        out[i : i + COUNTED_AT_ONCE] = np.packbits(odd.astype(np.uint8).reshape(len(some), -1), axis=1)
    return out.view(np.int64)


def places_apart(percent: int, places: int) -> int:
    """So many places of the sketches of two sets of this similarity differ at most (six standard deviations)."""
    p = 0.75 * (1 - percent / 100)
    return math.ceil(places * p + 6 * math.sqrt(places * p * (1 - p)))


def shares_enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection reaches ``percent`` times the union."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    same = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return 100 * same >= percent * (len(a) + len(b) - same)


def signed(docs: DataFrame, words_per_shingle: int = 5, bands: int = BANDS, places: int = PLACES) -> DataFrame:
    """``doc_id, text_hash, n_shingles, s1, s2`` (two hashes of the set), ``bands``, ``sketch`` and ``odd``, one row per input row."""
    names = ["doc_id", "text_hash", "n_shingles", "s1", "s2", "bands", "sketch", "odd"]
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column("text").to_pylist(), words_per_shingle)
            sig = signatures(sets, bands * places)
            named = b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets)
            named = np.frombuffer(named, np.int64).reshape(-1, 2)
            columns = [b.column("doc_id"), b.column("text_hash"), pa.array([len(x) for x in sets], pa.int64()), pa.array(named[:, 0]), pa.array(named[:, 1])]
            yield pa.RecordBatch.from_arrays([*columns, lists(band_keys(sig, bands)), lists(sketches(sig)), lists(odd_sketches(sets))], names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return own.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, bands array<long>, sketch array<long>, odd array<long>")


def sets_of(docs: DataFrame, named: DataFrame, words_per_shingle: int) -> DataFrame:
    """``node, shingles`` (as bytes) for the texts that ``named`` (``node, doc_id, text_hash``) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column("text").to_pylist(), words_per_shingle)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    wanted = named.select("node", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", F.xxhash64("text").alias("_text"))
    met = own.join(wanted.hint("shuffle_hash"), (F.col("_text") == F.col("_h")) & F.col("_id").eqNullSafe(F.col("_d")))
    return met.select("node", "text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (``u, v``) whose sets share enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (b.column(x) for x in ("_a", "_c"))
            near = [shares_enough(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(a, c, strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    # The pivot's side last: many members may meet at one, and the engine splits such a key.
    own = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("_a")), "u")
    both = own.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("_c")), "v")
    return both.select("u", "v", "_a", "_c").mapInArrow(run, "u long, v long")


def _differing(a: Column, b: Column) -> Column:
    """How many pairs of bits of two longs differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def links(docs: DataFrame, classes: DataFrame, percent: int, words_per_shingle: int, apart: int, first: int = FIRST_PIVOTS) -> DataFrame | None:
    """Edges ``u, v`` from classes to the smallest of their group; groups are what pairs that share
    enough connect.  ``classes``: ``node, doc_id, text_hash, n_shingles, bands, sketch, odd``.  ``apart``: places
    of two sketches that may differ.  None if no bucket has two members."""
    # Different sets are near only if the smaller can be the larger's part: 6 of 7 at 85 percent.
    least = next(n for n in range(1, 102) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 62
    laid = classes.where(F.col("n_shingles") >= least).select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    many = laid.groupBy("band", "key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("band", "key")
    members = laid.join(many, ["band", "key"])
    shared = materialize(members.select("node").distinct().join(classes.select("node", "doc_id", "text_hash", "sketch", "odd"), "node"))
    members = materialize(members.join(shared.select("node", "sketch", "odd"), "node").withColumn("label", F.col("node")))
    named = shared.select("node", "doc_id", "text_hash")
    longs = len(shared.select("sketch").first()["sketch"]) if shared.limit(1).count() else 0
    sets, edges, pivots = materialize(sets_of(docs, named, words_per_shingle)), None, first
    early = True
    while members.limit(1).count():
        # The smallest member of each of so many parts of a bucket.
        part = F.pmod(F.xxhash64("node"), F.lit(pivots)).alias("_part")
        chosen = materialize(members.where(F.col("band") < EARLY_BANDS if early else F.lit(True)).groupBy("band", "key", part).agg(F.min(F.struct("node", "label", "n_shingles", "sketch", "odd")).alias("p")).select("band", "key", "p.*"))
        other = chosen.select("band", "key", F.col("node").alias("v"), F.col("label").alias("_l"), F.col("n_shingles").alias("_m"), F.col("sketch").alias("_s"), F.col("odd").alias("_o"))
        sized = (100 * F.least("n_shingles", "_m") >= percent * F.greatest("n_shingles", "_m")) & (F.col("label") != F.col("_l"))
        differ = sum((_differing(F.get("sketch", F.lit(i)), F.get("_s", F.lit(i))) for i in range(longs)), F.lit(0))
        flipped = sum((F.bit_count(F.get("odd", F.lit(i)).bitwiseXOR(F.get("_o", F.lit(i)))) for i in range(PARITY_BITS // 64)), F.lit(0))
        # So many elements may be in one set only: the sizes' sum less twice the least intersection.
        shares = (100 + percent) * flipped <= (100 - percent) * (F.col("n_shingles") + F.col("_m"))
        met = members.join(other, ["band", "key"]).where(sized & shares & (differ <= apart)).select("node", "v")
        found = verified(met.select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct(), sets, percent)
        found = materialize(found)
        if edges is None or found.limit(1).count():
            before, joined = edges, found if edges is None else edges.unionByName(found)
            edges = materialize(components(joined).select(F.col("node").alias("u"), F.col("label").alias("v")))
            if before is not None:
                discard(before)
        # Pivots have met all others of their buckets.
        rest = members.join(chosen.select("band", "key", "node"), ["band", "key", "node"], "left_anti").drop("label")
        rest = rest.join(edges.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left")
        rest = materialize(rest.withColumn("label", F.coalesce("label", "node")))
        open_ = rest.groupBy("band", "key").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a < _b").select("band", "key")
        after = materialize(rest.join(open_, ["band", "key"], "left_semi"))
        for x in (members, chosen, rest, found):
            discard(x)
        members = after
        # The first number of pivots is used twice: on the early bands, then on all.
        pivots, early = pivots * (1 if early else MORE_PIVOTS), False
    discard(sets)
    discard(members)
    return edges


def near_duplicates(docs: DataFrame, percent: int = 85, words_per_shingle: int = 5, bands: int = BANDS, places: int = PLACES, first: int = FIRST_PIVOTS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per input row."""
    rows = materialize(signed(docs, words_per_shingle, bands, places))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "text_hash", "n_shingles", "bands", "sketch", "odd"))
    classes = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(best.alias("b"))
    classes = materialize(classes.select("s1", "s2", "b.doc_id", "b.text_hash", "b.n_shingles", "b.bands", "b.sketch", "b.odd", F.monotonically_increasing_id().alias("node")))
    edges = links(docs, classes, percent, words_per_shingle, places_apart(percent, bands * places), first)
    own = classes.select("s1", "s2", "node", F.col("doc_id").alias("_first"))
    if edges is None:
        named = own.select("s1", "s2", F.col("_first").alias("component_id"))
    else:
        labelled = materialize(own.join(edges.select(F.col("u").alias("node"), F.col("v").alias("label")), "node"))
        group = labelled.groupBy("label").agg(F.min("_first").alias("_least"))
        linked = labelled.join(group, "label").select("node", "_least")
        named = own.join(linked, "node", "left").select("s1", "s2", F.coalesce("_least", "_first").alias("component_id"))
    full = rows.where("n_shingles > 0").drop("bands", "sketch", "odd").join(named, ["s1", "s2"])
    empty = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    both = full.select(*columns).unionByName(empty.select(*columns))
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
