"""Token shards compressed by a Re-Pair grammar, readable from any document on.

A shard holds documents in ascending id order.  Frequent pairs of neighbouring symbols are
replaced by nonterminals until none is frequent or no symbol is free; each pass replaces many of
the most frequent pairs at once, the more frequent one first where two overlap.  The mark that ends a document takes part
in no pair, so every document starts at a symbol and can be expanded alone with the shard's
rules and expansion lengths.

Shard bytes, little-endian: ``RPR1``; u32 documents, rules, symbols, terminals; i64 per document
its id (null: the smallest i64) and u32 its number of ids with the end id; per rule two u16 and
the u32 length of its expansion; u16 symbols.  Symbols below ``terminals - 1`` are ids,
``terminals - 1`` ends a document, the others are rules in order.

Shards are rows of a table written by Spark, so a lost executor leaves no half file behind, and
the folder can be in any store Spark reads.

Defined results: a null or empty text is its end id alone; null ids come first; repeated rows
are kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_folder
from .tokens import encoder, gather, slices

MAGIC, NO_ID = b"RPR1", -(1 << 63)
SYMBOLS = 1 << 16
SHARDS = "part int, shard int, n_docs long, n_ids long, first_doc long, last_doc long, payload binary"


def _slots(pairs: np.ndarray) -> np.ndarray:
    """A 20-bit hash of each u32 pair, to look pairs up in one small table."""
    return (pairs * np.uint32(2654435761)) >> np.uint32(12)


def replace_pairs(seq: np.ndarray, terminals: int, passes: int | None = None, per_pass: int = 4000, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The shortened sequence and the rules, ``(n, 2)``; ``terminals - 1`` is never replaced.

    Ends when no pair occurs ``least`` times (or all symbols are used) and no pair that has a rule
    is left.  ``passes``: an earlier end, for callers that want one.
    """
    end, rules, n_rules, bar = terminals - 1, [np.zeros(0, np.uint32)], 0, None
    known, symbols, mark = np.zeros(0, np.uint32), np.zeros(0, np.uint16), np.uint32(end * 65537)
    while len(seq) > 1 and passes != 0:
        key = seq[:-1].astype(np.uint32)
        key <<= 16
        key |= seq[1:]
        ends = np.flatnonzero(seq == end)
        key[ends[ends < len(key)]] = key[ends[ends > 0] - 1] = mark
        free = SYMBOLS - terminals - n_rules
        best = np.zeros(0, np.uint32)
        if free:
            ordered = np.sort(key)
            if bar is None:
                at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                bar = max(least, int(np.diff(at, append=len(ordered))[ordered[at] != mark].max(initial=0)) // 16)
            best = _often(ordered, bar, known, mark)
            while not len(best) and bar > least:
                bar = max(least, bar // 4)
                best = _often(ordered, bar, known, mark)
            if len(best) > min(per_pass, 4 * free):
                counts = np.searchsorted(ordered, best, "right") - np.searchsorted(ordered, best)
                best = np.sort(best[np.lexsort((_slots(best), -counts))[: min(per_pass, 4 * free)]])
        # Where these pairs and those that have a rule are.
        best = np.concatenate([known, best])
        fresh = np.arange(len(best)) >= len(known)
        order = np.argsort(best)
        best, fresh = best[order], fresh[order]
        hit = np.zeros(1 << 20, bool)
        hit[_slots(best)] = True
        slots = _slots(key)
        at = np.flatnonzero(hit.take(slots))
        found, place = _known(key[at], slots[at], best)
        at, place = at[found], place[found]
        if not len(at):
            break
        # The most frequent first; equals in mixed order, so that overlapping ones don't queue up.
        order = np.lexsort((_slots(best), -np.bincount(place, minlength=len(best))))
        rank = np.empty(len(best), np.intp)
        rank[order] = np.arange(len(best))
        r, best, fresh = rank[place], best[order], fresh[order]
        # Two marked neighbours overlap: the better rank wins, every other one in a run of equals.
        next_to, step = np.diff(at) == 1, np.diff(r)
        joint = np.concatenate([[False], next_to & (step == 0)])
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(joint, 0, np.arange(len(at))))
        worse_than_left = np.concatenate([[False], next_to & (step > 0)])
        worse_than_right = np.concatenate([next_to & (step < 0), [False]])
        take = (run % 2 == 0) & ~worse_than_left & ~worse_than_right
        # A new rule must be used about as often as its pair was counted; others wait for the next pass.
        used = np.bincount(r[take], minlength=len(best))
        new = fresh & (used >= max(1, min(bar, used[fresh].max(initial=0)) // 2))
        new &= np.cumsum(new) <= free
        symbol = np.zeros(len(best), np.uint16)
        symbol[new] = terminals + n_rules + np.arange(np.count_nonzero(new))
        if not fresh.all():
            symbol[~fresh] = symbols[_among(best[~fresh], known)[1]]
        rules.append(best[new])
        n_rules += len(rules[-1])
        known, symbols = np.concatenate([known, best[new]]), np.concatenate([symbols, symbol[new]])
        order = np.argsort(known)
        known, symbols = known[order], symbols[order]
        take &= (new | ~fresh)[r]
        where = at[take]
        seq[where] = symbol[r[take]]
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq = seq[keep]
        if np.count_nonzero(new) < 1024:
            bar = max(least, bar // 4)
        passes = None if passes is None else passes - 1
    pairs = np.concatenate(rules).astype(np.int64)
    return seq, np.stack([pairs >> 16, pairs & 0xFFFF], axis=1)


def _often(ordered: np.ndarray, bar: int, known: np.ndarray, mark: np.uint32) -> np.ndarray:
    """The pairs without a rule that occur ``bar`` times or more, from all pairs in order."""
    if len(ordered) < bar:
        return ordered[:0]
    pairs = ordered[bar - 1 :][ordered[bar - 1 :] == ordered[: len(ordered) - bar + 1]]
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    return pairs[(pairs != mark) & ~_among(pairs, known)[0]]


def _known(pairs: np.ndarray, slots: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_among``, by the pairs' slots; only where several of ``ordered`` share one, by order."""
    own, numbers, table = _slots(ordered), np.arange(len(ordered)), np.zeros(1 << 20, np.intp)
    table[own] = numbers
    place = table[slots]
    found = ordered[place] == pairs
    hidden = np.flatnonzero(table[own] != numbers)
    if len(hidden):
        rest = np.flatnonzero(~found)
        found[rest], which = _among(pairs[rest], ordered[hidden])
        place[rest] = hidden[which]
    return found, place


def _among(pairs: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair is one of ``ordered`` (ascending), and where."""
    if not len(ordered):
        return np.zeros(len(pairs), bool), np.zeros(len(pairs), np.intp)
    place = np.minimum(np.searchsorted(ordered, pairs), len(ordered) - 1)
    return ordered[place] == pairs, place


def expansions(rules: np.ndarray, rule_sizes: np.ndarray, terminals: int, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every symbol, where its ids start in a flat array and how many they are."""
    sizes = np.concatenate([np.ones(terminals, np.int64), rule_sizes.astype(np.int64)])
    starts = np.cumsum(sizes) - sizes
    flat = np.empty(int(sizes.sum()), np.int32)
    flat[:terminals] = np.arange(terminals)
    flat[terminals - 1] = end_id
    at, n = starts.tolist(), sizes.tolist()
    for to, (a, b) in zip(at[terminals:], rules.tolist(), strict=True):  # of earlier symbols
        middle = to + n[a]
        flat[to:middle] = flat[at[a] : at[a] + n[a]]
        flat[middle : middle + n[b]] = flat[at[b] : at[b] + n[b]]
    return flat, starts, sizes


def pack_shard(doc_ids: list, counts: np.ndarray, seq: np.ndarray, terminals: int, **how) -> bytes:
    """``seq``: the documents' symbols as u16, each document ended by ``terminals - 1``."""
    seq, rules = replace_pairs(seq, terminals, **how)
    sizes = np.ones(terminals + len(rules), np.uint32)
    for i, (a, b) in enumerate(rules.tolist()):
        sizes[terminals + i] = sizes[a] + sizes[b]
    ids = np.array([NO_ID if d is None else d for d in doc_ids], "<i8")
    return b"".join(
        [
            MAGIC,
            struct.pack("<4I", len(ids), len(rules), len(seq), terminals),
            ids.tobytes(),
            counts.astype("<u4").tobytes(),
            rules.astype("<u2").tobytes(),
            sizes[terminals:].astype("<u4").tobytes(),
            seq.astype("<u2").tobytes(),
        ]
    )


class Shard:
    """A shard's bytes, open for reading."""

    def __init__(self, payload: bytes, end_id: int):
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        n, r, m, terminals = struct.unpack_from("<4I", payload, 4)
        at = 20

        def part(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.counts = part("<i8", n), part("<u4", n).astype(np.int64)
        rules, self.rule_sizes, self.symbols = part("<u2", 2 * r).reshape(-1, 2), part("<u4", r), part("<u2", m)
        self.tables = expansions(rules, self.rule_sizes, terminals, end_id)
        self.ends = np.flatnonzero(self.symbols == terminals - 1)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of documents ``first`` up to ``last`` (not included), without the others."""
        last = len(self.ends) if last is None else last
        if last <= first:
            return np.zeros(0, np.int32)
        own = self.symbols[self.ends[first - 1] + 1 if first else 0 : self.ends[last - 1] + 1]
        flat, starts, sizes = self.tables
        return gather(flat, starts[own], sizes[own])


def write_token_shards(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 2,
    shard_ids: int = 1 << 21,
    passes: int | None = None,
    per_pass: int = 4000,
    least: int = 8,
) -> None:
    """Encode every text, append ``end_id``, and write shards in ascending ``doc_id`` order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard = encoder(vocabulary), TaskContext.get().partitionId(), 0
        terminals = enc.tokenizer.get_vocab_size() + 1
        if terminals > SYMBOLS:
            raise ValueError("the vocabulary has more than 65,535 ids")
        ids, own, sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            counts = np.concatenate(sizes)
            payload = pack_shard(ids, counts, np.concatenate(own), terminals, passes=passes, per_pass=per_pass, least=least)
            row = [part, shard, len(ids), int(counts.sum()), ids[0], ids[-1], payload]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        for b in slices(batches):
            found, counts = enc.encode(b.column("text"))
            own.append(np.insert(found.astype(np.uint16), np.cumsum(counts), terminals - 1))
            sizes.append(counts + 1)
            ids += b.column("doc_id").to_pylist()
            held += len(own[-1])
            if held >= shard_ids:
                yield flush()
                ids, own, sizes, held, shard = [], [], [], 0, shard + 1
        if ids:
            yield flush()

    names = [x.split()[0] for x in SHARDS.split(", ")]
    # Rows of one id, or of none, are told apart by their texts and places, so that they spread as well.
    keys = ["doc_id", "_hash", "_row"]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    ordered = own.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select("doc_id", "text").mapInArrow(run, SHARDS).write.option("compression", "zstd").parquet(path)


def read_token_shards(spark: SparkSession, path: str, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """One row per document: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``), from the files."""
    shards = spark.read.schema(SHARDS).parquet(path)
    schema = "part int, shard int, doc_id long, _at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, payload in zip(*(b.column(c).to_pylist() for c in ("part", "shard", "payload")), strict=True):
                s = Shard(payload, end_id)
                ids = s.ids().astype("<u4")
                ends = np.cumsum(s.counts)
                cut = np.split(ids, ends[:-1])
                doc = pa.array([None if d == NO_ID else d for d in s.doc_ids.tolist()], pa.int64())
                cols = [pa.array(np.full(len(doc), x, np.int32)) for x in (part, shard)]
                cols += [doc, pa.array(ends - s.counts), pa.array(s.counts), pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64())]
                if keep_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    found = shards.select("part", "shard", "payload").mapInArrow(run, schema)
    # Ids ahead of each shard: running sums over parts (one row each), then over a part's shards.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    ahead = parts.select("part", F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_parts"))
    inside = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_shards")).join(ahead, "part")
    out = found.join(offsets, ["part", "shard"]).withColumn("start", F.col("_parts") + F.col("_shards") + F.col("_at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def token_shards(docs: DataFrame, vocabulary: str, end_id: int = 2, **how) -> DataFrame:
    """Write the shards into the shared folder and read every document back."""
    spark = docs.sparkSession
    path = new_folder(spark, "token-shards")
    write_token_shards(docs, path, vocabulary, end_id, **how)
    return read_token_shards(spark, path, end_id)
