"""Interpolated modified Kneser-Ney bigram model: counted in Spark, memory-mapped for scoring.

The model is a folder of flat little-endian arrays in the shared folder, all in hash order, 256
shards to a subfolder:

* ``vocab-<shard>.u64``: sorted XXH64 hashes of the training words, split by their top bits; a
  word's id is its place over all shards.
* ``base-<group>.i64``: where the places of a group's shards begin, within the group; there are at
  most 4,096 groups, whose own beginnings are part of what ``train`` returns.
* ``counts-<shard>.u32`` (or ``.u64``, where a count needs it) and ``stats-<shard>.f64``: per word,
  in that order, its count, and its backoff weight, words seen before it, tokens seen after it.
* ``pairs-<shard>.u64`` and ``counted-<shard>.u32`` (or ``.u64``): sorted mixed id pairs, split by
  their top bits, and their counts.

Counting never holds a corpus statistic in one place.  Tasks count words and id pairs in bounded
buffers, sort and pack them per shard, and Spark shuffles those packed runs by shard; the id pair
is mixed before it is sharded, so no frequent word gathers its pairs in one task.  A shard's file is
written under a temporary name and renamed, so that a lost executor's task can simply run again.

Workers map the files they need; memory holds the pages in use and a bounded word cache.  An id pair
fills 64 bits, so there can be 4,294,967,294 distinct words; more of them are an error.

Defined results: a null or empty text is its end token alone; a null id is hashed as the empty
text and so is held out; repeated rows train and score each; without training rows every score
is that of a uniform choice between the unknown word and nothing else; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_folder
from .tokens import chunks

#: Words that no text can contain: the start context and the end token.
START, END = b"\n<s>", b"\n</s>"
#: Entries that a task counts, and words that a worker keeps, before it starts afresh.
BUFFER, WORDS_KEPT = 3_000_000, 500_000
#: Files that a worker maps at once, shards of a subfolder, and bits of the number of groups of shards.
MAPS_KEPT, FOLDER_SHARDS, GROUP_BITS = 4096, 256, 12

PACKED = "shard int, data binary"


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


class Hashes(dict):
    """Word hashes by word, bounded."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = word_hash(word)
        return h


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def token_hashes(texts: list[str | None], known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every token (words, then one end), and the number of tokens of each text."""
    if len(known) > WORDS_KEPT:
        known.clear()
    split = [[*(t or "").encode("utf-8", "replace").lower().split(), END] for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    return np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.uint64, int(counts.sum())), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of u64 that spreads id pairs evenly (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * np.uint64(0x319642B2D24D8EC3)
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(0x96DE1B173F119089)
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def parts(owner: np.ndarray) -> Iterator[tuple[int, slice]]:
    """``(shard, its slice)`` for ascending shard numbers."""
    shards, first = np.unique(owner, return_index=True)
    ends = [*first.tolist(), len(owner)]
    for k, s in enumerate(shards.tolist()):
        yield s, slice(ends[k], ends[k + 1])


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _bytes(a: np.ndarray) -> bytes:
    """Bytes grouped by significance, which packs better."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _array(raw: bytes, kind: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).ravel()


def pack_run(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys and columns of one run; a column has four bytes a number, or eight if one needs them."""
    wide = [bool(len(c)) and int(c.max()) >= 1 << 32 for c in columns]
    parts = [len(keys).to_bytes(8, "little"), bytes(wide), _bytes(np.diff(keys, prepend=keys[:1] * 0))]
    return zstandard.compress(b"".join([*parts, *(_bytes(c.astype("<u8" if w else "<u4")) for c, w in zip(columns, wide, strict=True))]), 1)


def open_run(data: bytes, columns: int) -> tuple[np.ndarray, ...]:
    raw = zstandard.decompress(data)
    n, wide = int.from_bytes(raw[:8], "little"), raw[8 : 8 + columns]
    at, out = 8 + columns, []
    for kind in ["<u8", *("<u8" if w else "<u4" for w in wide)]:
        size = n * int(kind[2])
        out.append(_array(raw[at : at + size], kind, n) if n else np.zeros(0, kind))
        at += size
    return np.cumsum(out[0], dtype=np.uint64), *out[1:]


def combine(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums of the columns by key, keys ascending."""
    if not len(keys):
        return keys, columns
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], [np.add.reduceat(c[order].astype(np.int64), first) for c in columns]


class Counter:
    """Counts keys in a bounded buffer and gives packed runs per shard."""

    def __init__(self, bits: int):
        self.bits, self.raw, self.held, self.keys, self.counts = bits, [], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.raw.append(keys)
        self.held += len(keys)
        if self.held >= BUFFER:
            self.fold()
            if len(self.keys) >= BUFFER // 2:
                yield from self.flush()

    def fold(self) -> None:
        found, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.raw]), return_counts=True)
        self.keys, (self.counts,) = combine(np.concatenate([self.keys, found]), [np.concatenate([self.counts, counts])])
        self.raw, self.held = [], 0

    def flush(self) -> Iterator[pa.RecordBatch]:
        self.fold()
        yield from runs(self.keys, [self.counts], self.bits)
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def runs(keys: np.ndarray, columns: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """One packed run for each shard that has keys."""
    yield packed(keys, columns, shard_of(keys, bits))


def packed(keys: np.ndarray, columns: list[np.ndarray], owner: np.ndarray) -> pa.RecordBatch:
    own = [(s, pack_run(keys[at], *(c[at] for c in columns))) for s, at in parts(owner)]
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], ["shard", "data"])


def merged(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """``(shard, keys, summed columns)`` from rows ordered by shard."""
    now, held = None, []

    def close():
        parts = [open_run(x, columns) for x in held]
        return now, *combine(np.concatenate([p[0] for p in parts]), [np.concatenate([p[i + 1] for p in parts]) for i in range(columns)])

    for b in batches:
        for shard, data in zip(b.column("shard").to_pylist(), b.column("data").to_pylist(), strict=True):
            if shard != now and held:
                yield close()
                held = []
            now = shard
            held.append(data)
    if held:
        yield close()


def local(folder: str) -> str:
    """The path of a shared folder as tasks open it."""
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError(f"model files need a shared folder that is mounted, not {folder}")
    return re.sub("^file:/*", "/", folder)


def save(folder: str, name: str, data: np.ndarray) -> None:
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    data.tofile(part)
    os.replace(part, path)


def save_counts(folder: str, name: str, counts: np.ndarray) -> None:
    wide = len(counts) and int(counts.max()) >= 1 << 32
    save(folder, name + (".u64" if wide else ".u32"), counts.astype("<u8" if wide else "<u4"))


def load(folder: str, name: str, *kinds: str) -> np.ndarray:
    """The mapped array of a file with the ending of one of ``kinds`` (``u32`` and so on); empty if none."""
    for kind in kinds:
        path = os.path.join(folder, f"{name}.{kind}")
        if os.path.exists(path) and os.path.getsize(path):
            return np.memmap(path, f"<{kind[0]}{int(kind[1:]) // 8}", "r")
    return np.zeros(0, f"<{kinds[0][0]}8")


def file(name: str, shard: int) -> str:
    return f"{shard // FOLDER_SHARDS}/{name}-{shard}"


class Maps(dict):
    """Open arrays by name, not too many at once."""

    def __init__(self, folder: str, *kinds: str):
        self.folder, self.kinds = folder, kinds

    def __missing__(self, name: str) -> np.ndarray:
        if len(self) >= MAPS_KEPT:
            self.clear()
        out = self[name] = load(self.folder, name, *self.kinds)
        return out


class Sharded:
    """Sorted keys in files by shard, and arrays in the same order."""

    def __init__(self, model: dict, name: str):
        folder, self.name, self.bits = model["folder"], name, model["bits"]
        self.keys, self.numbers, self.stats_of = Maps(folder, "u64"), Maps(folder, "u32", "u64"), Maps(folder, "f64")

    def near(self, keys: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """For sorted keys: shard, which keys are its, their places in it, and whether they are there."""
        for s, at in parts(shard_of(keys, self.bits)):
            there = self.keys[file(self.name, s)]
            if len(there):
                near = np.minimum(np.searchsorted(there, keys[at]), len(there) - 1)
                yield s, at, near, there[near] == keys[at]

    def counts(self, keys: np.ndarray, name: str) -> np.ndarray:
        """Counts of sorted keys, 0 where absent."""
        out = np.zeros(len(keys), np.int64)
        for s, at, near, found in self.near(keys):
            out[at] = np.where(found, self.numbers[file(name, s)][near], 0)
        return out


class Words(Sharded):
    """The vocabulary: keys with ids, which are their places over all shards."""

    def __init__(self, model: dict):
        super().__init__(model, "vocab")
        self.tops, self.shift = np.array(model["tops"], np.int64), model["shift"]
        self.bases = Maps(model["folder"], "i64")

    def base(self, group: int) -> np.ndarray:
        """Where the places of a group's shards begin, and where the last ends."""
        inside = self.bases[file("base", group)]
        return self.tops[group] + (inside if len(inside) else np.zeros((1 << self.shift) + 1, np.int64))

    def span(self, shard: int) -> tuple[int, int]:
        base = self.base(shard >> self.shift)
        at = shard & ((1 << self.shift) - 1)
        return int(base[at]), int(base[at + 1])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of sorted keys, -1 where absent."""
        out = np.full(len(keys), -1, np.int64)
        for s, at, near, found in self.near(keys):
            out[at] = np.where(found, self.span(s)[0] + near, -1)
        return out

    def owner(self, ids: np.ndarray) -> np.ndarray:
        """The shards of ascending ids; what lies past the last word has one of its own."""
        out = np.full(len(ids), 1 << self.bits, np.int64)
        for g, at in parts(np.searchsorted(self.tops, ids, "right") - 1):
            if g < len(self.tops) - 1:
                out[at] = (g << self.shift) + np.searchsorted(self.base(g), ids[at], "right") - 1
        return out

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts, and three further numbers each, of ascending ids."""
        counts, stats = np.zeros(len(ids), np.int64), np.zeros((len(ids), 3))
        for s, at in parts(self.owner(ids)):
            near = ids[at] - self.span(s)[0]
            counts[at] = self.numbers[file("counts", s)][near]
            stats[at] = self.stats_of[file("stats", s)].reshape(-1, 3)[near]
        return counts, stats


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the counts of counts."""
    if not all(n[:4]):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3)]


def _exchange(packed: DataFrame) -> DataFrame:
    return packed.repartition("shard").sortWithinPartitions("shard")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def train(docs: DataFrame, shard_entries: int = 1 << 20) -> dict:
    """Count the rows that are not held out and write the model; what is returned is a few numbers."""
    spark = docs.sparkSession
    folder = local(new_folder(spark, "ngram"))
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = _texts(docs.where(crc % 10 != 0))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (size // (12 * shard_entries)).bit_length())
    shift = max(0, bits - GROUP_BITS)

    def words(batches):
        known, counter = Hashes(), Counter(bits)
        for _, texts in chunks(batches):
            yield from counter.add(token_hashes(texts, known)[0])
        yield from counter.flush()

    def vocabulary(batches):
        for shard, keys, (counts,) in merged(batches, 1):
            save(folder, file("vocab", shard) + ".u64", keys)
            save_counts(folder, file("counts", shard), counts)
            row = (shard >> shift, shard, len(keys), int(counts.sum()))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], ["group", "shard", "n", "total"])

    found = materialize(_exchange(rows.mapInArrow(words, PACKED)).mapInArrow(vocabulary, "group long, shard long, n long, total long"))
    # Rows of one group come as one list, so that a group is written once and whole.
    lists = found.groupBy("group").agg(F.collect_list(F.struct("shard", "n")).alias("own"), F.sum("n").alias("n"), F.sum("total").alias("total"))

    def group_bases(batches):
        for b in batches:
            for group, own, n, total in zip(*(b.column(c).to_pylist() for c in ("group", "own", "n", "total")), strict=True):
                sizes = np.zeros((1 << shift) + 1, np.int64)
                for x in own:
                    sizes[x["shard"] % (1 << shift) + 1] = x["n"]
                save(folder, file("base", group) + ".i64", np.cumsum(sizes).astype("<i8"))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (group, n, total)], ["group", "n", "total"])

    # At most 4,096 rows of three numbers.
    groups = lists.mapInArrow(group_bases, "group long, n long, total long").toPandas()
    sizes = np.zeros((1 << (bits - shift)) + 1, np.int64)
    sizes[groups["group"].to_numpy(np.int64) + 1] = groups["n"].to_numpy(np.int64)
    tops = np.cumsum(sizes)
    types = int(tops[-1])
    if types >= (1 << 32) - 1:
        raise ValueError(f"{types} distinct words are more than id pairs of 64 bits can tell apart")
    model = {"folder": folder, "bits": bits, "shift": shift, "tops": tops.tolist(), "tokens": int(groups["total"].sum()), "types": types}
    start = types  # the id of the start context, after all words

    def pairs(batches):
        known, counter, vocab = Hashes(), Counter(bits), Words(model)
        for _, texts in chunks(batches):
            hashes, counts = token_hashes(texts, known)
            unique, back = np.unique(hashes, return_inverse=True)
            ids = vocab.find(unique)[back].astype(np.uint64)
            before = np.concatenate([[start], ids[:-1]]).astype(np.uint64)
            before[(np.cumsum(counts) - counts)] = start
            yield from counter.add(mix(before << np.uint64(32) | ids))
        yield from counter.flush()

    def pair_shards(batches):
        """Write each shard's pairs and counts; give what contexts and words gather from it."""
        vocab = Words(model)
        for shard, keys, (counts,) in merged(batches, 1):
            save(folder, file("pairs", shard) + ".u64", keys)
            save_counts(folder, file("counted", shard), counts)
            ids = unmix(keys)
            one, two, more = counts == 1, counts == 2, counts >= 3
            none = np.zeros(len(keys), np.int64)
            both = np.concatenate([ids >> np.uint64(32), ids & np.uint64(0xFFFFFFFF)])
            own = [np.concatenate([x, none]) for x in (counts, one, two, more)] + [np.concatenate([none, none + 1])]
            keyed, sums = combine(both, own)
            batch = packed(keyed, sums, vocab.owner(keyed.astype(np.int64)))
            count = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
            m = batch.num_rows
            cols = [*batch.columns, pa.array([shard] * m, pa.int32())]
            cols += [pa.array([c] * m, pa.int64()) for c in count]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "data", "from", "n1", "n2", "n3", "n4"])

    gathered = materialize(
        _exchange(rows.mapInArrow(pairs, PACKED)).mapInArrow(pair_shards, PACKED + ", from int, n1 long, n2 long, n3 long, n4 long")
    )
    per = gathered.groupBy("from").agg(*[F.first(f"n{k}").alias(f"n{k}") for k in (1, 2, 3, 4)])
    model["discounts"] = discounts([x or 0 for x in per.agg(*[F.sum(f"n{k}") for k in (1, 2, 3, 4)]).first()])

    def words_low(batches):
        """Per word: context total, backoff weight and continuation count, in hash order."""
        d, vocab = model["discounts"], Words(model)
        for shard, keys, (total, one, two, more, left) in merged(batches, 5):
            first, last = (types, types + 1) if shard == 1 << bits else vocab.span(shard)
            out, at = np.zeros((last - first, 3)), keys.astype(np.int64) - first
            out[at, 0] = np.where(total > 0, (d[0] * one + d[1] * two + d[2] * more) / np.maximum(total, 1), 1.0)
            out[at, 1], out[at, 2] = left, total
            save(folder, file("stats", shard) + ".f64", out.astype("<f8"))
            count = [int((left == k).sum()) for k in (1, 2, 3, 4)] + [int((left >= 3).sum()), int(left.sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in count], ["n1", "n2", "n3", "n4", "more", "total"])

    low = _exchange(gathered.select("shard", "data")).mapInArrow(words_low, "n1 long, n2 long, n3 long, n4 long, more long, total long")
    sums = low.agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "more", "total")]).first()
    lower = discounts([sums[f"n{k}"] or 0 for k in (1, 2, 3, 4)])
    total = sums["total"] or 0
    spare = (lower[0] * (sums["n1"] or 0) + lower[1] * (sums["n2"] or 0) + lower[2] * (sums["more"] or 0)) / total if total else 1.0
    return model | {"lower": lower, "pair_types": total, "unknown": spare / (model["types"] + 1)}


class Scorer:
    """Log10 probabilities of token hashes under a model's files."""

    def __init__(self, model: dict):
        self.m, self.vocab, self.pairs = model, Words(model), Sharded(model, "pairs")
        start = load(model["folder"], file("stats", 1 << model["bits"]), "f64")
        #: Backoff weight and number of texts, for the start of a text.
        self.start = (float(start[0]), float(start[2])) if len(start) and start[2] else (1.0, 0.0)

    def score(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: its training count, its base log10 probability and the model's."""
        m = self.m
        unique, back = np.unique(hashes, return_inverse=True)
        place = self.vocab.find(unique)
        seen = place >= 0
        count, low, backoff, whole = (np.zeros(len(unique)) for _ in range(4))
        backoff += 1.0
        if seen.any():
            count[seen], stats = self.vocab.of(place[seen])
            left, d = stats[:, 1], np.array([0.0, *m["lower"]])
            low[seen] = np.maximum(left - d[np.minimum(left, 3).astype(np.int64)], 0) / max(m["pair_types"], 1)
            backoff[seen], whole[seen] = np.where(stats[:, 2] > 0, stats[:, 0], 1.0), stats[:, 2]
        low += m["unknown"]
        base = np.log10((count + 0.1) / (m["tokens"] + 0.1 * (m["types"] + 1)))
        first = np.cumsum(sizes) - sizes
        before = np.concatenate([back[:1], back[:-1]])
        ids = place[back]
        context = place[before]
        gamma, total = backoff[before], whole[before]
        context[first], gamma[first], total[first] = m["types"], *self.start
        both = (ids >= 0) & (context >= 0)
        keys, again = np.unique(mix(context[both].astype(np.uint64) << np.uint64(32) | ids[both].astype(np.uint64)), return_inverse=True)
        c = np.zeros(len(ids))
        c[both] = self.pairs.counts(keys, "counted")[again]
        d = np.array([0.0, *m["discounts"]])
        high = np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0) / np.maximum(total, 1)
        return count[back], base[back], np.log10(high + gamma * low[back])


_SCORERS: dict[str, Scorer] = {}

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: dict) -> DataFrame:
    """One row per document: token counts, base score, score and perplexity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        if model["folder"] not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[model["folder"]] = Scorer(model)
        scorer = _SCORERS[model["folder"]]
        for ids, texts in chunks(batches):
            hashes, sizes = token_hashes(texts, known)
            count, base, log = scorer.score(hashes, sizes)
            at = np.cumsum(sizes) - sizes
            cols = [
                pa.array(ids, pa.int64()),
                pa.array([held_out(i) for i in ids]),
                pa.array(sizes),
                pa.array(np.add.reduceat((count > 0).astype(np.int64), at)),
                pa.array(np.full(len(ids), model["tokens"], np.int64)),
                pa.array(np.add.reduceat(base, at)),
                pa.array(np.add.reduceat(log, at)),
            ]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCORES.split(", ")])

    scored = _texts(docs).mapInArrow(run, SCORES)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out and score every row."""
    return score(docs, train(docs))

