"""Prefix trie of conversations, its subtree totals by time-forward processing.

Conversations that begin with the same turns share the nodes of those turns.  A node is named by a
hash chained over its turns.  Totals rise from the leaves: nodes are sorted externally by
reverse level order, and each passes its totals to its parent through a priority queue ordered like the
nodes, which spills sorted runs when it holds too much.

Sharding is by weight.  A node's weight is the number of turns that its members have from it
on, a bound on the nodes below it that needs no recursion; it falls along every path.  Nodes of weight
up to ``limit`` form shards, each below its topmost such node; nodes up to ``limit ** 2`` form the
shards above them, and so on, so that each round's shards are bounded and a subtree holding most of
the corpus is spread.  A round's shard roots pass their totals, added up before the shuffle, to
the nodes of later rounds.

Defined results: turns without a conversation id belong to none and are left out; null roles and
texts are empty; turns with equal numbers are ordered by role and text, and repeated turns stay; an
empty table has no nodes; further columns are ignored.  A conversation is a path, so its turns
stream through one task, and so do the ids that end at a node, since their digest is one; both with
a constant state, whatever their number.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize

#: Weight of a shard at most, and messages that a queue holds before it spills.
SHARD_WEIGHT, MESSAGES_HELD = 1 << 16, 1 << 18
ROOT = bytes(16)
KEY, PARENT = ["k1", "k2"], ["p1", "p2"]


class SpillingQueue:
    """A priority queue of tuples of ``width`` longs.

    What it can't hold goes to sorted runs in unnamed files of the task, as in a sort that spills;
    nothing else reads them, and they end with the task.
    """

    def __init__(self, held: int = MESSAGES_HELD, width: int = 5):
        self.held, self.form = held, struct.Struct(f"<{width}q")
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []
        self.spilled = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.held:
            run = tempfile.TemporaryFile()
            for x in sorted(self.heap):
                run.write(self.form.pack(*x))
            run.seek(0)
            self.heap, self.spilled = [], self.spilled + 1
            self._next(run)

    def _next(self, run) -> None:
        """The next item of a run; an empty run is closed."""
        raw = run.read(self.form.size)
        if raw:
            heapq.heappush(self.runs, (self.form.unpack(raw), id(run), run))
        else:
            run.close()

    def top(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] <= self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] <= self.heap[0]):
            item, _, run = heapq.heappop(self.runs)
            self._next(run)
            return item
        return heapq.heappop(self.heap)

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)


def rebuilt(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """``conv_id, depth, length, role, text``: the turns of every conversation after the exchange of
    beginnings, and a row of depth 0 each.

    A conversation takes its first turns, crc32 of its id modulo ``heads`` many, from the one whose id is
    the next lower multiple of ``every``.
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    )
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.select("conv_id", F.row_number().over(order).alias("o"), "role", "text")
    c = F.col("conv_id")
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    own = own.select("conv_id", "n", (c - c % every).alias("base"), (F.crc32(c.cast("string")) % heads).cast("int").alias("h"))
    first = turns.where((c % every == 0) & (F.col("o") < heads)).select(c.alias("base"), "o", "role", "text")
    given = first.groupBy("base").agg(F.count(F.lit(1)).cast("int").alias("given"))
    whole = own.join(given, "base", "left").withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
    whole = whole.withColumn("length", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long"))
    columns = ["conv_id", "depth", "length", "role", "text"]
    later = turns.join(whole, "conv_id").where("o > h").withColumn("depth", (F.col("taken") + F.col("o") - F.col("h")).cast("long"))
    begin = whole.join(first, "base").where("o <= h").withColumn("depth", F.col("o").cast("long"))
    roots = whole.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", F.lit("").alias("role"), F.lit("").alias("text"))
    return later.select(*columns).unionByName(begin.select(*columns)).unionByName(roots)


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, length, k1, k2, p1, p2, words``: the node and its parent of every turn."""
    names = ["conv_id", "depth", "length", *KEY, *PARENT, "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ROOT
        for b in batches:
            keys, parents, words = [], [], []
            for depth, role, text in zip(*(b.column(c).to_pylist() for c in ("depth", "role", "text")), strict=True):
                above, said, by = key, text.encode("utf-8", "replace"), role.encode("utf-8", "replace")
                key = hashlib.blake2b(above + struct.pack("<q", len(by)) + by + said, digest_size=16).digest() if depth else ROOT
                keys.append(key)
                parents.append(above if depth else ROOT)
                words.append(len(said.split()))
            pairs = [np.frombuffer(b"".join(x), np.int64).reshape(-1, 2) for x in (keys, parents)]
            columns = [pa.array(x[:, i]) for x in pairs for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:3]), *columns, pa.array(words, pa.int64())], names)

    laid = turns.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return laid.mapInArrow(run, "conv_id long, depth long, length long, k1 long, k2 long, p1 long, p2 long, words long")


def nodes_of(rows: DataFrame, limit: int) -> DataFrame:
    """One row per node: its key and parent, ``conv_id`` (the smallest member), ``depth, n_convs, words``
    and ``round``, in which the powers of ``limit`` put its weight."""
    found = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("depth").alias("depth"),
        *[F.max(c).alias(c) for c in (*PARENT, "words")], F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )
    powers = [limit**i for i in range(1, 64) if limit**i < 1 << 62]
    return found.withColumn("round", sum(((F.col("weight") > F.lit(x)).cast("int") for x in powers), F.lit(0)))


def with_shards(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``nodes`` and ``s1, s2``, the root of its shard: the first node of its round on its path."""
    on_paths = rows.select("conv_id", "depth", *KEY).join(nodes.select(*KEY, "round"), KEY)
    tops = on_paths.groupBy("conv_id", "round").agg(F.min(F.struct("depth", *KEY)).alias("t"))
    return nodes.join(tops.select("conv_id", "round", F.col("t.k1").alias("s1"), F.col("t.k2").alias("s2")), ["conv_id", "round"])


def forward(laid: DataFrame, held: int = MESSAGES_HELD) -> DataFrame:
    """Totals of all nodes of some shards, sorted by shard and reverse level order, in one pass.

    ``laid`` has what earlier shards pass to a node as ``children, leaves, saved``.
    """
    names = [*KEY, *PARENT, "top", "children", "leaves", "saved"]
    read = ["s1", "s2", "depth", *KEY, *PARENT, "n_convs", "words", "children", "leaves", "saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(held), None
        for b in batches:
            out = []
            for s1, s2, depth, k1, k2, p1, p2, n, words, children, leaves, saved in zip(*(b.column(c).to_pylist() for c in read), strict=True):
                if (s1, s2) != shard:
                    if len(queue):
                        raise ValueError("a message for no node: the rows are not in reverse level order")
                    shard = (s1, s2)
                me = (-depth, k1, k2)
                saved += (n - 1) * words
                while (message := queue.top()) and message[:3] == me:
                    queue.pop()
                    children, leaves, saved = children + 1, leaves + message[3], saved + message[4]
                leaves = leaves if children else 1
                top = (k1, k2) == shard
                if not top:
                    queue.push((1 - depth, p1, p2, leaves, saved))
                out.append((k1, k2, p1, p2, top, children, leaves, saved))
            kinds = [pa.bool_() if c == "top" else pa.int64() for c in names]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return laid.select(*read).mapInArrow(run, "k1 long, k2 long, p1 long, p2 long, top boolean, children long, leaves long, saved long")


def totals(nodes: DataFrame, held: int = MESSAGES_HELD) -> DataFrame:
    """``k1, k2, children, leaves, saved`` of every node (with ``s1, s2, round``), round after round."""
    sums, done = ["children", "leaves", "saved"], None
    for r in sorted(x["round"] for x in nodes.select("round").distinct().collect()) or [0]:  # at most 63, a logarithm
        own = nodes.where(F.col("round") == r)
        if done is None:
            own = own.select("*", *[F.lit(0).cast("long").alias(c) for c in sums])
        else:
            passed = done.where("top").groupBy(*[F.col(p).alias(k) for p, k in zip(PARENT, KEY, strict=True)])
            passed = passed.agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            own = own.join(passed, KEY, "left").na.fill(0, sums)
        laid = own.repartition("s1", "s2").sortWithinPartitions("s1", "s2", F.col("depth").desc(), *KEY)
        now = materialize(forward(laid, held))
        done = now if done is None else done.unionByName(now)
    return done


def end_digests(rows: DataFrame) -> DataFrame:
    """``k1, k2, ends``: SHA-256 of the ids of the conversations that end at a node, ascending, comma-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for b in batches:
            out = []
            for *node, conv in zip(*(b.column(c).to_pylist() for c in (*KEY, "conv_id")), strict=True):
                if node == now:
                    digest.update(b",%d" % conv)
                else:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(b"%d" % conv)
            yield _ends(out)
        yield _ends([(*now, digest.hexdigest())] if now else [])

    laid = rows.where("depth = length").select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return laid.mapInArrow(run, "k1 long, k2 long, ends string")


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], [*KEY, "ends"])


def trie(turns: DataFrame, limit: int = SHARD_WEIGHT, held: int = MESSAGES_HELD) -> DataFrame:
    """One row per node of the trie of ``turns`` (as from ``rebuilt``): ``conv_id`` (its smallest
    member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    rows = materialize(paths(turns))
    plain = materialize(nodes_of(rows, limit))
    nodes = materialize(with_shards(plain, rows))
    discard(plain)
    sums, ends = totals(nodes, held), end_digests(rows)
    parent = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    parent_id = F.when(F.col("depth") > 0, F.col("parent_conv_id"))
    joined = nodes.join(sums.select(*KEY, "children", "leaves", "saved"), KEY).join(ends, KEY, "left").join(parent, PARENT, "left")
    return joined.select(
        "conv_id", "depth", parent_id.alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, limit: int = SHARD_WEIGHT, held: int = MESSAGES_HELD) -> DataFrame:
    """``trie`` of the rebuilt conversations."""
    return trie(rebuilt(conversations), limit, held)
