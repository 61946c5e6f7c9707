"""Sharding by extendible hashing: a directory over hash-prefix bits, split only where needed.

A document's bucket is the shortest prefix of its id's hash whose documents fit the byte limit;
only a bucket over the limit is split on another bit.  Bytes are first summed per cell (a prefix
fine enough that cells are much smaller than the limit), each cell adds to all of its prefixes,
and a cell belongs to its shortest prefix that fits.  Cells that alone exceed the limit go through
the same step on the bits that follow.  Rows with equal ids are told apart by a second hash, of
their place in the table, once the id's bits are used up.

Defined results: a null text has 0 bytes, a null id is hashed as empty; repeated rows count each;
one row over the limit is a shard of its own; an empty table gives an empty result; ``columns``
names what is carried along, whatever else the table holds, and a carried column named like one of
the result's gets underscores in front until its name is free.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bits taken from each of the two hashes.
BITS = 60


def _hash(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, BITS // 4), 16, 10).cast("long")


#: What ``assign`` and ``with_slots`` add.
ADDED = ("bytes", "depth", "shard", "shard_bytes", "shard_docs", "global_depth", "first_slot", "slots")


def carried_names(columns: Sequence[str]) -> dict[str, str]:
    """The names under which ``columns`` are carried along."""
    out, taken = {}, {c.lower() for c in (*ADDED, *columns)}
    for c in columns:
        name = c
        while name != c and name.lower() in taken or name.lower() in ADDED:
            name = "_" + name
        out[c] = name
        taken.add(name.lower())
    return out


def assign(docs: DataFrame, limit: int, columns: Sequence[str] = ("doc_id",), spread: int = 6, more: int = 10) -> DataFrame:
    """``columns`` and ``bytes, depth, shard, shard_bytes, shard_docs`` for every row.

    ``shard`` is the bucket's prefix as text (``-`` at depth 0).  Cells are made about
    ``2 ** spread`` times smaller than the limit; where that is not enough, ``more`` bits follow.
    """
    return _assigned(docs, limit, columns, spread, more)[0]


def assign_with_slots(docs: DataFrame, limit: int, columns: Sequence[str] = ("doc_id",), spread: int = 6, more: int = 10) -> DataFrame:
    """``with_slots`` of ``assign``, with the global depth read from the buckets instead of the rows."""
    placed, depth = _assigned(docs, limit, columns, spread, more)
    return with_slots(placed, depth)


def _assigned(docs: DataFrame, limit: int, columns: Sequence[str], spread: int, more: int) -> tuple[DataFrame, int]:
    """The rows of ``assign``, and the largest depth."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    place = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    names = list(carried_names(columns).values())
    kept = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(columns)]
    rows = materialize(docs.select(*kept, size.alias("_bytes"), _hash(name).alias("_h0"), _hash(place).alias("_h1"), F.lit("").alias("_base")))
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + spread)
    out, used, deepest = [], 0, 0
    while True:
        h, last = ("_h0", used) if used < BITS else ("_h1", used - BITS)
        bits = min(bits, BITS - last)
        shift = BITS - last - bits
        open_rows = rows.withColumn("_cell", F.shiftright(F.col(h), shift).bitwiseAND((1 << bits) - 1))
        cells = materialize(open_rows.groupBy("_base", "_cell").agg(F.sum("_bytes").alias("_b"), F.count(F.lit(1)).alias("_n")))
        final = used + bits >= 2 * BITS
        depth = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("_d")
        prefix = F.expr(f"shiftright(_cell, {bits} - _d)").alias("_p")
        nodes = cells.select("_base", "_b", "_n", "_cell", depth).select("_base", "_b", "_n", "_d", prefix)
        nodes = nodes.groupBy("_base", "_d", "_p").agg(F.sum("_b").alias("_nb"), F.sum("_n").alias("_nn"))
        fits = (F.col("_nb") <= limit) | (F.col("_nn") == 1) | (F.lit(final) & (F.col("_d") == bits))
        nodes = materialize(nodes.where(fits))
        least = nodes.agg(F.min("_d")).first()[0]
        # Above the shallowest prefix that fits there is nothing to find, so no prefix is looked
        # up by more than the few cells below it.
        deep = F.explode(F.sequence(F.lit(bits if least is None else least), F.lit(bits))).alias("_d")
        leaves = materialize(
            cells.select("_base", "_cell", deep)
            .select("_base", "_cell", "_d", prefix)
            .join(nodes, ["_base", "_d", "_p"])
            .groupBy("_base", "_cell")
            .agg(F.min(F.struct("_d", "_p", "_nb", "_nn")).alias("_leaf"))
        )
        deepest = max(deepest, used + (leaves.agg(F.max("_leaf._d")).first()[0] or 0))
        found = open_rows.join(leaves, ["_base", "_cell"], "left")
        code = F.concat("_base", F.when(F.col("_leaf._d") > 0, F.expr("lpad(bin(_leaf._p), _leaf._d, '0')")).otherwise(""))
        settled = found.where(F.col("_leaf").isNotNull()).select(
            *[F.col(f"_k{i}").alias(c) for i, c in enumerate(names)],
            F.col("_bytes").alias("bytes"),
            (F.lit(used) + F.col("_leaf._d")).cast("long").alias("depth"),
            F.when(code == "", "-").otherwise(code).alias("shard"),
            F.col("_leaf._nb").alias("shard_bytes"),
            F.col("_leaf._nn").alias("shard_docs"),
        )
        out.append(settled)
        over = cells.where((F.col("_b") > limit) & (F.col("_n") > 1)).limit(1).count()
        if final or not over:
            return reduce(DataFrame.unionByName, out), deepest
        rest = found.where(F.col("_leaf").isNull()).withColumn("_base", F.concat("_base", F.expr(f"lpad(bin(_cell), {bits}, '0')")))
        rows = materialize(rest.select(*[f"_k{i}" for i in range(len(columns))], "_bytes", "_h0", "_h1", "_base"))
        used, bits = used + bits, more


def with_slots(placed: DataFrame, depth: int | None = None) -> DataFrame:
    """``placed`` (from ``assign``) with its place in the directory: ``global_depth`` (bits that index
    it), and the bucket's ``first_slot`` (as bits) and number of ``slots`` (null past a long).  ``depth``: the global depth, where it
    is known."""
    depth = (placed.agg(F.max("depth")).first()[0] or 0) if depth is None else depth
    spare = F.lit(depth) - F.col("depth")
    bits = F.when(F.col("shard") == "-", "").otherwise(F.col("shard"))
    return placed.select(
        "*",
        F.lit(depth).cast("long").alias("global_depth"),
        F.rpad(bits, F.lit(depth), F.lit("0")).alias("first_slot"),
        F.when(spare < 63, F.expr(f"shiftleft(1L, cast(least(62, {depth} - depth) as int))")).alias("slots"),
    )


def directory(placed: DataFrame) -> DataFrame:
    """The directory, one row per bucket: runs of slots that share a bucket, in slot order when sorted
    by ``first_slot``.  Together the buckets hold every slot at most once."""
    return with_slots(placed.select("shard", "depth", "shard_bytes", "shard_docs").distinct())


def write_shards(docs: DataFrame, path: str, limit: int) -> None:
    """Write the documents as one folder per shard, with all their columns (see ``carried_names``)."""
    placed = assign(docs, limit, docs.columns)
    placed.select(*carried_names(docs.columns).values(), "shard").repartition("shard").write.partitionBy("shard").parquet(path)
