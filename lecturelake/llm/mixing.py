"""Mixing sources to target weights by weighted sampling without replacement.

Each document draws an exponential key ``-ln(u) / quality weight`` (Efraimidis and Spirakis),
with ``u`` a hash of its id and text.  Inside its source, documents are taken in key order until the
source's word budget is spent: complete epochs over the whole source come first, and only the
remaining fraction is selected by key.  The document on the border gives its first words.

The running sum is built in three levels, so that a source holding most of the corpus is spread
over many tasks: sums per (source, key interval), a prefix over the intervals of a block of about
as many intervals as there are blocks, a prefix over blocks, then a running sum inside each
interval.

Defined results: a null text has size 0 and gives nothing; a null source is a source of its own,
last in order; rows without an id are told apart by their texts; equal keys are ordered by id (null
first), size and a hash of all plain columns, so reruns on any order of rows agree: rows that are
still equal are interchangeable and taken one after the other (they share one interval); an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

from .common import materialize, words

#: Characters that lower a document's quality weight.
MARKS = "#*$%&|<>"


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the id and the text."""
    named = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))), F.lit(seed))
    digits = F.substring(F.md5(named), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def quality_weight(text: Column, size: Column) -> Column:
    """In (0, 1]: words against words and symbols."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, MARKS, ""))
    return (size + 1).cast("double") / (size + 1 + symbols).cast("double")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``(source, source_size, target)``, one row per source.

    Sources weigh ``weights`` in turn, by code point with null last.  A source whose share would
    exceed ``cap`` times its size gets just that, and the others share the rest; in the order of
    cap against weight this is one pass with running sums.  The windows run over one row per
    source, not over documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.lit(float(weights[-1]))
    for i, x in reversed(list(enumerate(weights[:-1]))):
        turn = F.when(F.col("_rank") % len(weights) == i, F.lit(float(x))).otherwise(turn)
    per = per.withColumn("_rank", rank).withColumn("_w", turn)
    order = W.orderBy(F.col("_limit") / F.col("_w"), "_rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    per = (
        per.withColumn("_limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_total", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
        .withColumn("_spent", F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("_full", (F.col("_total") - F.col("_spent")) * F.col("_w") >= F.col("_limit") * F.col("_left"))
        .withColumn("_rest", F.col("_total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_limit"))).over(W.partitionBy()), F.lit(0.0)))
        .withColumn("_share", F.sum(F.when(~F.col("_full"), F.col("_w"))).over(W.partitionBy()))
    )
    target = F.when(F.col("_full"), F.col("_limit")).otherwise(F.col("_rest") * F.col("_w") / F.col("_share"))
    return per.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    rows_per_interval: int = 128,
    carry: Column | None = None,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document, its ``source`` and ``key``.

    ``carry`` is one more column that comes along as ``carried``.
    """
    size = F.size(words(F.col("text"))).cast("long")
    plain = [f.name for f in docs.schema if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)]
    sized = docs.select(
        "doc_id", "source", "text", size.alias("size"), F.xxhash64(*plain).alias("_tie"), (F.lit(None) if carry is None else carry).alias("carried")
    ).select(
        "doc_id", "source", "size", "_tie", *["carried"] * (carry is not None),
        (-F.log(uniform(F.col("doc_id"), F.col("text"), seed)) / quality_weight(F.col("text"), F.col("size"))).alias("key"),
    )
    sized = materialize(sized)
    intervals = max(1, -(-sized.count() // rows_per_interval))
    # Rising with the key, and no interval gets much more than its share at any weight.
    part = F.floor(F.col("key") / (1 + F.col("key")) * intervals).cast("long")
    sized = sized.select("*", F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"), part.alias("_p"))

    per = source_targets(sized, weights, share, cap).select(
        F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"), "source_size", "target"
    )
    before = lambda keys, by: F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    block = F.floor(F.col("_p") / math.isqrt(intervals)).cast("long")
    sums = sized.groupBy("_s", "_n", "_p").agg(F.sum("size").alias("_sum")).withColumn("_b", block)
    blocks = sums.groupBy("_s", "_n", "_b").agg(F.sum("_sum").alias("_sum")).select("_s", "_n", "_b", before(["_s", "_n"], "_b").alias("_blocks"))
    offsets = (
        sums.select("_s", "_n", "_b", "_p", before(["_s", "_n", "_b"], "_p").alias("_inside"))
        .join(blocks, ["_s", "_n", "_b"])
        .select("_s", "_n", "_p", (F.col("_blocks") + F.col("_inside")).alias("_offset"))
        .join(per, ["_s", "_n"])
    )
    inside = W.partitionBy("_s", "_n", "_p").orderBy("key", "doc_id", "size", "_tie").rowsBetween(W.unboundedPreceding, -1)
    run = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = F.round("target").cast("long") - F.col("_epochs") * F.col("source_size")
    return (
        sized.join(offsets, ["_s", "_n", "_p"])
        .withColumn("_run", run)
        .withColumn("_epochs", epochs.cast("long"))
        .select(
            "doc_id", "size", "source_size", "target",
            (F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("_run")))).cast("long").alias("taken"),
            "source", "key", *["carried"] * (carry is not None),
        )
    )


def take(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, the border document cut to the
    words it gives (and ``n_chars``, where there is one, counted anew)."""
    mixed = mix(docs, carry=F.struct(*docs.columns), **how).where("taken > 0")
    part = F.array_join(F.slice(words(F.col("carried.text")), 1, (F.col("taken") % F.col("size")).cast("int")), " ")
    times = F.array_repeat(F.col("carried.text"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    rest = F.when(F.col("taken") % F.col("size") > 0, F.array(part)).otherwise(F.array().cast("array<string>"))
    rows = mixed.select("carried", F.explode(F.concat(times, rest)).alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*[new.get(c, F.col("carried")[c]).alias(c) for c in docs.columns])
