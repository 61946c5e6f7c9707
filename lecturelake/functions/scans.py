"""Values that run along a lecture, in two levels, so that no task holds a whole lecture.

Rows are dealt out by lecture and block: an hour, or a run of paragraph numbers.  Values run inside
blocks, and what earlier blocks add comes from a window over one row per block.

Both levels read the same dealt rows.  ``block_rows`` touches the columns that the rows themselves carry
on (all, or those named), so that the engine finds one exchange to reuse and the rows are made once;
where more or fewer are carried on, they are made twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

HOUR_MS, NUMBERS = 3_600_000, 1024
LECTURE, BLOCK = "__lecture", "__block"
KEYS = [LECTURE, BLOCK]
#: Stands for a missing lecture; what has no place in order comes first.
NO_LECTURE, FIRST = "\x00", -(1 << 62)


def by_time(start: str = "start_ms", width_ms: int = HOUR_MS) -> Column:
    return F.floor(F.col(start) / width_ms)


def by_number(number: str = "paragraph_id", width: int = NUMBERS) -> Column:
    return F.floor(F.col(number) / width)


def deal(rows: DataFrame, block: Column, key: str = "video_id") -> DataFrame:
    """``rows`` by lecture and block; blocks must rise with the order inside a lecture."""
    named = rows.withColumn(LECTURE, F.coalesce(F.col(key).cast("string"), F.lit(NO_LECTURE)))
    return named.withColumn(BLOCK, F.coalesce(block.cast("long"), F.lit(FIRST))).repartition(*KEYS)


def inside(*order: Column | str) -> W:
    return W.partitionBy(*KEYS).orderBy(*order)


def along() -> W:
    """A lecture's blocks in order."""
    return W.partitionBy(LECTURE).orderBy(BLOCK)


def before() -> W:
    return along().rowsBetween(W.unboundedPreceding, -1)


def block_rows(dealt: DataFrame, *values: Column, touch: Sequence[str] | None = None) -> DataFrame:
    """One row per block."""
    plain = touch or [f.name for f in dealt.schema if not isinstance(f.dataType, (MapType, VariantType))]
    touched = F.max(F.xxhash64(*[f"`{c}`" for c in plain])).isNotNull()
    return dealt.groupBy(*KEYS).agg(*values, touched.alias("_touched")).where("_touched").drop("_touched")


def numbered(rows: DataFrame, block: Column, order: list[Column | str], name: str, of: Sequence[str], total: str | None = None, key: str = "video_id") -> DataFrame:
    """``rows`` with ``name``, from 1 in each lecture, and ``total``, the lecture's number of rows; ``of``
    names the columns that ``order`` is made of."""
    dealt = deal(rows, block, key)
    sizes = block_rows(dealt, F.count(F.lit(1)).alias("_n"), touch=[key, *of])
    ahead = [F.coalesce(F.sum("_n").over(before()), F.lit(0)).alias("_ahead")]
    if total:
        ahead.append(F.sum("_n").over(W.partitionBy(LECTURE)).alias("_all"))
    placed = dealt.withColumn("_inside", F.row_number().over(inside(*order))).join(sizes.select(*KEYS, *ahead), KEYS)
    found = placed.withColumn(name, (F.col("_ahead") + F.col("_inside")).cast("long"))
    return found.select(*rows.columns, name, *([F.col("_all").cast("long").alias(total)] if total else []))
