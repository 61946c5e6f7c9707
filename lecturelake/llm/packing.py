"""Best-fit packing of token pieces into sequences of a fixed length, by minimum bin slack.

Bin by bin, the longest piece left is placed and a bitset subset-sum over the lengths left finds
the fullest combination that still fits beside it; the combination is then removed.  Lengths are
integers up to the capacity, so the choice depends on the histogram of lengths alone, which has
``capacity`` entries however many pieces there are.  As long as a combination is available it
stays the fullest one, so it is used as often as the histogram allows in one step, and the whole
plan is made from the histogram.  The pieces themselves never leave their tasks: each gets its
rank within its length (a two-level running count) and reads its place from the plan.

Defined results: a null or empty text gives one piece holding the end id; repeated rows are
packed separately; pieces of equal length are ranked by id and piece; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .tokens import chunks, encoder, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece of every text: whole when it fits ``capacity``, else cut there.

    ``keep_ids`` adds the ids themselves as an array.
    """
    schema = PIECES + ", ids array<int>" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for doc_ids, texts in chunks(batches):
            ids, counts = with_end(*enc.encode(texts), end_id)
            raw, at, rows = ids.astype("<u4"), 0, []
            for d, n in zip(doc_ids, counts.tolist(), strict=True):
                for k, s in enumerate(range(0, n, capacity)):
                    own = raw[at + s : at + min(s + capacity, n)]
                    row = (d, k, s, len(own), zlib.crc32(own.tobytes()))
                    rows.append((*row, own.astype(np.int32)) if keep_ids else row)
                at += n
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """The lengths (and how many of each) whose sum is the largest that is not over ``room``."""
    steps: list[tuple[int, int, int]] = []
    reach, limit = 1, (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, part = min(int(counts[length]), room // length), 1
        while left and not reach >> room & 1:
            part = min(part, left)
            steps.append((length, part, reach))
            reach = (reach | reach << (length * part)) & limit
            left, part = left - part, part * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + part
            total -= length * part
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first rank, end rank, first bin, copies in a bin, offset)`` for all pieces."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used, rows, bins = np.zeros(capacity + 1, np.int64), [], 0
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            chosen = fullest(counts, capacity - longest)
            counts[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            times = min(int(counts[x]) // k for x, k in chosen.items())
            offset = 0
            for x, k in sorted(chosen.items(), reverse=True):
                rows.append((x, int(used[x]), int(used[x]) + times * k, bins, k, offset))
                counts[x] -= times * k
                used[x] += times * k
                offset += x * k
            bins += times
    return rows


def pack(sized: DataFrame, capacity: int = 2048, rows_per_group: int = 1024) -> DataFrame:
    """``sized`` (with ``doc_id, piece, length``) plus ``sequence_id`` and ``offset``."""
    spark = sized.sparkSession
    histogram = {r["length"]: r["n"] for r in sized.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.createDataFrame(
        plan(histogram, capacity), "_length long, _from long, _to long, _bin long, _copies long, _offset long"
    )
    groups = spark.createDataFrame(
        [(x, -(-n // rows_per_group)) for x, n in histogram.items()], "length long, _groups long"
    )
    # Both tables depend on the capacity, not on the corpus.
    grouped = sized.join(F.broadcast(groups), "length").withColumn(
        "_g", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_groups"))
    )
    counts = grouped.groupBy("length", "_g").agg(F.count(F.lit(1)).alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / rows_per_group))
    if counts.where(F.col("_parts") > 4).limit(1).count():
        # Rows of one id, or of none, meet in a group: such groups are split by the rows' places in the table.
        part = F.when(F.col("_parts") > 4, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts"))).otherwise(0)
        grouped = materialize(grouped.join(counts.drop("_n"), ["length", "_g"]).withColumn("_part", part).drop("_parts"))
    else:
        grouped = grouped.withColumn("_part", F.lit(0).cast("long"))
    ahead = W.partitionBy("length").orderBy("_g", "_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        grouped.groupBy("length", "_g", "_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("length", "_g", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    )
    ranked = grouped.join(offsets, ["length", "_g", "_part"]).withColumn(
        "_rank", F.col("_ahead") + F.row_number().over(W.partitionBy("length", "_g", "_part").orderBy("doc_id", "piece")) - 1
    )
    j = F.col("_rank") - F.col("_from")
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(places), on).select(
        *sized.columns,
        (F.col("_bin") + F.floor(j / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + j % F.col("_copies") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    return pack(materialize(pieces(docs, vocabulary, capacity, end_id)), capacity)


def sequences(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids``, at most ``capacity`` ids each."""
    packed = pack(materialize(pieces(docs, vocabulary, capacity, end_id, keep_ids=True)), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
