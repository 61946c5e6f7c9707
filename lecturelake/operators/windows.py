"""Minute windows that follow the segments, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import text as tx
from ..functions.helpers import step_windows
from ..functions.scans import KEYS, LECTURE, along, before, block_rows, by_time, deal, inside
from ..schemas import segment_order
from .summaries import LISTS, exam_flags, exam_lists, first_sentences


def number_windows(segments: DataFrame, window_sec: int = 60) -> DataFrame:
    """Segments with ``first_ms``, ``seq`` (from 0) and ``window_idx``.

    Windows start with the lecture.  A segment that ends after the current window moves on by
    exactly one window.  With ``k`` the window a segment's end asks for and ``j`` its place, the number is
    the place plus the smallest ``k - j`` so far, and at most one more than the place: a running minimum,
    taken in hours and carried over them.  That holds where ends don't go back; the segments of other
    lectures are stepped along, one lecture after the other, with a constant state.
    """
    width, order = window_sec * 1000, segment_order()
    upto = inside(*order).rowsBetween(W.unboundedPreceding, 0)
    local = [(F.row_number().over(inside(*order)) - 1).cast("long").alias("_j"), F.first("start_ms").over(upto).alias("_from"), F.lag("end_ms").over(inside(*order)).alias("_before")]
    dealt = deal(segments, by_time())
    rows = dealt.select("*", *local)
    carried = _carried(rows, width)
    names = [*segments.columns, "first_ms", "seq", "window_idx"]

    even = rows.drop("_from", "_before").join(carried.where("not _odd"), KEYS)
    even = even.withColumn("seq", F.col("_ahead") + F.col("_j"))
    asked = F.greatest(F.floor((F.col("end_ms") - F.col("first_ms") + width - 1) / width) - 1, F.lit(0)) - F.col("seq")
    least = F.least("_carry", F.min(asked).over(upto))
    even = even.withColumn("window_idx", F.least(F.col("seq") + 1, F.col("seq") + least).cast("long")).select(*names)

    odd = dealt.join(carried.where("_odd"), KEYS).withColumn("seq", F.col("_ahead") + F.row_number().over(inside(*order)) - 1)
    odd = odd.select(*segments.columns, "first_ms", F.col("seq").cast("long").alias("seq"), LECTURE).repartition(LECTURE).sortWithinPartitions(LECTURE, "seq")
    return even.unionByName(step_windows(odd, LECTURE, "first_ms", "end_ms", width, "window_idx").select(*names))


def _carried(rows: DataFrame, width: int) -> DataFrame:
    """For each hour of a lecture: ``first_ms``, the segments before it (``_ahead``), the smallest ``k - j``
    before it (``_carry``), and whether the lecture's ends go back (``_odd``).

    ``k`` counts windows from the lecture's start, which an hour doesn't know.  It is the quotient of the
    end, less one of the start, and one more where the end's rest is larger; so the smallest quotient less
    place, with the smallest rest that has it, gives the minimum for any start.  Ends at the very start
    ask for window 0; they are in the first hour, which knows it.
    """
    end, j = F.col("end_ms"), F.col("_j")
    quotient = F.floor(end / width)
    least = lambda c: F.min(F.when(c, F.struct((quotient - j).alias("q"), (end - quotient * width).alias("r"))))
    blocks = block_rows(
        rows,
        F.count(F.lit(1)).alias("_n"),
        F.min("_from").alias("_start"),
        F.max((end < F.col("_before")) | (end < F.col("start_ms"))).alias("_back"),
        F.min_by("end_ms", "_j").alias("_first_end"),
        F.max_by("end_ms", "_j").alias("_last_end"),
        least(F.lit(True)).alias("_every"),
        least(end > F.col("_from")).alias("_later"),
        F.max(F.when(end <= F.col("_from"), j)).alias("_still"),
    )
    lecture = W.partitionBy(LECTURE)
    blocks = blocks.select(
        "*",
        F.min("_start").over(lecture).alias("first_ms"),
        F.coalesce(F.sum("_n").over(before()), F.lit(0)).cast("long").alias("_ahead"),
        (F.row_number().over(along()) == 1).alias("_opens"),
        F.coalesce(F.col("_first_end") < F.lag("_last_end").over(along()), F.lit(False)).alias("_step_back"),
    )
    start = F.floor(F.col("first_ms") / width)
    rest = F.col("first_ms") - start * width
    value = lambda m: F.col(m)["q"] + (F.col(m)["r"] > rest).cast("long") - start - 1 - F.col("_ahead")
    own = F.when(F.col("_opens"), F.least(value("_later"), -F.col("_still"))).otherwise(value("_every"))
    blocks = blocks.withColumn("_own", own).withColumn("_odd", F.max(F.coalesce("_back", F.lit(False)) | F.col("_step_back")).over(lecture))
    return blocks.select(*KEYS, "first_ms", "_ahead", "_odd", F.min("_own").over(before()).alias("_carry"))


def micro_summaries(segments: DataFrame, window_sec: int = 60, max_len: int = 60, exam: bool = False, words: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """One row per window: its bounds, a short summary of its raw text, and with ``exam`` the exam lists
    (empty lists without).

    A first segment longer than a window leaves an empty window before it.  Of a window's text only
    what the summary can show is joined, so a window may hold any number of segments.
    """
    width = window_sec * 1000
    needed = segments.select("video_id", "segment_id", "start_ms", "end_ms", "src")
    rows = number_windows(needed, window_sec).withColumnRenamed("src", "text").withColumns(exam_flags(exam, words))
    bounds = F.min("first_ms").alias("first_ms"), (F.min("seq") == 0).alias("_opens")
    found = first_sentences(rows, ["video_id", "window_idx"], ["seq"], *bounds, *exam_lists(exam, words))
    found = found.withColumn("_w", F.when(F.col("_opens") & (F.col("window_idx") == 1), F.array(F.lit(0).cast("long"), "window_idx")).otherwise(F.array("window_idx")))
    found = found.select(F.col("window_idx").alias("_own"), F.explode("_w").alias("window_idx"), "video_id", "first_ms", "_t", *LISTS)
    here = F.col("window_idx") == F.col("_own")
    start = F.col("first_ms") + F.col("window_idx") * width
    return found.select("video_id", "window_idx", start.alias("start_ms"), (start + width).alias("end_ms"), F.when(here, F.col("_t")).otherwise("").alias("_t"),
                        *[F.when(here, F.col(c)).otherwise(F.array().cast("array<string>")).alias(c) for c in LISTS]).select(
        "video_id", "window_idx", "start_ms", "end_ms", tx.short_summary(F.col("_t"), max_len).alias("summary"), *LISTS
    )
