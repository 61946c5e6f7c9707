"""Segments in order, merged into paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import text as tx
from ..functions.helpers import fill_functions, fill_starts, greedy_fill
from ..functions.scans import KEYS, LECTURE, by_time, deal, numbered
from ..schemas import segment_order


def order_segments(segments: DataFrame) -> DataFrame:
    """``segments`` with ``seq``, from 1 within each lecture."""
    return numbered(segments, by_time(), segment_order(), "seq", ["start_ms", "end_ms", "segment_id"])


def merge_segments(segments: DataFrame, min_chars: int = 200, max_gap_ms: int = 1500, style: str = "student", words: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """Paragraphs: cleaned segments are appended until they have ``min_chars`` characters.

    Where a paragraph closes depends on all segments before it, but what an hour of segments does to the
    characters held before it is a small function: of fewer than ``min_chars`` of them, it gives what
    is held after and how many paragraphs it closes.  Hours are read in parallel for these functions,
    which are applied one after the other, and read again in parallel with what each begins with.

    ``max_gap_ms`` is accepted and has no effect: a paragraph that a pause could close is long
    enough to have been closed before.
    """
    clean = segments.select("video_id", *[c.alias(f"_o{i}") for i, c in enumerate(segment_order())], tx.normalize(F.col("src"), fillers=words.fillers, tags=words.sound_tags, hesitations=words.hesitations).alias("t"))
    # Empty ones count nothing and go after the fill: a filter here would clean every text twice.
    clean = clean.withColumn("_size", F.when(F.coalesce("t", F.lit("")) == "", 0).otherwise(F.length("t") + 1).cast("long"))
    order = [f"_o{i}" for i in range(5)]
    least = max(1, min_chars)
    laid = deal(clean, by_time("_o0"))
    functions = fill_functions(laid.sortWithinPartitions(*KEYS, *order), KEYS, "_size", least)
    starts = fill_starts(functions.repartition(LECTURE).sortWithinPartitions(*KEYS), KEYS)
    begun = laid.join(starts.hint("shuffle_hash"), KEYS).withColumn("_run", F.concat_ws("\x00", *KEYS)).sortWithinPartitions(*KEYS, *order)
    filled = greedy_fill(begun, "_run", "_size", least, "paragraph_id", "held", "first").where("t <> ''")
    own = F.array_sort(F.collect_list(F.struct(*order, "t")))
    # By lecture first, so that what follows on lectures finds its rows in place.
    merged = filled.repartition("video_id").groupBy("video_id", "paragraph_id").agg(own.alias("s"))
    text = F.concat(F.array_join(F.transform("s", lambda x: x["t"]), " "), F.lit(" "))
    last = F.element_at("s", -1)
    return merged.select(
        "video_id",
        "paragraph_id",
        F.get("s", F.lit(0))["_o0"].alias("start_ms"),
        last["_o1"].alias("end_ms"),
        tx.finalize(text, style, words, times=2).alias("text"),
    )
